"""Ordered lookups inside a key that may hold a third of all rows.

A window partitioned by such a key would sort it in one task. Here every key is cut into blocks
of ``2 ** bits`` consecutive order values and each block is scanned on its own. What a block needs from
the blocks before it (its carry) comes from one aggregate row per block, computed with map-side
combine, and enters the block as one extra row ahead of its own. A task therefore sees at most one
block of rows, or one row per block, never the key.

Order columns are integers (line position, sequence number, epoch millis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
TIME_BLOCK_BITS = 22

_BLOCK, _ORDER, _VALUE, _CARRY = "__block", "__order", "__value", "__carry"


def _block_of(order: Column, bits: int) -> Column:
    # an arithmetic shift is a floor division, for negative values as well
    return F.shiftright(order.cast("bigint"), bits)


def _ahead(bits: int) -> Column:
    """The order value just before a block's first one."""
    return F.shiftleft(F.col(_BLOCK), bits) - F.lit(1).cast("bigint")


def _before(keys: list[str]):
    return (Window.partitionBy(*keys).orderBy(_BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1))


def with_previous(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                  bits: int = BLOCK_BITS) -> DataFrame:
    """Add, per named value, its last non-NULL occurrence in the rows strictly before each row.

    ``order`` must be unique inside a key (a line position is). Values of fixed-width types keep
    the per-block aggregate a hash aggregate; a struct or string makes it a sorting one.
    """
    inner = {name: f"__v_{name}" for name in values}
    rows = rows.withColumns({
        **{inner[name]: value for name, value in values.items()},
        _ORDER: F.col(order).cast("bigint"), _BLOCK: _block_of(F.col(order), bits)})

    def last(column: str) -> Column:
        return F.last(column, ignorenulls=True)

    any_value = F.lit(False)
    for column in inner.values():
        any_value = any_value | F.col(column).isNotNull()
    carry = (
        rows.groupBy(*keys, _BLOCK)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_ORDER))).alias(c)
               for c in inner.values()])
        .select(*keys, _BLOCK, *[last(c).over(_before(keys)).alias(c) for c in inner.values()])
        .where(any_value)
        .withColumns({_ORDER: _ahead(bits), _CARRY: F.lit(True)})
    )
    scan = (Window.partitionBy(*keys, _BLOCK).orderBy(_ORDER)
            .rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn(_CARRY, F.lit(False))
        .unionByName(carry, allowMissingColumns=True)
        .withColumns({name: last(c).over(scan) for name, c in inner.items()})
        .where(~F.col(_CARRY))
        .drop(_BLOCK, _ORDER, _CARRY, *inner.values())
    )


def with_position(rows: DataFrame, keys: list[str], order: str, name: str,
                  bits: int = BLOCK_BITS) -> DataFrame:
    """Add each row's 1-based rank by ``order`` inside its key. ``order`` must be unique there."""
    return with_sums(rows, keys, order, {name: F.lit(1)}, bits)


def with_sums(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column],
              bits: int = BLOCK_BITS) -> DataFrame:
    """Add, per named value, its sum over the rows of the key up to and with each row.

    All sums come from one scan. ``order`` must be unique inside a key.
    """
    inner = {name: f"__v_{name}" for name in values}
    rows = rows.withColumns({
        **{inner[name]: value.cast("bigint") for name, value in values.items()},
        _ORDER: F.col(order).cast("bigint"), _BLOCK: _block_of(F.col(order), bits)})
    carry = (
        rows.groupBy(*keys, _BLOCK).agg(*[F.sum(c).alias(c) for c in inner.values()])
        .select(*keys, _BLOCK, F.row_number().over(Window.partitionBy(*keys).orderBy(_BLOCK)).alias(_VALUE),
                *[F.sum(c).over(_before(keys)).alias(c) for c in inner.values()])
        .where(F.col(_VALUE) > 1)
        .select(*keys, _BLOCK, *inner.values(), _ahead(bits).alias(_ORDER), F.lit(True).alias(_CARRY))
    )
    scan = (Window.partitionBy(*keys, _BLOCK).orderBy(_ORDER)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn(_CARRY, F.lit(False))
        .unionByName(carry, allowMissingColumns=True)
        .withColumns({name: F.sum(c).over(scan) for name, c in inner.items()})
        .where(~F.col(_CARRY))
        .drop(_BLOCK, _ORDER, _CARRY, *inner.values())
    )


def as_of(lookups: DataFrame, values: DataFrame, keys: list[str], at: str, order: str,
          payloads: dict[str, Column], *, inclusive: bool = False, forward: bool = False,
          greatest: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """Add to each lookup, per payload, the nearest non-NULL value before its ``at``.

    After it when ``forward``; the greatest of all earlier values when ``greatest``. Strict unless
    ``inclusive``. Values that share an order value are reduced first, with map-side combine: the
    greatest payload stays (the least when ``forward``), so lead a payload struct with its
    tie-break. Repeated lookups are looked up once and joined back on an equi-key, which AQE can
    split, so neither ties nor repeats can grow a block. A NULL key or ``at`` finds nothing.
    """
    sign = F.lit(-1 if forward else 1).cast("bigint")
    names = list(payloads)
    asked_flag = "__asked"

    def present(df: DataFrame, column: str, asks: bool) -> DataFrame:
        for k in (*keys, column):
            df = df.where(F.col(k).isNotNull())
        return df.withColumns({_ORDER: F.col(column).cast("bigint") * sign,
                               asked_flag: F.lit(asks)})

    def latest(name: str) -> Column:
        return F.max(name) if greatest else F.last(name, ignorenulls=True)

    # one row per key and order value, whether a value, a lookup or both stand there
    reduce_ties = F.min if forward else F.max
    rows = (
        present(values, order, False)
        .select(*keys, _ORDER, asked_flag, *[v.alias(n) for n, v in payloads.items()])
        .unionByName(present(lookups, at, True).select(*keys, _ORDER, asked_flag),
                     allowMissingColumns=True)
        .groupBy(*keys, _ORDER)
        .agg(*[reduce_ties(n).alias(n) for n in names], F.max(asked_flag).alias(asked_flag))
        .withColumn(_BLOCK, _block_of(F.col(_ORDER), bits))
    )

    def of_block(name: str) -> Column:
        if greatest:
            return F.max(name)
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(_ORDER)))

    any_value = F.lit(False)
    for n in names:
        any_value = any_value | F.col(n).isNotNull()
    carry = (
        rows.groupBy(*keys, _BLOCK)
        .agg(*[of_block(n).alias(n) for n in names], F.max(asked_flag).alias(asked_flag))
        .select(*keys, _BLOCK, asked_flag, *[latest(n).over(_before(keys)).alias(n) for n in names])
        .where(F.col(asked_flag) & any_value)
        .select(*keys, _ahead(bits).alias(_ORDER), *names, F.lit(False).alias(asked_flag), _BLOCK)
    )
    scan = (Window.partitionBy(*keys, _BLOCK).orderBy(_ORDER)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    answered = (
        rows.unionByName(carry)
        .select(*keys, (F.col(_ORDER) * sign).alias(at), asked_flag,
                *[latest(n).over(scan).alias(n) for n in names])
        .where(F.col(asked_flag) & any_value).drop(asked_flag)
    )
    typed = lookups.withColumn(at, F.col(at).cast("bigint"))
    return typed.join(answered, [*keys, at], "left")
