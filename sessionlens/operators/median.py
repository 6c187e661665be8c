"""Exact medians of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer.
Here a bounded-error sketch first brackets the middle of each group; only the values inside the
bracket, a fixed small fraction, are then ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
ROWS = "__rows"


def exact_medians(df: DataFrame, groups: list[str], measures: list[str],
                  accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: ``rows`` and, per measure, ``median_<measure>`` (NULL when unmeasured).

    The median of an even count is the mean of the two middle values. The group keys must come
    from a fixed vocabulary: one bracket row per group and measure is broadcast.
    """
    # every row also counts as a measured 0 of ROWS, so group sizes come out of the same two passes
    long = (
        df.select(*groups, F.explode(F.array(
            F.struct(F.lit(ROWS).alias("measure"), F.lit(0.0).alias("v")),
            *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v"))
              for m in measures])).alias("m"))
        .select(*groups, "m.measure", "m.v").where(F.col("v").isNotNull())
    )
    keys = [*groups, "measure"]
    slack = 4.0 / accuracy
    bracket = (
        long.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"),
             F.percentile_approx("v", [0.5 - slack, 0.5 + slack], accuracy).alias("b"))
        .select(*keys, "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    )
    same = F.lit(True)
    named = bracket.select(*[F.col(k).alias(f"b_{k}") for k in keys], "n", "lo", "hi")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    counted = (
        long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
        .join(F.broadcast(named), same)
        # everything below the bracket shrinks to one row with its total count
        .withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
        .where(F.col("v").isNull() | (F.col("v") <= F.col("hi")))
        .groupBy(*keys, "n", "v").agg(F.sum("c").alias("c"))
    )
    upto = (Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lower, upper = F.floor((F.col("n") - 1) / F.lit(2)), F.floor(F.col("n") / F.lit(2))
    end, start = F.col("end"), F.col("end") - F.col("c")
    medians = (
        counted.withColumn("end", F.sum("c").over(upto))
        .groupBy(*keys)
        .agg(F.max("n").alias("n"),
             ((F.max(F.when((start <= lower) & (lower < end), F.col("v")))
               + F.max(F.when((start <= upper) & (upper < end), F.col("v")))) / F.lit(2.0))
             .alias("median"))
    )
    return medians.groupBy(*groups).agg(
        F.max(F.when(F.col("measure") == ROWS, F.col("n"))).alias("rows"),
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}")
          for m in measures])
