"""Prefix trie of conversations with totals per node, by van Emde Boas recursion over depths.

The depths 0 to H - 1 (H a power of two) are cut at half, each half again, and so on; the depth
``d`` is cut where halves have ``lowbit(d)`` levels. All subproblems of one size are one round:

* down: the prefixes that end at a cut are named from the name of their subproblem's root and the
  turns between, which splits a subproblem into its upper trie and the forest of lower ones;
* up: the finished total of a lower tree's root is handed to the root of the upper trie over it;
* last, every total is grafted onto the nodes that stand between those two.

So a trie of depth D takes 2 log D rounds, and a node is counted at most log D times, however long
one conversation is. Names are 128-bit hashes of the turns with their places, so no key gathers the
members of a common prefix, and counts combine before they are shuffled. Places inside a
conversation come from one sort by ranges, so a conversation of a third of all rows is many tasks.

Defined results: rows without conv_id belong to no conversation and are left out. Turns with equal
``turn`` keep an order of their own: by the hex MD5 of (hex MD5 of role, hex MD5 of text). Repeated
rows are repeated turns. ``c % 5`` truncates toward zero. An empty table has no nodes, not even a
root. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.llm.shared import stored

SHARED_WITH = 5  # conversations c - c % 5 to c - c % 5 + 4 begin alike
SHARED_TURNS = 9  # by fewer than this many turns
ID_BITS = 10  # member ids are joined in blocks of at most 2 ** ID_BITS ids
NAME = ["one", "two"]


def _lowbit(depth: Column) -> Column:
    return depth.bitwiseAND(-depth)


def _base(conv: Column) -> Column:
    return conv - conv % SHARED_WITH


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, key, bytes), pos from 1, and (conv, total): turns in order and their number."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("tie")]
    rows = stored(
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("bigint").alias("conv"), "turn",
                F.md5(F.concat(F.md5(role), F.md5(text))).alias("key"),
                F.octet_length(text).cast("bigint").alias("bytes"),
                F.monotonically_increasing_id().alias("tie"))  # splits runs of equal rows
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "key", "bytes", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().alias("at")))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(  # a row per conversation and task that holds some of it
        rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                F.sum("n").over(whole).alias("total")))
    placed = rows.join(runs.drop("total"), ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "key", "bytes")
    return placed, runs.where(F.col("before") == 0).select("conv", "total")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, key, bytes, length) of the rebuilt conversations, and all of (conv, length)."""
    placed, totals = ordered_turns(conversations)
    h = F.crc32(F.col("conv").cast("string")) % SHARED_TURNS
    bases = totals.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    lengths = stored(
        totals.withColumns({"h": h, "base": _base(F.col("conv"))}).join(bases, "base", "left")
        .withColumn("shared", F.least("h", F.coalesce("base_total", F.lit(0))))
        .select("conv", "h", "shared",
                (F.col("shared") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")))
    conv, near = F.col("conv"), [F.col("conv") + F.lit(k) for k in range(1 - SHARED_WITH, SHARED_WITH)]
    heads = (F.col("pos") < SHARED_TURNS) & (conv % SHARED_WITH == 0)
    to = F.array(F.struct(conv.alias("to"), F.lit(False).alias("lent")),
                 *[F.when(heads & (_base(c) == conv), F.struct(c.alias("to"), F.lit(True).alias("lent")))
                   for c in near])
    turns = (
        placed.select("pos", "key", "bytes", F.inline(F.array_compact(to)))
        .withColumnRenamed("to", "conv").join(lengths, "conv")
        .where(F.when(F.col("lent"), F.col("pos") <= F.col("shared")).otherwise(F.col("pos") > F.col("h")))
        .select("conv", F.when(F.col("lent"), F.col("pos"))
                .otherwise(F.col("pos") - F.col("h") + F.col("shared")).alias("depth"),
                "key", "bytes", "length"))
    return turns, lengths.select("conv", "length")


def _cuts(turns: DataFrame, levels: int) -> DataFrame:
    """Per conversation and cut, a hash of the turns since the root of the cut's subproblem."""
    turns = turns.withColumns({"first": F.xxhash64("key", "depth"), "second": F.xxhash64("depth", "key")})
    size, cut = F.col("size"), F.col("cut")
    return (
        turns.withColumn("size", F.explode(F.array(*[F.lit(1 << k).cast("bigint") for k in range(levels)])))
        .withColumn("cut", (F.col("depth") + size - 1).bitwiseAND(-size))
        .where((cut.bitwiseAND(size) != 0) & (cut <= F.col("length")))
        .groupBy("conv", "cut")
        .agg(F.bit_xor("first").alias("first"), F.bit_xor("second").alias("second"),
             F.max(F.when(cut == F.col("depth"), F.col("bytes"))).alias("cut_bytes")))


def named_prefixes(turns: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """Every prefix of every conversation with its name and the name of its subproblem's root (up)."""
    cuts = stored(_cuts(turns, levels))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    paths = lengths.select("conv", "length", zero.alias("depth"), zero.alias("one"), zero.alias("two"),
                           none.alias("up_one"), none.alias("up_two"), zero.alias("bytes"))
    fields = ["depth", *NAME, "up_one", "up_two", "bytes"]
    for k in reversed(range(levels)):
        size = 1 << k
        halves = cuts.where(_lowbit(F.col("cut")) == size).select(
            "conv", (F.col("cut") - size).alias("depth"), "first", "second", "cut_bytes")
        lower = F.struct(
            (F.col("depth") + size).alias("depth"),
            F.xxhash64("one", "two", "first", "second").alias("one"),
            F.xxhash64("second", "first", "two", "one").alias("two"),
            F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("cut_bytes").alias("bytes"))
        both = F.array(F.struct(*fields), F.when(F.col("first").isNotNull(), lower))
        paths = paths.join(halves, ["conv", "depth"], "left") \
            .select("conv", "length", F.inline(F.array_compact(both)))
    return paths


def _nodes(paths: DataFrame) -> DataFrame:
    """The nodes, each with its parent, its children and what it adds to the totals."""
    nodes = paths.groupBy(*NAME).agg(
        F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.max("up_one").alias("up_one"), F.max("up_two").alias("up_two"), F.max("bytes").alias("bytes"))
    above = paths.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"),
                         F.col("one").alias("parent_one"), F.col("two").alias("parent_two"))
    nodes = stored(nodes.join(above, ["conv_id", "depth"], "left"))
    parent = ["parent_one", "parent_two"]
    children = nodes.where(F.col("depth") > 0).groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children")) \
        .withColumnsRenamed(dict(zip(parent, NAME, strict=True)))
    parents = nodes.select(F.col("one").alias("parent_one"), F.col("two").alias("parent_two"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(children, NAME, "left").join(parents, parent, "left").drop(*parent)
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
        .withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"),
                      "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))


TOTALS = ["n_leaves", "saved_tokens"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOTALS]


def _handed_up(nodes: DataFrame, levels: int) -> DataFrame:
    """Each node's total over its own lower tree: the levels from it down to the next larger cut."""
    kept = [*NAME, "conv_id", "depth", "up_one", "up_two"]
    rest, finished = nodes.select(*kept, *TOTALS), []
    for k in range(levels):
        ready = _lowbit(F.col("depth")) == (1 << k)
        finished.append(rest.where(ready))
        handed = rest.where(ready).groupBy(F.col("up_one").alias("one"), F.col("up_two").alias("two")).agg(*_sums())
        rest = stored(
            rest.where(~ready).unionByName(handed, allowMissingColumns=True).groupBy(*NAME)
            .agg(*[F.max(c).alias(c) for c in kept[2:]], *_sums()))
    return reduce(DataFrame.unionByName, finished, rest)


def _grafted(paths: DataFrame, handed: DataFrame, levels: int) -> DataFrame:
    """The totals of whole subtrees: each handed total also goes to the nodes it was handed past."""
    size, depth = F.col("size"), F.col("depth")
    past = (
        paths.withColumn("size", F.explode(F.array(*[F.lit(1 << k).cast("bigint") for k in range(1, levels)])))
        .withColumn("cut", (depth + size).bitwiseAND(-size))
        .where((depth.bitwiseAND(size - 1) != 0) & (F.col("cut").bitwiseAND(size) != 0)
               & (F.col("cut") <= F.col("length")))
        .select(*NAME, F.col("conv").alias("conv_id"), F.col("cut").alias("depth")))
    gains = past.join(handed.select("conv_id", "depth", *TOTALS), ["conv_id", "depth"])
    return handed.select(*NAME, *TOTALS).unionByName(gains.select(*NAME, *TOTALS)).groupBy(*NAME).agg(*_sums())


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted member ids of each name, running over blocks of ids as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def rows(done: list) -> pa.RecordBatch:
            one, two, digests = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(digests, pa.string())],
                [*NAME, "ends_sha256"])

        for batch in batches:
            done = []
            for one, two, ids in zip(*(batch.column(c).to_pylist() for c in (*NAME, "ids")), strict=True):
                if (one, two) == name:
                    state.update(b",")
                else:
                    if name is not None:
                        done.append((*name, state.hexdigest()))
                    name, state = (one, two), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield rows(done)
        if name is not None:
            yield rows([(*name, state.hexdigest())])

    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    blocks = ends.groupBy(*NAME, F.shiftright("conv", ID_BITS).alias("block")) \
        .agg(F.array_join(ids, ",").alias("ids"))
    return (blocks.repartition(*NAME).sortWithinPartitions(*NAME, "block")
            .mapInArrow(run, "one bigint, two bigint, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the textless root included."""
    turns, lengths = rebuilt(conversations)
    turns = stored(turns)
    deepest = lengths.agg(F.max("length")).head()[0] or 0
    levels = max(2, int(deepest).bit_length())
    paths = stored(named_prefixes(turns, lengths, levels))
    nodes = stored(_nodes(paths))
    totals = _grafted(paths, _handed_up(nodes, levels), levels)
    digests = _digests(paths.where(F.col("depth") == F.col("length")).select(*NAME, "conv"))
    return (
        nodes.drop(*TOTALS).join(totals, NAME).join(digests, NAME, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *TOTALS,
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
