"""Shards by jump consistent hashing.

The shard of a row depends on its key and the shard count alone, so there is no ring table, and one
more shard takes rows only into itself. The loop is vectorised over a batch of keys; a batch ends
after as many steps as its longest key needs, about the logarithm of the shard count.

The slot of a row within its shard comes from counts: each scan partition knows how many rows it
gives to each shard, prefix sums over those counts give it an offset there, and only the rows that one
partition gives to one shard are ever sorted together. A key that holds a third of all rows is
spread over the partitions it is read from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.llm.shared import cut

MULTIPLIER = 2862933555777941757
OVERHEAD_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, 0 to ``shards`` - 1."""
    keys = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            keys[live] = keys[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = (keys[live] >> np.uint64(33)).astype(np.float64) + 1.0
            landing = np.floor((shard[live] + 1) * (2147483648.0 / draw))
            inside = landing < shards
            live = live[inside]
            shard[live] = landing[inside].astype(np.int64)
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a row. Any type of key; rows without one share the shard of the absent key."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def assign(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards))

    return assign(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16 for the record. An absent text counts as an empty one
    (size 16, checksum 0). Rows with an absent key go to one shard like any other key. Repeated rows
    each get a slot of their own. An empty table gives no rows. Other columns are not carried, so
    their names cannot clash. ``grown_shard`` is the shard with one shard more.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(
        F.col(key),
        (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_part", F.shiftright("_row", 33)))
    given = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = given.select("shard", "_part", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row")) - 1
    return (rows.join(before, ["shard", "_part"])
            .select(key, "size", "text_crc32", "shard",
                    (F.col("_before") + place).alias("slot"), "grown_shard"))
