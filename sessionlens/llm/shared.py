"""Helpers of the llm operators: cut lineage, words of a text, word hashes, block prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CACHE_WORDS = 400_000  # a worker's memory of hashed words; it starts anew when full


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate files, below the one ``spark.checkpoint.dir`` names.

    Every executor reaches it. Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    A lost executor loses nothing; Spark removes the files once nothing refers to them, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the work folder and read again: smaller than a checkpoint.

    For tables of many narrow rows. The files stay until the work folder is emptied.
    """
    path = f"{work_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D; ``lower`` turns A-Z to a-z first."""
    if not text:
        return []
    return (text.translate(LOWER) if lower else text).split()


class WordHash(dict):
    """word -> 64-bit hash, remembered while a bounded number of words fits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def all(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that looks random; another one for each salt."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(20240101)
_LETTER = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_RUN = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_REACH = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(
            np.concatenate([[np.uint64(1)], np.full(_REACH - 1, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOW = np.frombuffer(LOWER, np.uint8)


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, A-Z in lower case, and where each text's words begin.

    Words are runs of bytes other than space and 0x09 to 0x0D. A word's hash is a polynomial in its
    bytes, taken from running sums over the batch, so no word becomes an object. The second array has
    one entry more than there are texts.
    """
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
    offsets = offsets.astype(np.int64)
    data = (np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            if len(raw) and raw.buffers()[2] is not None else np.empty(0, np.uint8))
    offsets = offsets - offsets[0]
    data = _LOW[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[-1] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = int(np.searchsorted(ends, low + _REACH, "left"))
            if stop == at:  # a word beyond the reach is hashed alone, wherever it stands
                hashes[at] = xxhash.xxh64_intdigest(data[low:ends[at]].tobytes())
                at += 1
                continue
            a, b = starts[at:stop] - low, ends[at:stop] - low
            sums = np.zeros(b[-1] + 1, np.uint64)
            np.cumsum(_LETTER[data[low:low + b[-1]]] * _UP[:b[-1]], out=sums[1:])
            hashes[at:stop] = mix((sums[b] - sums[a]) * _DOWN[a] + (b - a).astype(np.uint64))
            at = stop
    return hashes, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, in order; none when there are fewer words."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:count] * _RUN[0]
        for k in range(1, n):
            out += hashes[k:k + count] * _RUN[k]
    return mix(out)


def prefix_sums(totals: DataFrame, index: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """``out``: the sum of ``value`` over rows with a smaller ``index``, summed in blocks of indexes.

    No task sorts more than ``width`` rows or one row per block.
    """
    blocks = totals.withColumn("_block", F.floor(F.col(index) / width))
    before = (blocks.groupBy("_block").agg(F.sum(value).alias("_sum"))
              .withColumn("_upto", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum"))
              .select("_block", "_upto"))
    own = F.sum(value).over(Window.partitionBy("_block").orderBy(index)) - F.col(value)
    return (blocks.withColumn("_own", own).join(before, "_block")
            .withColumn(out, F.col("_own") + F.col("_upto")).drop("_block", "_own", "_upto"))


def segment_rows(total: np.ndarray, segments: int) -> pa.RecordBatch:
    """An array of counts, cut along its first axis, as rows (segment, counts) without empty ones."""
    parts = np.array_split(total, segments)
    used = [k for k, part in enumerate(parts) if part.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([packed(parts[k]) for k in used], pa.binary())],
        ["segment", "counts"])


def packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def summed_segments(rows: DataFrame, kind: str, tasks: int = 16) -> DataFrame:
    """The sum of each segment's arrays of ``kind``, one array at a time as the rows stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(*batch.columns, strict=True):
                part, k = unpacked(counts.as_py(), kind), segment.as_py()
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(total, pa.int32()), pa.array([packed(v) for v in total.values()], pa.binary())],
            ["segment", "counts"])

    return (rows.select("segment", "counts").repartition(tasks, "segment")
            .mapInArrow(run, "segment int, counts binary"))


def gathered(rows: DataFrame, kind: str, segments: int, size: int) -> np.ndarray:
    """The summed array itself; its size is a parameter of the caller, whatever the data."""
    out = np.array_split(np.zeros(size, kind), segments)
    for row in summed_segments(rows, kind).collect():
        out[row.segment] = unpacked(row.counts, kind)
    return np.concatenate(out)
