"""The stored tables: versions by bucket of streams, per-stream replace, prune, run summary.

An index is a folder of tables, each cut into buckets of streams. A run writes only the buckets its
streams fall in, under a version of its own, and then one pointer row that says which version of
which bucket counts. A reader follows the pointer, so it sees all tables before a run or all after
it; a run that fails leaves nothing visible, and its version is written over by the next. One run at
a time may write an index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlens.operators.filters import Tables
from sessionlens.schema import STREAM

# table name -> attribute of Tables
TABLES = {"session": "sessions", "step": "steps", "tool_call": "calls",
          "finding": "findings", "shell_evidence": "evidence"}
MANIFEST = "log_file"
BUCKETS = 64
_PLACE = "version bigint, bucket int"


def replace_streams(stored: DataFrame, written: DataFrame, streams: DataFrame) -> DataFrame:
    """The stored rows of other streams plus the written rows; writing twice changes nothing."""
    kept = stored.join(streams.select(*STREAM).distinct(), STREAM, "left_anti")
    return kept.unionByName(written)


def prune(t: Tables, scanned: DataFrame) -> Tables:
    """Only the streams the scan still found."""
    keep = scanned.select(*STREAM).distinct()

    def kept(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(keep, STREAM, "left_semi")

    return Tables(kept(t.sessions), kept(t.steps), kept(t.calls), kept(t.findings),
                  kept(t.evidence))


def pruned_streams(sessions: DataFrame, scanned: DataFrame) -> DataFrame:
    return sessions.join(scanned.select(*STREAM).distinct(), STREAM, "left_anti") \
        .select(*STREAM)


def merge_facts(stored: Tables, written: Tables) -> Tables:
    """The stored tables with the written streams replaced and all others kept."""
    streams = written.sessions.select(*STREAM)
    return Tables(**{
        attribute: replace_streams(getattr(stored, attribute), getattr(written, attribute), streams)
        for attribute in TABLES.values()})


# --- one set of tables, written whole ---------------------------------------------------------

def _order(name: str) -> list[str]:
    """Rows of a day lie together in the tables asked by time, so a time window skips row groups."""
    return ["day", *STREAM, "seq"] if name in ("tool_call", "finding") else [*STREAM]


def write_table(df: DataFrame, name: str, path: str) -> None:
    if name in ("tool_call", "finding"):
        # ranges of (day, stream, seq) keep a busy day or stream from landing in one task
        df = df.repartitionByRange(*_order(name)).sortWithinPartitions(*_order(name))
    df.write.mode("overwrite").parquet(path)


def write_facts(t: Tables, path: str) -> None:
    """Store the five tables as they are. ``path`` must not be one that ``t`` is read from."""
    for name, attribute in TABLES.items():
        write_table(getattr(t, attribute), name, f"{path}/{name}")


# --- an index: versions of buckets ------------------------------------------------------------

@dataclass(frozen=True)
class Index:
    """What the pointer says: the version of each bucket that counts, and the tables' columns."""

    spark: SparkSession
    path: str
    version: int
    buckets: int
    versions: dict[int, int]
    schemas: dict[str, str]

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of some buckets or all; other versions are never opened."""
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        by_version: dict[int, list[int]] = {}
        for bucket, version in self.versions.items():
            if buckets is None or bucket in buckets:
                by_version.setdefault(version, []).append(bucket)
        counts = [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in by_version.items()]
        placed = self.spark.read.schema(f"{_ddl(schema)}, {_PLACE}").parquet(f"{self.path}/{name}")
        return placed.where(reduce(Column.__or__, counts, F.lit(False))).drop("version", "bucket")

    def tables(self) -> Tables:
        return Tables(**{attribute: self.table(name) for name, attribute in TABLES.items()})


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*STREAM), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index at ``path`` as its last whole run left it; None where no run has ended."""
    if not _exists(spark, f"{path}/pointer"):
        return None
    last = (spark.read.schema("version bigint, body string").json(f"{path}/pointer")
            .orderBy(F.desc("version")).head())
    if last is None:
        return None
    body = json.loads(last.body)
    return Index(spark, path, last.version, body["buckets"],
                 {int(b): v for b, v in body["versions"].items()}, body["schemas"])


def replace_in_index(spark: SparkSession, path: str, rows: dict[str, DataFrame], removed: DataFrame,
                     files: DataFrame, base: Index | Tables | None, buckets: int = BUCKETS) -> Index:
    """Write ``rows`` (by table name, the manifest among them) into the index at ``path``.

    Of ``base`` the streams in ``removed`` and in ``rows`` leave, as do the manifest rows of ``files``
    (root, file). Only buckets that gain or lose a stream are written, unless ``base`` is not the index at
    ``path`` itself, whose other buckets are then copied.
    """
    here = open_index(spark, path)
    same = isinstance(base, Index) and base.path == path
    buckets = base.buckets if same else buckets
    gone = removed.select(*STREAM).unionByName(rows["session"].select(*STREAM)).distinct()
    if same:
        found = gone.unionByName(rows[MANIFEST].select(*STREAM)).select(bucket_of(buckets).alias("b")).distinct()
        touched = sorted(r.b for r in found.collect())  # at most as many as there are buckets
    else:
        touched = list(range(buckets))
    version = 1 + max([here.version if here else 0, base.version if same else 0])
    for name, written in rows.items():
        out = written
        if isinstance(base, Index):
            kept = base.table(name, touched if same else None)
        else:
            kept = getattr(base, TABLES[name]) if base is not None and name in TABLES else None
        if kept is not None:
            kept = (kept.join(files, files.columns, "left_anti") if name == MANIFEST
                    else kept.join(gone, STREAM, "left_anti"))
            out = kept.select(*written.columns).unionByName(written)
        # rebalancing gathers a bucket's rows and splits a large one, without a pass to sample ranges
        (out.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket")
         .sortWithinPartitions("bucket", *_order(name))
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/version={version}"))
    versions = (dict(base.versions) if same else {}) | dict.fromkeys(touched, version)
    schemas = {name: json.dumps(df.schema.jsonValue()) for name, df in rows.items()}
    body = json.dumps({"buckets": buckets, "versions": versions, "schemas": schemas})
    pointer = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(body).alias("body"))
    pointer.write.mode("append").json(f"{path}/pointer")
    return open_index(spark, path)


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The five tables of an index, or of a folder they were written to whole."""
    index = open_index(spark, path)
    if index is not None:
        return index.tables()
    return Tables(**{attribute: spark.read.parquet(f"{path}/{name}")
                     for name, attribute in TABLES.items()})


def run_summary(t: Tables, bad_lines: DataFrame | None = None,
                pruned: DataFrame | None = None) -> DataFrame:
    """What a run produced, one row from one aggregate per table."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    counters = ["streams", "sessions", "steps", "tool_calls", "findings", "evidence_rows",
                "pruned", "parse_failures"]
    parts = [
        t.sessions.agg(F.count(F.lit(1)).alias("streams"),
                       F.count_distinct("session_id").alias("sessions")),
        rows(t.steps, "steps"), rows(t.calls, "tool_calls"), rows(t.findings, "findings"),
    ]
    if t.evidence is not None:
        parts.append(rows(t.evidence, "evidence_rows"))
    if pruned is not None:
        parts.append(rows(pruned, "pruned"))
    if bad_lines is not None:
        parts.append(bad_lines.agg(F.sum("bad_lines").alias("parse_failures")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    present = [c for c in counters if c in stacked.columns]
    return stacked.agg(*[
        (F.coalesce(F.sum(c), F.lit(0)) if c in present else F.lit(0)).cast("bigint").alias(c)
        for c in counters])
