"""The index run: session logs in, the five stored tables out.

The lines are decompressed and parsed once into a typed table in the shared folder; every fact is
derived from that table, and the detectors read the written facts. Each cut is a written Parquet
table, so a lost executor costs the tasks it held and nothing upstream.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import text as tx
from sessionlens.operators import detectors
from sessionlens.operators import facts as facts_of
from sessionlens.operators.detectors import Detector, Facts
from sessionlens.operators.filters import Tables
from sessionlens.plans import manifest, sinks
from sessionlens.schema import STREAM
from sessionlens.session import materialise, shared_folder
from sessionlens.sources import logs
from sessionlens.sources.dimensions import code_planes_df


@dataclass(frozen=True)
class IndexConfig:
    timeline: tuple[tuple[str, str], ...] = ()
    fallback_version: str = "unknown"
    store_evidence: bool = True
    detectors: tuple[Detector, ...] | None = None


@dataclass(frozen=True)
class IndexRun:
    tables: Tables
    bad_lines: DataFrame
    unmapped_codes: DataFrame
    pruned: DataFrame | None = None


def derive_facts(events: DataFrame, config: IndexConfig = IndexConfig()) -> Facts:
    """Lazy facts of a set of typed events."""
    return Facts(events, config.timeline, config.fallback_version)


def hold_facts(facts: Facts, folder: str | None = None,
               tables: tuple[str, ...] = ("sessions", "calls", "commands")) -> Facts:
    """Write the tables that several readers share, once; the rest stay projections of events."""
    folder = folder or new_folder(facts.events.sparkSession)
    for name in tables:
        setattr(facts, name, materialise(getattr(facts, name), f"{name}_facts", folder))
    return facts


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sessionlens-{uuid.uuid4().hex}"


def settings(config: IndexConfig) -> str:
    """What a file's rows depend on besides the file: other settings make it be read again."""
    names = sorted(d.id for d in config.detectors or detectors.default_detectors())
    return repr((config.timeline, config.fallback_version, config.store_evidence, names))


def index_files(lines: DataFrame, files: DataFrame, config: IndexConfig, folder: str) -> dict[str, DataFrame]:
    """The rows of every table, by table name, of the listed ``files`` and their ``lines``.

    While lines are folded a file's key stands for its stream; the ids that headers declare are put
    in once, in the results. A file without a good line is a session without steps or calls.
    """
    parsed = materialise(logs.parse_events(lines), "events", folder)
    held = hold_facts(derive_facts(logs.good_events(parsed), config), folder)
    bad = logs.bad_lines(parsed).select(F.col("session_id").alias("file_key"), "bad_lines")
    seen = materialise(manifest.resolved(
        files, held.sessions.select(F.col("session_id").alias("file_key"), "id"), bad), "files", folder)
    streams = materialise(manifest.streams(seen), "streams", folder)
    keys = streams.select("file_key", *STREAM)

    def named(df: DataFrame) -> DataFrame:
        return (df.withColumnRenamed("session_id", "file_key").drop("source_file").join(keys, "file_key")
                .select(*df.columns))

    of_file = held.sessions.withColumnRenamed("session_id", "file_key") \
        .drop("source_file", "id", "project_slug", "schema", "harness_version", "version_inferred")
    header = (
        streams.join(of_file, "file_key", "left").withColumn("id", F.col("session_id"))
        .withColumns({"started_at": F.coalesce("started_at", F.lit(1).cast("bigint")),
                      "fatal_turns": F.coalesce("fatal_turns", F.lit(0)),
                      "role": F.coalesce("role", tx.role_of(F.col("delegation_depth")))}))
    sessions = materialise(
        facts_of.attribute_version(header, config.timeline, config.fallback_version)
        .select(*held.sessions.columns), "sessions", folder)
    registry = None if config.detectors is None else list(config.detectors)
    found = materialise(named(detectors.detect_all(held, registry))
                        .withColumn("id", detectors.finding_id()), "found", folder)
    findings, evidence = detectors.finding_tables(found, sessions, config.store_evidence)
    return {"session": sessions.drop("cwd"), "step": named(held.steps),
            "tool_call": facts_of.tool_call_table(named(held.calls), sessions),
            "finding": findings, "shell_evidence": evidence,
            sinks.MANIFEST: seen.drop("file_key")}


def index_run(spark: SparkSession, root: str, path: str, config: IndexConfig = IndexConfig(),
              previous: str | None = None, buckets: int = sinks.BUCKETS) -> IndexRun:
    """Bring the index at ``path`` up to what lies under ``root``.

    Files that the last run of this root read with the same settings are not read again. Streams
    of changed files are replaced, those of vanished ones leave; streams of another root stay. With ``previous``,
    the path of another index or of plain tables, that is what the run starts from.
    """
    folder = new_folder(spark)
    start = previous or path
    base = sinks.open_index(spark, start)
    if base is None and previous is not None:
        base = sinks.read_tables(spark, previous)  # without a manifest: all is read, nothing pruned
    files = materialise(manifest.listed(spark, root, settings(config)), "listed", folder)
    if files.isEmpty():
        warnings.warn("no session logs under the given root: the tables hold none of it", stacklevel=2)
    known = base.table(sinks.MANIFEST).where(F.col("root") == root) if isinstance(base, sinks.Index) else None
    todo = files if known is None else materialise(manifest.changed(files, known), "changed", folder)
    gone = None if known is None else materialise(manifest.vanished(files, known), "vanished", folder)
    idle = known is not None and start == path and todo.isEmpty() and gone.isEmpty()
    if not idle:
        rows = index_files(_lines(spark, root, None if known is None else todo), todo, config, folder)
        old = files.select(*manifest.FILE, *STREAM[1:]).where("false").withColumn("session_id", F.lit("")) \
            if known is None else known.join(todo.select(*manifest.FILE), manifest.FILE, "left_semi").unionByName(gone)
        base = sinks.replace_in_index(spark, path, rows, old, old.select(*manifest.FILE), base, buckets)
    of_root = base.table(sinks.MANIFEST).where(F.col("root") == root)
    pruned = files.select(F.col("folder_id").alias("session_id"), "source_file").where("false") if gone is None else \
        gone.select(*STREAM).distinct().join(base.table("session"), STREAM, "left_anti")
    tables = base.tables()
    codes = tables.calls.select(F.col("error_code").alias("code"))
    return IndexRun(tables, of_root.select(*STREAM, "bad_lines"),
                    facts_of.unmapped_codes(codes, code_planes_df(spark)), pruned)


def _lines(spark: SparkSession, root: str, files: DataFrame | None) -> DataFrame:
    """The lines under ``root``, or of some of its files only; a file's key stands for its stream."""
    if files is None:
        return logs.read_events(spark, root, keyed=True)
    return logs.read_events(spark, manifest.literal_paths(files), keyed=True)
