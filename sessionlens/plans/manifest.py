"""The run manifest: which log files a run saw, as what stream each is stored, what was wrong in it.

A later run compares its own listing with it: a file of the same size, time and settings is not
read again, and only a stream whose file this very root no longer holds may leave the tables. A root that is
mistyped, or another one, therefore prunes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.schema import STREAM
from sessionlens.sources import logs

FILE = ["root", "file"]
UNCHANGED = [*FILE, "length", "modified", "config"]
COLUMNS = [*STREAM, *UNCHANGED, "folder_id", "project_slug", "schema", "bad_lines"]


def listed(spark: SparkSession, root: str, config: str) -> DataFrame:
    """The log files under ``root`` as they are now, one row each."""
    return described(logs.scan_streams(spark, root), root, config)


def described(files: DataFrame, root: str, config: str) -> DataFrame:
    """Adds to listed files their root, the settings they are indexed with, and their key."""
    return files.withColumnRenamed("session_id", "folder_id").withColumns(
        {"root": F.lit(root), "config": F.md5(F.lit(config)), "file_key": logs.file_key(F.col("file"))})


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or differ in size, time or settings from what the last run read."""
    return files.join(known.select(*UNCHANGED), UNCHANGED, "left_anti")


def vanished(files: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest rows of the listed root whose file is no longer there."""
    return known.join(files.select(*FILE), FILE, "left_anti")


def resolved(files: DataFrame, headers: DataFrame, bad: DataFrame) -> DataFrame:
    """Manifest rows: a stream has the id its header declares, its folder's name where it declares none.

    ``headers`` has (file_key, id), ``bad`` has (file_key, bad_lines); a file without any line is in
    neither.
    """
    return (
        files.join(headers, "file_key", "left").join(bad, "file_key", "left")
        .withColumn("session_id", F.coalesce(F.nullif("id", "file_key"), "folder_id"))
        .withColumn("bad_lines", F.coalesce("bad_lines", F.lit(0).cast("bigint")))
        .select("file_key", *COLUMNS))


def streams(manifest: DataFrame) -> DataFrame:
    """The file that stands for each stream: of several that declare one id, the last by path."""
    return manifest.groupBy(*STREAM).agg(
        F.max(F.struct("file", "file_key", "project_slug", "schema")).alias("last")) \
        .select(*STREAM, "last.file_key", "last.project_slug", "last.schema")


def literal_paths(files: DataFrame) -> list[str]:
    """The files' paths for a reader that would expand patterns in them.

    Names of changed files pass through the driver, as every file listing of Spark does.
    """
    rows = files.select(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("path")).toLocalIterator()
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", row.path) for row in rows]
