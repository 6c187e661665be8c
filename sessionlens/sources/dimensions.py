"""Small configured dimensions: the harness timeline and the code-to-plane map."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.schema import CODE_PLANES


def timeline_entries(entries: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """Validated ``(epoch millis, version)`` pairs in order; equal times keep the given order."""
    out = []
    for since, version in entries:
        if since is None:
            raise ValueError("a timeline entry needs a 'since' instant")
        if version is None or not version.strip():
            raise ValueError(f"the timeline entry at {since} needs a non-blank version")
        at = datetime.fromisoformat(since)
        if at.tzinfo is None:
            raise ValueError(f"'since' needs an offset or Z: {since}")
        epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
        out.append((round((at - epoch).total_seconds() * 1000), version))
    return sorted(out, key=lambda e: e[0])


def timeline_df(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(timeline_entries(entries), "since bigint, version string")


def version_at(started_at: Column, entries: list[tuple[str, str]], fallback: str) -> Column:
    """Version of the last entry not after ``started_at``, else the fallback.

    The timeline is a handful of configured releases, so it is looked up in a literal array inside
    the projection; there is no join to plan or skew.
    """
    table = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(since).cast("bigint").alias("since"),
                 F.lit(version).alias("version"))
        for i, (since, version) in enumerate(timeline_entries(entries))])
    if not entries:
        return F.lit(fallback)
    reached = F.filter(table, lambda e: e["since"] <= started_at)
    return F.coalesce(F.array_max(reached)["version"], F.lit(fallback))


def code_planes_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODE_PLANES.items()), "code string, plane string")
