"""Board aggregates: tiles, mixes, tops, breakdown, daily series, throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.stats import rate_per_k
from sessionlens.operators.filters import (NO_FILTER, Filter, Tables, calls_in, filter_sessions,
                                           findings_in, steps_in)
from sessionlens.operators.median import exact_medians
from sessionlens.schema import PLANES

TOP_CODES = 8
KIND = ["detector", "plane", "category", "code", "detail"]


def merge_counts(parts: list[DataFrame], keys: list[str], counters: list[str]) -> DataFrame:
    """Key union of partial counts, a missing side counting 0: a full outer join as one union and
    one aggregate, which combines map-side and never meets a skewed join key."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters])


def tiles(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """A1: one row. Sessions are distinct ids, not streams."""
    parts = [
        filter_sessions(t.sessions, f).agg(F.count_distinct("session_id").alias("sessions")),
        findings_in(t, f).agg(F.count(F.lit(1)).alias("findings")),
        calls_in(t, f).agg(F.count(F.lit(1)).alias("tool_calls")),
        steps_in(t, f).agg(F.count(F.lit(1)).alias("steps")),
    ]
    return merge_counts(parts, [], ["sessions", "findings", "tool_calls", "steps"])


def plane_mix(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """A2: all three planes, absent ones as 0, with their share of all findings in percent."""
    counted = findings_in(t, f).agg(
        *[F.count_if(F.col("plane") == p).alias(p) for p in PLANES])
    total = reduce(lambda a, b: a + b, [F.col(p) for p in PLANES])
    rows = counted.select(total.alias("total"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("plane"), F.col(p).alias("count")) for p in PLANES])).alias("r"))
    share = F.try_divide(F.col("r.count").cast("double") * F.lit(100.0),
                         F.nullif("total", F.lit(0)).cast("double"))
    return rows.select("r.plane", "r.count",
                       (F.floor(share * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)).alias("share_pct"))


def top_detectors(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    return (findings_in(t, f).groupBy("detector").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("detector")))


def top_codes(t: Tables, f: Filter = NO_FILTER, n: int = TOP_CODES) -> DataFrame:
    return (findings_in(t, f).where(F.col("code").isNotNull())
            .groupBy("code").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("code")).limit(n))


def code_tail(t: Tables, f: Filter = NO_FILTER, n: int = TOP_CODES) -> DataFrame:
    """A5: how the findings split into shown bars, uncoded ones and the tail; the parts sum up."""
    shown = top_codes(t, f, n).agg(F.sum("count").alias("shown"))
    totals = findings_in(t, f).agg(F.count(F.lit(1)).alias("findings"),
                                   F.count_if(F.col("code").isNull()).alias("uncoded"))
    return (merge_counts([shown, totals], [], ["findings", "shown", "uncoded"])
            .withColumn("tail", F.col("findings") - F.col("shown") - F.col("uncoded")))


def breakdown(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """Findings by kind with each kind's rate over the observed calls of the selection."""
    calls = calls_in(t, f).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (findings_in(t, f).groupBy(*KIND).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("per_thousand", rate_per_k(F.col("count"), calls))
            .orderBy(F.desc("count"), *[F.asc_nulls_first(k) for k in KIND if k != "plane"]))


def daily_series(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """Findings and observed calls per UTC day; a day with neither is absent."""
    parts = [
        findings_in(t, f).groupBy("day").agg(F.count(F.lit(1)).alias("findings")),
        calls_in(t, f).where(F.col("day").isNotNull())
        .groupBy("day").agg(F.count(F.lit(1)).alias("tool_calls")),
    ]
    return merge_counts(parts, ["day"], ["findings", "tool_calls"]).orderBy("day")


def dense_series(series: DataFrame) -> DataFrame:
    """The same series on an unbroken day axis; a day without data reads NULL, not 0."""
    axis = series.agg(F.min("day").cast("date").alias("a"), F.max("day").cast("date").alias("z")) \
        .where(F.col("a").isNotNull()) \
        .select(F.explode(F.sequence("a", "z")).alias("day")) \
        .select(F.col("day").cast("string"))
    return axis.join(series, "day", "left").orderBy("day")


def step_throughput(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """Per (schema, timing source) the step count and exact medians, NULL when unmeasured."""
    rows = steps_in(t, f, keep=("schema",)).select(
        F.col("s_schema").alias("schema"), "timing_source", "decode_tps", "ttft_ms")
    medians = exact_medians(rows, ["schema", "timing_source"], ["decode_tps", "ttft_ms"])
    return medians.withColumnRenamed("rows", "steps").orderBy("schema", "timing_source")


def error_rates(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    """Observed calls by tool, code and plane, with each tool's own call count."""
    calls = calls_in(t, f)
    by_kind = (calls.where(F.col("error_code").isNotNull())
               .groupBy("name", "error_code", "plane").agg(F.count(F.lit(1)).alias("errors")))
    per_tool = calls.groupBy("name").agg(F.count(F.lit(1)).alias("tool_calls"))
    named = per_tool.withColumnRenamed("name", "tool_name")
    return (by_kind.join(named, F.col("name").eqNullSafe(F.col("tool_name")), "left")
            .drop("tool_name")
            .withColumn("per_thousand", rate_per_k(F.col("errors"), F.col("tool_calls"))))


def outcome_split(t: Tables) -> DataFrame:
    """How many stored call rows of each convention are outcomes without a call."""
    owners = t.sessions.select("session_id", "source_file", "schema")
    return (t.calls.join(owners, ["session_id", "source_file"])
            .groupBy("schema").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_if("outcome_only").alias("outcome_only")))
