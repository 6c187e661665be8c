"""Cohort tables on one session facet: counters, rates, deltas, and the judge's per-session inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.stats import delta, rate_per_k
from sessionlens.functions.text import or_unknown
from sessionlens.operators.board import merge_counts
from sessionlens.operators.filters import (NO_FILTER, Filter, Tables, UnknownFilterValue, calls_in,
                                           filter_sessions, findings_in)
from sessionlens.schema import AXES, FACETS

COUNTERS = ["sessions", "tool_calls", "guard", "misuse", "infra"]
RATES = {"findings_per_k": "findings", "guard_per_k": "guard",
         "misuse_per_k": "misuse", "infra_per_k": "infra"}


def axis_column(axis: str) -> str:
    if axis not in AXES:
        raise UnknownFilterValue("groupBy", axis, list(AXES))
    return FACETS[axis]


def _key(column: str) -> Column:
    return or_unknown(F.col(f"s_{column}")).alias("cohort")


def _code() -> Column:
    """A finding without a code is keyed by its detector, so each is counted once."""
    return F.coalesce("code", "detector")


def cohort_counters(t: Tables, axis: str, f: Filter = NO_FILTER) -> DataFrame:
    """Per cohort the distinct sessions, observed calls and findings by plane."""
    column = axis_column(axis)
    parts = [
        filter_sessions(t.sessions, f).groupBy(or_unknown(F.col(column)).alias("cohort"))
        .agg(F.count_distinct("session_id").alias("sessions")),
        calls_in(t, f, keep=(column,)).groupBy(_key(column))
        .agg(F.count(F.lit(1)).alias("tool_calls")),
        findings_in(t, f, keep=(column,)).groupBy(_key(column))
        .agg(F.count_if(F.col("plane") == "GUARD").alias("guard"),
             F.count_if(F.col("plane") == "MODEL_MISUSE").alias("misuse"),
             F.count_if(F.col("plane") == "INFRASTRUCTURE").alias("infra")),
    ]
    return (merge_counts(parts, ["cohort"], COUNTERS)
            .withColumn("findings", F.col("guard") + F.col("misuse") + F.col("infra")))


def with_rates(counters: DataFrame) -> DataFrame:
    for rate, count in RATES.items():
        counters = counters.withColumn(rate, rate_per_k(F.col(count), F.col("tool_calls")))
    return counters


def baseline_row(rated: DataFrame, baseline: str | None = None) -> DataFrame:
    """The named cohort, else the one with most calls, the least key on ties."""
    if baseline is not None:
        return rated.where(F.col("cohort") == baseline)
    return rated.orderBy(F.desc("tool_calls"), F.asc("cohort")).limit(1)


def _is_baseline(baseline: str | None) -> Column:
    """Marks the baseline among all cohorts. One row per facet value: a window over the lot is small,
    and unlike a subquery it does not compute the counters a second time."""
    if baseline is not None:
        return F.col("cohort") == baseline
    return F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("tool_calls"), F.asc("cohort"))) == 1


def cohort_rates(t: Tables, axis: str, f: Filter = NO_FILTER,
                 baseline: str | None = None) -> DataFrame:
    """Rates per 1,000 observed calls and their deltas against the baseline."""
    rated = with_rates(cohort_counters(t, axis, f)).withColumn("is_baseline", _is_baseline(baseline))
    base = F.first(F.when(F.col("is_baseline"), F.struct(*RATES)), ignorenulls=True) \
        .over(Window.partitionBy(F.lit(0)))
    return rated.withColumn("b", base).select(
        "cohort", "sessions", "tool_calls", "findings", "guard", "misuse", "infra", *RATES,
        *[delta(F.col(r), F.col(f"b.{r}")).alias(f"{r}_delta") for r in RATES], "is_baseline")


def require_cohort(counters: DataFrame, name: str, value: str) -> None:
    if counters.where(F.col("cohort") == value).limit(1).isEmpty():
        raise UnknownFilterValue(name, value, counters.select(
            F.col("cohort").alias("value")).orderBy("value"))


def basis_note(t: Tables, axis: str, f: Filter = NO_FILTER, baseline: str | None = None,
               timeline_configured: bool = False) -> DataFrame:
    """One row saying on what basis the cohort table stands."""
    rated = cohort_counters(t, axis, f)
    declared = filter_sessions(t.sessions, f).agg(
        F.count_if(~F.col("version_inferred")).alias("declared")).scalar()
    selection = "this selection" if f.active else "this index"
    inferred = (
        "no session states its harness_version: the configured harness timeline assigned it by start "
        "time" if timeline_configured else
        "no session states its harness_version: all are inferred (version_inferred=1)")
    by_calls = F.min_by("cohort", F.struct(-F.col("tool_calls"), "cohort"))
    named = F.max(F.when(F.col("cohort") == baseline, F.col("cohort")))
    row = rated.agg(
        F.count(F.lit(1)).alias("cohorts"),
        (by_calls if baseline is None else named).alias("baseline")).withColumn("declared", declared)
    notes = F.concat_ws(
        "; ",
        F.lit("rates cover only what the shared filters let through")
        if f.active else F.lit(None).cast("string"),
        F.when(F.col("cohorts") == 1, F.lit(
            f"{axis} has one value in {selection}: there is nothing to compare it with")),
        F.when(F.col("declared") == 0, F.lit(inferred)),
        F.concat(F.lit("baseline "), F.col("baseline"), F.lit(": the cohort with the most tool calls"))
        if baseline is None else F.lit(None).cast("string"))
    empty = F.lit("no sessions match the current filters" if f.active else "the index is empty")
    return row.select(
        F.lit(axis).alias("group_by"), "baseline",
        F.when(F.col("cohorts") == 0, empty).otherwise(F.nullif(notes, F.lit(""))).alias("note"),
        (F.col("declared") == 0).alias("all_inferred"))


# --- per-session inputs of the judge ----------------------------------------------------------

def session_exposure(t: Tables, axis: str, f: Filter = NO_FILTER) -> DataFrame:
    """Observed calls per (cohort, session); the streams of one session merge."""
    column = axis_column(axis)
    return (calls_in(t, f, keep=(column,)).groupBy(_key(column), "session_id")
            .agg(F.count(F.lit(1)).alias("calls")))


def session_findings(t: Tables, axis: str, f: Filter = NO_FILTER) -> DataFrame:
    """Findings per (cohort, session, plane, code)."""
    column = axis_column(axis)
    return (findings_in(t, f, keep=(column,))
            .groupBy(_key(column), "session_id", "plane", _code().alias("code"))
            .agg(F.count(F.lit(1)).alias("count")))


def code_counts(t: Tables, axis: str, f: Filter = NO_FILTER) -> DataFrame:
    """Findings per (cohort, code)."""
    column = axis_column(axis)
    return (findings_in(t, f, keep=(column,)).groupBy(_key(column), _code().alias("code"))
            .agg(F.count(F.lit(1)).alias("count")))
