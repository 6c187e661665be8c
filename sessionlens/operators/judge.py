"""The judge: is a candidate cohort's failure rate different from a baseline's beyond chance?

All of it is aggregation: per-session counts, then per-row sums, then column expressions over one
row per scope. The only action is the choice of the two cohorts when the caller leaves one open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import stats
from sessionlens.functions.text import literal_array, round_half_up
from sessionlens.operators.cohorts import (baseline_row, cohort_counters, require_cohort,
                                           session_exposure, session_findings)
from sessionlens.operators.filters import NO_FILTER, Filter, Tables, UnknownFilterValue
from sessionlens.schema import PLANES

SCOPES = ("total", "plane", "code")


def choose_pair(counters: DataFrame, baseline: str | None, candidate: str | None,
                ) -> tuple[str, str]:
    """The two cohorts to compare; an open candidate needs exactly one other cohort."""
    if baseline is None:
        top = baseline_row(counters).select("cohort").head()
        if top is None:
            raise UnknownFilterValue("baseline", None, [])
        baseline = top[0]
    else:
        require_cohort(counters, "baseline", baseline)
    if candidate is None:
        others = counters.where(F.col("cohort") != baseline).select("cohort").limit(2).collect()
        if len(others) != 1:
            raise UnknownFilterValue("candidate", None, counters.where(
                F.col("cohort") != baseline).select(F.col("cohort").alias("value")).orderBy("value"))
        candidate = others[0][0]
    else:
        require_cohort(counters, "candidate", candidate)
    if baseline == candidate:
        raise ValueError(f"candidate and baseline are the same cohort ({baseline})")
    return baseline, candidate


def session_rows(exposure: DataFrame, findings: DataFrame) -> DataFrame:
    """Per (cohort, session, scope, key): its findings ``x`` beside its observed calls ``n``.

    The scopes are the grouping sets (), (plane), (code), and ``unit``: one row per session that
    has an observed call or a finding. Everything is keyed by (cohort, session), so one shuffle of
    already aggregated rows serves the exposure window and the sums; a session holds one row per
    plane and code it met.
    """
    none = F.lit(None).cast("string")
    stacked = exposure.select("cohort", "session_id", none.alias("plane"), none.alias("code"),
                              F.col("calls").alias("n"), F.lit(0).cast("bigint").alias("x")) \
        .unionByName(findings.select("cohort", "session_id", "plane", "code",
                                     F.lit(0).cast("bigint").alias("n"), F.col("count").alias("x")))
    session = ["cohort", "session_id"]
    exposed = stacked.withColumn("n", F.sum("n").over(Window.partitionBy(*session)))

    def scope(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("scope"), key.alias("key"))

    unit = scope("unit", F.lit("all"))
    scopes = F.when(F.col("x") > 0, F.array(
        unit, scope("total", F.lit("all")), scope("plane", F.col("plane")),
        scope("code", F.col("code")))).otherwise(F.array(unit))
    return (exposed.select(*session, "n", "x", F.explode(scopes).alias("s"))
            .groupBy(*session, "s.scope", "s.key")
            .agg(F.max("n").alias("n"), F.sum("x").alias("x")))


def row_sums(exposure: DataFrame, findings: DataFrame) -> DataFrame:
    """G1-G3 inputs: the sums of every (cohort, scope, key), units included, in one pass."""
    x, n = F.col("x").cast("double"), F.col("n").cast("double")
    return session_rows(exposure, findings).groupBy("cohort", "scope", "key").agg(
        F.sum("x").alias("count"), F.count(F.lit(1)).alias("contributing"), F.max("x").alias("max_x"),
        F.sum(x * x).alias("sum_x2"), F.sum(x * n).alias("sum_xn"),
        F.sum("n").alias("sum_n"), F.sum(n * n).alias("sum_n2"))


def judge_units(exposure: DataFrame, findings: DataFrame) -> DataFrame:
    """Per cohort its units (sessions with an observed call or a finding), N and sum of n^2."""
    return (row_sums(exposure, findings).where(F.col("scope") == "unit")
            .select("cohort", F.col("contributing").alias("units"), F.col("sum_n").alias("calls"),
                    "sum_n2"))


def _of_units(column: str) -> Column:
    # over one row per scope and key of a cohort: as many rows as there are codes
    return F.max(F.when(F.col("scope") == "unit", F.col(column))).over(Window.partitionBy("cohort"))


def sides(exposure: DataFrame, findings: DataFrame) -> DataFrame:
    """Per (cohort, scope, key) the counts and the dispersion of one side."""
    with_units = row_sums(exposure, findings).select(
        "*", _of_units("contributing").alias("units"), _of_units("sum_n").alias("calls"),
        _of_units("sum_n2").alias("unit_n2"))
    phi = stats.dispersion(
        F.col("units"), F.col("calls"), F.col("count"), F.col("sum_x2"), F.col("sum_xn"),
        F.col("unit_n2"), F.col("max_x"))
    return with_units.select("cohort", "scope", "key", "count", "contributing", "units", "calls",
                             phi.alias("phi"))


def scope_sides(exposure: DataFrame, findings: DataFrame) -> DataFrame:
    return sides(exposure, findings).where(F.col("scope") != "unit")


def compare(exposure: DataFrame, findings: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row per scope and key seen on either side, plus total and every plane."""
    pair = F.col("cohort").isin(baseline, candidate)
    rows = sides(exposure.where(pair), findings.where(pair))
    # the unit row of a side stands for the total and plane rows it may lack
    blank = F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(key).alias("key"))
        for scope, key in (("total", "all"), *(("plane", p) for p in PLANES))])
    here = F.array(F.struct("scope", "key"))
    is_unit = F.col("scope") == "unit"
    spread_out = rows.select(
        "cohort", "units", "calls", "phi", "count", "contributing", is_unit.alias("unit"),
        F.explode(F.when(is_unit, blank).otherwise(here)).alias("s")) \
        .select("*", "s.scope", "s.key")

    def pick(cohort: str, column: str, empty, counted: bool = True) -> Column:
        mine = F.col("cohort") == cohort
        if counted:
            mine = mine & ~F.col("unit")
        return F.coalesce(F.max(F.when(mine, F.col(column))), F.lit(empty)).alias(column)

    paired = spread_out.groupBy("scope", "key").agg(*[
        F.struct(pick(cohort, "count", 0), pick(cohort, "phi", 1.0),
                 pick(cohort, "contributing", 0), pick(cohort, "units", 0, False),
                 pick(cohort, "calls", 0, False)).alias(name)
        for cohort, name in ((baseline, "b"), (candidate, "c"))])
    # units and calls belong to the cohort: a side that never met a code still has them. One row
    # per scope and key, so this window spans as many rows as there are codes.
    everywhere = Window.partitionBy(F.lit(0))
    for name in ("b", "c"):
        side = F.col(name)
        for column in ("units", "calls"):
            side = side.withField(column, F.max(F.col(f"{name}.{column}")).over(everywhere))
        paired = paired.withColumn(name, side)
    b, c = F.col("b"), F.col("c")
    judged = paired.select("scope", "key", "b", "c", stats.let(F.struct("b", "c"), lambda s: (
        stats.compare_sides(s["b"], s["c"]))).alias("j"))
    phi, df = F.col("j.phi"), F.col("j.df")
    shown_df = F.when(F.col("j.r.ratio").isNotNull() & (df != F.lit(stats.INFINITE)), df)
    return judged.select(
        "scope", "key",
        b["count"].alias("baseline_count"), c["count"].alias("candidate_count"),
        stats.rate_per_k(b["count"], b["calls"]).alias("baseline_per_k"),
        stats.rate_per_k(c["count"], c["calls"]).alias("candidate_per_k"),
        "j.r.ratio", "j.r.low", "j.r.high", "j.r.verdict",
        b["contributing"].alias("baseline_sessions"),
        c["contributing"].alias("candidate_sessions"),
        round_half_up(phi, 2).alias("dispersion"),
        round_half_up(shown_df, 1).alias("df"))


def row_order() -> list:
    """Total, then the planes in their fixed order, then codes by count and name."""
    scope = F.array_position(literal_array(SCOPES), F.col("scope"))
    plane = F.array_position(literal_array(PLANES), F.col("key"))
    is_code = F.col("scope") == "code"
    both = F.col("baseline_count") + F.col("candidate_count")
    return [scope, plane, F.when(is_code, -both), F.when(is_code, F.col("key"))]


def judge(t: Tables, axis: str, baseline: str | None = None, candidate: str | None = None,
          f: Filter = NO_FILTER) -> DataFrame:
    if baseline is None or candidate is None:
        baseline, candidate = choose_pair(cohort_counters(t, axis, f), baseline, candidate)
    return compare(session_exposure(t, axis, f), session_findings(t, axis, f),
                   baseline, candidate).orderBy(*row_order())


def judge_basis(axis: str, all_inferred: bool, baseline_chosen: bool, f: Filter = NO_FILTER) -> str:
    notes = ["a verdict needs the whole 95% interval of the rate ratio on one side of one; failures "
             "that cluster in few sessions widen it, and inconclusive means more data is needed"]
    if f.active:
        notes.append("both cohorts hold only what the shared filters let through")
    if axis == "harnessVersion" and all_inferred:
        notes.append("harness_version is attributed, no session states it")
    if baseline_chosen:
        notes.append("baseline: the cohort with the most tool calls")
    return "; ".join(notes)
