"""Rates, dispersion, the interval and the judge against closed-form values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import stats
from sessionlens.operators import cohorts, judge
from sessionlens.operators.cohorts import with_rates
from sessionlens.operators.filters import Tables, UnknownFilterValue

INF = math.inf


def side(count=0, calls=0, phi=1.0, contributing=0, units=0):
    return F.struct(F.lit(count).cast("bigint").alias("count"), F.lit(calls).cast("bigint").alias("calls"),
                    F.lit(float(phi)).alias("phi"), F.lit(contributing).cast("bigint").alias("contributing"),
                    F.lit(units).cast("bigint").alias("units"))


def ratio(spark, x1, n1, x2, n2, phi=1.0, df=INF):
    return tuple(spark.range(1).select(stats.rate_ratio(
        side(x1, n1), side(x2, n2), F.lit(phi), F.lit(float(df))).alias("r")).head().r)


def spread(spark, b, c):
    r = spark.range(1).select(stats.spread(side(*b), side(*c)).alias("s")).head().s
    return r.phi, r.df


def test_ratio(spark):
    assert ratio(spark, 100, 10_000, 200, 10_000) == (2.0, 1.573, 2.543, "worse")
    assert ratio(spark, 0, 1_000, 10, 1_000)[0] == 21.0
    assert ratio(spark, 0, 1_000, 10, 1_000)[3] == "worse"
    assert ratio(spark, 200, 10_000, 100, 10_000)[3] == "better"
    assert ratio(spark, 5, 100, 6, 100)[3] == "inconclusive"
    assert ratio(spark, 1, 0, 1, 10) == (None, None, None, "no-data")
    assert ratio(spark, 0, 10, 0, 10) == (None, None, None, "inconclusive")
    assert ratio(spark, 10, 1_000, 40, 1_000, 1.0, 0.0) == (4.0, None, None, "inconclusive")
    wide = ratio(spark, 100, 10_000, 200, 10_000, 9.0)
    assert wide[0] == 2.0 and wide[1] < 1.0 < wide[2] and wide[3] == "inconclusive"


def test_t_quantile(spark):
    def q(df):
        return spark.range(1).select(stats.t_quantile(F.lit(float(df)))).head()[0]

    assert (q(1), q(2.9), q(30), q(INF)) == (12.706, 4.303, 2.042, stats.Z_975)
    assert q(31) == pytest.approx(2.0395, abs=1e-3) and q(120) == pytest.approx(1.9799, abs=1e-3)


def test_spread(spark):
    # phi 1 on 10 findings, phi 36 on 30
    phi, _ = spread(spark, (10, 100, 1.0, 5, 6), (30, 100, 36.0, 5, 6))
    assert phi == pytest.approx(9.75)
    assert spread(spark, (0, 5, 1.0, 0, 3), (0, 5, 1.0, 0, 3)) == (1.0, INF)
    # a silent side takes the other's spread
    phi, df = spread(spark, (0, 100, 1.0, 0, 6), (20, 100, 8.0, 3, 6))
    assert phi == pytest.approx(8.0) and df == 1.0
    # nobody can show spread: one contributing session each
    assert spread(spark, (5, 100, 3.0, 1, 6), (5, 100, 2.0, 1, 6))[1] == 0.0
    # a cohort of one session decides nothing
    assert spread(spark, (5, 100, 1.0, 5, 1), (5, 100, 1.0, 5, 6))[1] == 0.0
    # evenly spread on both sides: nothing estimated, the cap stands
    assert spread(spark, (5, 100, 1.0, 4, 6), (5, 100, 1.0, 4, 6)) == (1.0, 6.0)


def direct_phi(xs, ns):
    k, x, n = len(xs), sum(xs), sum(ns)
    if k < 2 or x == 0 or max(xs) <= 1:
        return 1.0
    r = x / n if n else 0.0
    return max(1.0, k / (k - 1) * sum((a - r * b) ** 2 for a, b in zip(xs, ns)) / x)


def per_session(spark, units):
    """units: {cohort: [(x, n)]} as exposure and findings frames of one code."""
    exposure, found = [], []
    for cohort, pairs in units.items():
        for i, (x, n) in enumerate(pairs):
            if n:
                exposure.append((cohort, f"s{i}", n))
            if x:
                found.append((cohort, f"s{i}", "GUARD", "C", x))
    return (spark.createDataFrame(exposure, "cohort string, session_id string, calls bigint"),
            spark.createDataFrame(found, "cohort string, session_id string, plane string, code string, "
                                         "count bigint"))


def test_dispersion(spark):
    rng = random.Random(11)
    units = {"burst": [(8, 100), (0, 100), (0, 100), (0, 100)], "even": [(2, 100)] * 4,
             "singles": [(1, 3), (1, 900), (0, 7)], "one": [(9, 10)], "no-calls": [(4, 0), (0, 9)]}
    units |= {f"r{i}": [(rng.choice([0, 0, 1, rng.randrange(30)]), rng.randrange(200))
                        for _ in range(rng.randrange(1, 9))] for i in range(60)}
    rows = {(r.cohort, r.scope): r for r in judge.scope_sides(*per_session(spark, units)).collect()}
    for cohort, pairs in units.items():
        pairs = [(x, n) for x, n in pairs if x or n]
        if any(x for x, _ in pairs):
            r = rows[(cohort, "code")]
            assert r.phi == pytest.approx(direct_phi(*zip(*pairs))), cohort
            assert r.units == len(pairs) and r.calls == sum(n for _, n in pairs)
            assert rows[(cohort, "total")].phi == r.phi
    assert rows[("burst", "code")].phi == 8.0 and rows[("even", "code")].phi == 1.0


def test_judge_rows(spark):
    exposure, found = per_session(spark, {
        "a": [(2, 100)] * 10, "b": [(6, 100)] * 10, "quiet": [(0, 50)] * 3})
    rows = judge.compare(exposure, found, "a", "b").collect()
    by = {(r.scope, r.key): r for r in rows}
    assert set(by) == {("total", "all"), ("plane", "GUARD"), ("plane", "INFRASTRUCTURE"),
                       ("plane", "MODEL_MISUSE"), ("code", "C")}
    total = by[("total", "all")]
    assert (total.baseline_count, total.candidate_count, total.ratio, total.verdict) == (20, 60, 3.0, "worse")
    assert (total.baseline_per_k, total.candidate_per_k) == (20.0, 60.0)
    empty = by[("plane", "INFRASTRUCTURE")]
    assert (empty.ratio, empty.verdict, empty.dispersion, empty.df, empty.baseline_per_k) == (
        None, "inconclusive", 1.0, None, 0.0)
    silent = {(r.scope, r.key): r for r in judge.compare(exposure, found, "quiet", "b").collect()}
    assert silent[("code", "C")].baseline_count == 0 and silent[("code", "C")].ratio is not None
    assert silent[("code", "C")].baseline_per_k == 0.0


def test_rates(spark):
    counters = spark.createDataFrame(
        [("one", 9, 32, 4, 5, 0, 9), ("two", 3, 9, 2, 1, 0, 3), ("none", 1, 0, 0, 0, 0, 0)],
        "cohort string, sessions bigint, tool_calls bigint, guard bigint, misuse bigint, infra bigint, "
        "findings bigint")
    r = {x.cohort: x for x in with_rates(counters).collect()}
    assert (r["two"].findings_per_k, r["two"].guard_per_k) == (333.33, 222.22)
    assert (r["one"].findings_per_k, r["none"].findings_per_k) == (281.25, None)
    d = spark.range(1).select(stats.delta(F.lit(333.33), F.lit(281.25)),
                              stats.delta(F.lit(222.22), F.lit(125.0)),
                              stats.delta(F.lit(1.0), F.lit(1.125))).head()
    assert tuple(d) == (52.08, 97.22, -0.12)  # half rounds up, below zero too


def _tables(spark, sessions, calls, found):
    return Tables(
        spark.createDataFrame(sessions, "session_id string, source_file string, schema string, "
                              "model string, started_at bigint, version_inferred boolean"), None,
        spark.createDataFrame(calls, "session_id string, source_file string, seq bigint, "
                              "started_at bigint, outcome_only boolean"),
        spark.createDataFrame(found, "session_id string, source_file string, plane string, "
                              "code string, detector string, occurred_at bigint"))


def test_choice_of_cohorts(spark):
    t = _tables(spark, [("a", "f", "V0", "m", 1, True), ("b", "f", "V3", None, 1, True),
                        ("b", "g", "V0", "m", 1, True)],
                [("a", "f", 1, 5, False), ("a", "f", 2, None, True), ("b", "f", 1, 5, False)],
                [("b", "f", "GUARD", None, "stamp-guard", 7)])
    counters = {r.cohort: r for r in cohorts.cohort_counters(t, "schema").collect()}
    assert (counters["V0"].sessions, counters["V0"].tool_calls) == (2, 1)
    assert (counters["V3"].sessions, counters["V3"].guard) == (1, 1)
    assert {r.cohort for r in cohorts.cohort_counters(t, "model").collect()} == {"m", "unknown"}
    frame = cohorts.cohort_counters(t, "schema")
    assert judge.choose_pair(frame, None, None) == ("V0", "V3")  # a tie: the least key
    with pytest.raises(UnknownFilterValue) as e:
        judge.choose_pair(frame, "V9", None)
    assert [r.value for r in e.value.allowed.collect()] == ["V0", "V3"]
    with pytest.raises(ValueError, match="same cohort"):
        judge.choose_pair(frame, "V0", "V0")
    with pytest.raises(UnknownFilterValue):
        cohorts.cohort_counters(t, "colour")
    assert [r.code for r in cohorts.code_counts(t, "schema").collect()] == ["stamp-guard"]
    note = cohorts.basis_note(t, "schema").head()
    assert note.baseline == "V0" and note.all_inferred and "version_inferred=1" in note.note
    empty = Tables(t.sessions.where("false"), None, t.calls.where("false"), t.findings.where("false"))
    assert cohorts.basis_note(empty, "schema").head().note == "the index is empty"
    with pytest.raises(UnknownFilterValue):
        judge.judge(empty, "schema")
