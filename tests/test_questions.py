"""Filters, board, pages and context on small stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import board, filters, findings
from sessionlens.operators.filters import Filter, Tables, UnknownFilterValue

DAY = 86_400_000


@pytest.fixture(scope="module")
def t(spark):
    sessions = spark.createDataFrame(
        [("a", "f", "V0", None, "p", "v1", "local", "orchestrator", 10 * DAY, True),
         ("a", "g", "V3", "m", None, "v1", "local", None, 10 * DAY, True),
         ("b", "f", "V0", "unknown", "p", "v2", None, "subagent", 20 * DAY, True)],
        "session_id string, source_file string, schema string, model string, agent_preset string, "
        "harness_version string, provider string, role string, started_at bigint, version_inferred boolean")
    steps = spark.createDataFrame(
        [("a", "f", 10 * DAY, 5.0, 3, "chunk-events"), ("a", "f", 11 * DAY, 9.0, None, "chunk-events"),
         ("b", "f", 20 * DAY, None, None, "none")],
        "session_id string, source_file string, started_at bigint, decode_tps double, ttft_ms int, "
        "timing_source string")
    calls = spark.createDataFrame(
        [("a", "f", 1, "read", 11 * DAY, None, None, "1970-01-12", False),
         ("a", "f", 2, "edit", None, "E", "INFRASTRUCTURE", None, True),
         ("b", "f", 1, "bash", 20 * DAY, None, None, "1970-01-21", False)],
        "session_id string, source_file string, seq bigint, name string, started_at bigint, "
        "error_code string, plane string, day string, outcome_only boolean")
    found = spark.createDataFrame(
        [(1, "a", "f", "error-plane", "INFRASTRUCTURE", None, "E", None, None, 2, 11 * DAY, "1970-01-12"),
         (2, "b", "f", "shell-edit", "MODEL_MISUSE", "DIRECT_MUTATION", None, "TEE", 0.6, 1, 20 * DAY,
          "1970-01-21"),
         (3, "b", "f", "stamp-guard", "GUARD", "EXTERNAL", "S", None, 0.9, 1, 20 * DAY, "1970-01-21")],
        "id bigint, session_id string, source_file string, detector string, plane string, "
        "category string, code string, detail string, confidence double, seq bigint, "
        "occurred_at bigint, day string")
    return Tables(sessions, steps, calls, found)


def tiles(t, f):
    r = board.tiles(t, f).head()
    return r.sessions, r.findings, r.tool_calls, r.steps


def test_windows_root_at_each_tables_own_time(t):
    assert tiles(t, Filter()) == (2, 3, 2, 3)
    assert tiles(t, Filter(start=10 * DAY, end=10 * DAY)) == (1, 0, 0, 1)
    assert tiles(t, Filter(start=11 * DAY, end=11 * DAY)) == (0, 1, 1, 1)
    assert tiles(t, Filter(schema="V0", start=11 * DAY)) == (1, 3, 2, 2)


def test_unknown_is_null_or_the_word(t):
    assert tiles(t, Filter(model="unknown")) == (2, 3, 2, 3)
    assert tiles(t, Filter(model="m")) == (1, 0, 0, 0)
    assert tiles(t, Filter(role="unknown")) == (1, 0, 0, 0)
    assert findings.findings_page(t, code="unknown")[1].head().total == 1


def test_validation(t):
    filters.validate_filter(t, Filter(model="unknown", role="subagent"))
    filters.require_known(t, "session", "b")
    with pytest.raises(UnknownFilterValue) as e:
        filters.validate_filter(t, Filter(schema="v0"))
    assert [r.value for r in e.value.allowed.collect()] == ["V0", "V3"]
    with pytest.raises(UnknownFilterValue) as e:
        filters.require_known(t, "plane", "guard")
    assert e.value.allowed == ["INFRASTRUCTURE", "GUARD", "MODEL_MISUSE"]
    for name, value in (("session", "zz"), ("code", "zz"), ("detector", "zz")):
        with pytest.raises(UnknownFilterValue):
            filters.require_known(t, name, value)


def test_presets_and_axis():
    assert filters.preset_window("24h", 5 * DAY) == Filter(start=4 * DAY, end=5 * DAY)
    assert not filters.preset_window("all", 5 * DAY).active
    with pytest.raises(UnknownFilterValue):
        filters.preset_window("1y", 0)
    assert filters.without_facet(Filter(model="m", role="r"), "model") == Filter(role="r")


def test_board(t):
    mix = {r.plane: (r["count"], r.share_pct) for r in board.plane_mix(t).collect()}
    assert mix == {"INFRASTRUCTURE": (1, 33.3), "GUARD": (1, 33.3), "MODEL_MISUSE": (1, 33.3)}
    none = {r.plane: (r["count"], r.share_pct) for r in board.plane_mix(t, Filter(model="m")).collect()}
    assert set(none.values()) == {(0, None)}
    tail = board.code_tail(t, n=1).head()
    assert (tail.findings, tail.shown, tail.uncoded, tail.tail) == (3, 1, 1, 1)
    assert [r.code for r in board.top_codes(t).collect()] == ["E", "S"]
    series = [tuple(r) for r in board.daily_series(t).collect()]
    assert series == [("1970-01-12", 1, 1), ("1970-01-21", 2, 1)]
    dense = [tuple(r) for r in board.dense_series(board.daily_series(t)).collect()]
    assert len(dense) == 10 and dense[1] == ("1970-01-13", None, None) and dense[-1] == series[-1]
    speed = [tuple(r) for r in board.step_throughput(t).collect()]
    assert speed == [("V0", "chunk-events", 2, 7.0, 3.0), ("V0", "none", 1, None, None)]
    kinds = board.breakdown(t).collect()
    assert [k.per_thousand for k in kinds] == [500.0] * 3
    assert {(k.detector, k.detail) for k in kinds} == {
        ("error-plane", None), ("shell-edit", "TEE"), ("stamp-guard", None)}


def test_pages(t):
    def ids(**kw):
        return [r.id for r in findings.findings_page(t, **kw)[0].collect()]

    assert ids() == [3, 2, 1]
    assert ids(sort="TIME:asc") == [1, 2, 3]
    assert ids(sort="confidence:asc") == [1, 2, 3]
    assert ids(sort="confidence") == [3, 2, 1]
    assert ids(sort="code:desc") == [3, 1, 2]
    assert ids(size=2, page=1) == [1]
    assert ids(plane="GUARD") == [3]
    assert ids(size=201) == [3, 2, 1]
    for kw in ({"page": -1}, {"size": 0}):
        with pytest.raises(ValueError):
            findings.findings_page(t, **kw)
    for token in ("id", "time:down", "time:"):
        with pytest.raises(UnknownFilterValue):
            findings.sort_columns(token)


def test_pages_by_key_follow_each_other(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 0.5, 0.9]), rng.choice([5, 6, 7])) for i in
            rng.sample(range(-500, 500), 90)]
    found = spark.createDataFrame(rows, "id bigint, code string, confidence double, occurred_at bigint") \
        .selectExpr("*", "'d' detector", "'GUARD' plane", "'s' session_id", "'f' source_file")
    t = Tables(None, None, None, found)
    for sort in ("code:asc", "code:desc", "confidence", "confidence:asc", "time", "TIME:ASC"):
        whole = [r.id for r in found.orderBy(*findings.sort_columns(sort)).collect()]
        seen, last = [], None
        while len(seen) < 90:
            page, _ = findings.findings_page(t, sort=sort, size=13, after=last)
            ids = [r.id for r in page.collect()]
            assert ids and len(ids) <= 13
            seen += ids
            last = findings.page_end(page, sort)
        assert seen == whole
        assert findings.page_end(findings.findings_page(t, sort=sort, after=last)[0], sort) is None
    with pytest.raises(ValueError):
        findings.findings_page(t, page=1, after=(5, 1))


def test_context_against_loops(spark):
    rng = random.Random(9)
    calls, rows = [], []
    for s in ("hot", "b", "c"):
        n = {"hot": 60, "b": 5, "c": 0}[s]
        seqs = sorted(rng.sample(range(0, 200), n))
        started = [rng.choice([None, rng.randrange(100)]) for _ in seqs]  # out of order on purpose
        calls += [(s, "f", q, f"n{q}", a) for q, a in zip(seqs, started)]
        for i in range(12):
            seq = rng.choice([None, rng.randrange(-5, 210)] + seqs[:3])
            rows.append((len(rows), s, "f", "d", None, None, seq, rng.choice(seqs) if seqs else None,
                         rng.choice(seqs) if seqs else None, rng.randrange(-5, 110)))
    cdf = spark.createDataFrame(
        calls, "session_id string, source_file string, seq bigint, name string, started_at bigint") \
        .selectExpr("*", "cast(null as string) error_code", "cast(null as string) plane",
                    "cast(null as string) path_hint", "cast(null as bigint) duration_ms")
    fdf = spark.createDataFrame(
        rows, "id bigint, session_id string, source_file string, detector string, code string, "
        "category string, seq bigint, stale_seq bigint, cause_seq bigint, occurred_at bigint")
    check_context(spark, fdf, cdf, rows, calls, 4)
    check_context(spark, fdf, cdf, rows, calls, 51)
    with pytest.raises(ValueError):
        findings.finding_context(fdf, cdf, 0)


def check_context(spark, fdf, cdf, rows, calls, w):
    context, near = {}, {}
    for r in findings.finding_context(fdf, cdf, w, bits=2).collect():
        context.setdefault(r.id, set()).add((r.anchor, r.seq, r.mark))
    for r in findings.neighbours(fdf, cdf, w, bits=2).collect():
        near.setdefault(r.id, set()).add(r.n_id)
    anchors = {r.id: r.anchor for r in findings.anchor_seq(fdf, cdf, bits=3).collect()}
    for i, s, _, _, _, _, seq, stale, cause, at in rows:
        mine = sorted((c for c in calls if c[0] == s), key=lambda c: c[2])
        anchor = seq if seq is not None else max(
            (c[2] for c in mine if c[4] is not None and c[4] <= at), default=None)
        assert anchors[i] == anchor
        shown = [] if anchor is None else (
            [c[2] for c in mine if c[2] <= anchor][-(w + 1):] + [c[2] for c in mine if c[2] > anchor][:w])
        want = {(anchor, q, "finding" if q == seq else "cause" if q == cause else
                 "stale" if q == stale else None) for q in shown}
        assert context.get(i, set()) == want
        lo, hi = (min(shown), max(shown)) if shown else (anchor, anchor)
        inside = {r[0] for r in rows if anchor is not None and r[1] == s and r[6] is not None
                  and lo <= r[6] <= hi}
        assert near[i] == inside | {i}


def test_many_findings_around_one_call_stay_one_row_each(spark):
    """10^5 findings at one call, and some around the next: no pairs, whatever the block."""
    n = 100_000
    calls = spark.createDataFrame([("s", "f", q, f"n{q}", q * 10) for q in (1, 5, 9, 13)],
                                  "session_id string, source_file string, seq bigint, name string, started_at bigint")
    rows = spark.range(n).select(
        F.xxhash64("id").alias("id"), F.lit("s").alias("session_id"), F.lit("f").alias("source_file"),
        F.when(F.col("id") % 1000 == 0, 9).otherwise(5).cast("bigint").alias("seq"),
        F.lit(None).cast("bigint").alias("cause_seq"), F.lit(None).cast("bigint").alias("stale_seq"),
        F.lit(0).cast("bigint").alias("occurred_at"))
    silent = rows.limit(30).select("id", F.lit("quiet").alias("session_id"), "source_file",
                                   F.when(F.col("id") > 0, 3).otherwise(4).cast("bigint").alias("seq"),
                                   "cause_seq", "stale_seq", "occurred_at")
    rows = rows.unionByName(silent)
    steps = findings.ladder(rows, calls, bits=2)
    spans = findings.neighbour_spans(steps, 1)
    got = {tuple(r) for r in spans.join(rows.select("id", "session_id", "seq"), ["id", "session_id"])
           .select("session_id", "seq", "first", "last").distinct().collect()}
    low = rows.where("session_id = 'quiet' and seq = 3").count()
    assert got == {("s", 5, 1, n), ("s", 9, 1, n), ("quiet", 3, 1, low), ("quiet", 4, low + 1, 30)}
    assert spans.count() == n + 30
    placed = findings.filed(rows, steps).where("session_id = 's'")
    ordered = [r.place for r in placed.orderBy("seq", "id").select("place").collect()]
    assert ordered == list(range(1, n + 1))


def test_error_rates_and_split(t):
    assert board.error_rates(t).count() == 0  # the one failed row is an outcome without a call
    split = {r.schema: (r.rows, r.outcome_only) for r in board.outcome_split(t).collect()}
    assert split == {"V0": (3, 1)}


def test_vocabulary(t):
    got = {(r.facet, r.value) for r in filters.vocabulary(t).collect()}
    assert ("model", "unknown") in got and ("code", "unknown") in got and ("preset", "unknown") in got
    assert {v for f, v in got if f == "detector"} == {"error-plane", "shell-edit", "stamp-guard"}
    assert filters.vocabulary(t).groupBy("facet", "value").count().where("count > 1").count() == 0
    assert t.findings.where(F.col("code").isNull()).count() == 1
