"""Queries over the stored-tables view: board, filters, cohorts, judge, findings, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.catalog.sql import STORED
from sessionlens.functions import stats
from sessionlens.functions import text as tx
from sessionlens.functions.text import round_half_up
from sessionlens.operators import board, cohorts, facts, findings, judge
from sessionlens.operators.filters import (Filter, Tables, apply_axis, findings_in, preset_window,
                                           validate_filter, vocabulary, without_facet)
from sessionlens.plans import report, sinks
from sessionlens.schema import STREAM
from sessionlens.sources import tables as src
from sessionlens.sources.dimensions import code_planes_df

WINDOW = Filter(start=1704585600000, end=1705968000000, schema="V0")
UNKNOWN_MODEL = Filter(model="unknown", role="unknown")
NOW = 1706659200000

QUERIES: dict = {}


def query(name: str, sql: str | None = None, prefix: str = STORED):
    def add(fn):
        QUERIES[name] = (fn, None if sql is None else f"WITH {prefix}\n{sql}")
        return fn
    return add


def on_tables(name: str, sql: str | None = None):
    def add(fn):
        query(name, sql)(lambda spark, sf: fn(src.stored_tables(spark, sf)))
        return fn
    return add


# SQL spellings of the shared rounding and rate
def r_sql(x: str, places: int) -> str:
    # rounding goes through a 64-bit integer, so it saturates there
    scaled = f"floor(({x}) * {10.0 ** places} + 0.5)"
    top = "9223372036854775807::DOUBLE"
    return f"(CASE WHEN {scaled} > {top} THEN {top} ELSE {scaled} END / {10.0 ** places})"


def per_k(x: str, n: str) -> str:
    return f"CASE WHEN {n} <> 0 THEN {r_sql(f'CAST({x} AS DOUBLE) * 1000.0 / {n}', 2)} END"


WIN_F = "f.occurred_at BETWEEN 1704585600000 AND 1705968000000 AND s.schema = 'V0'"
JOIN_S = "JOIN session s ON s.session_id = {0}.session_id AND s.source_file = {0}.source_file"

# --- board ------------------------------------------------------------------------------------

on_tables("tiles", """
SELECT (SELECT count(DISTINCT session_id) FROM session) AS sessions,
  (SELECT count(*) FROM finding) AS findings, (SELECT count(*) FROM observed) AS tool_calls,
  (SELECT count(*) FROM step) AS steps""")(board.tiles)

on_tables("tiles_windowed", f"""
SELECT (SELECT count(DISTINCT session_id) FROM session WHERE schema = 'V0'
    AND started_at BETWEEN 1704585600000 AND 1705968000000) AS sessions,
  (SELECT count(*) FROM finding f {JOIN_S.format('f')} WHERE {WIN_F}) AS findings,
  (SELECT count(*) FROM observed f {JOIN_S.format('f')}
    WHERE {WIN_F.replace('occurred_at', 'started_at')}) AS tool_calls,
  (SELECT count(*) FROM step f {JOIN_S.format('f')}
    WHERE {WIN_F.replace('occurred_at', 'started_at')}) AS steps
""")(lambda t: board.tiles(t, WINDOW))

on_tables("facet_unknown", f"""
SELECT f.detector, count(*) AS count FROM finding f {JOIN_S.format('f')}
WHERE coalesce(s.model, 'unknown') = 'unknown' AND coalesce(s.role, 'unknown') = 'unknown'
GROUP BY f.detector""")(lambda t: board.top_detectors(t, UNKNOWN_MODEL))

on_tables("findings_axis", """
SELECT id, session_id, seq, occurred_at FROM finding
WHERE plane = 'GUARD' AND detector = 'stamp-guard' AND code = 'FS_STALE_VERSION'
""")(lambda t: apply_axis(findings_in(t), plane="GUARD", detector="stamp-guard",
                          code="FS_STALE_VERSION").select("id", "session_id", "seq", "occurred_at"))

on_tables("vocabulary", """
SELECT DISTINCT facet, value FROM (
  SELECT 'schema' AS facet, schema AS value FROM session
  UNION ALL SELECT 'model', coalesce(model, 'unknown') FROM session
  UNION ALL SELECT 'preset', coalesce(agent_preset, 'unknown') FROM session
  UNION ALL SELECT 'harnessVersion', coalesce(harness_version, 'unknown') FROM session
  UNION ALL SELECT 'provider', coalesce(provider, 'unknown') FROM session
  UNION ALL SELECT 'role', coalesce(role, 'unknown') FROM session
  UNION ALL SELECT 'code', coalesce(code, 'unknown') FROM finding
  UNION ALL SELECT 'detector', detector FROM finding)""")(vocabulary)


@on_tables("preset_7d", f"""
SELECT day, count(*) AS findings FROM finding
WHERE occurred_at BETWEEN {NOW - 7 * 86_400_000} AND {NOW} GROUP BY day""")
def _preset(t: Tables):
    rows = findings_in(t, preset_window("7d", NOW))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("findings"))


@on_tables("axis_unfiltered", f"""
SELECT coalesce(s.model, 'unknown') AS cohort, count(*) AS findings
FROM finding f {JOIN_S.format('f')} WHERE s.schema = 'V0' GROUP BY 1""")
def _axis_unfiltered(t: Tables):
    f = Filter(schema="V0", model="m-large")
    validate_filter(t, f)
    counted = cohorts.cohort_counters(t, "model", without_facet(f, "model"))
    return counted.select("cohort", "findings")


on_tables("plane_mix", f"""
SELECT p.plane, count(f.id) AS count,
  {r_sql('CAST(count(f.id) AS DOUBLE) * 100.0 / (SELECT count(*) FROM finding)', 1)} AS share_pct
FROM (VALUES ('INFRASTRUCTURE'), ('GUARD'), ('MODEL_MISUSE')) AS p(plane)
LEFT JOIN finding f ON f.plane = p.plane GROUP BY p.plane""")(board.plane_mix)

on_tables("top_detectors", """
SELECT detector, count(*) AS count FROM finding GROUP BY detector""")(board.top_detectors)

TOP8 = """SELECT code, count(*) AS count FROM finding WHERE code IS NOT NULL
GROUP BY code ORDER BY count DESC, code LIMIT 8"""
on_tables("top_codes", TOP8)(board.top_codes)

on_tables("uncoded_tail", """, top3 AS (SELECT count(*) AS n FROM finding WHERE code IS NOT NULL
  GROUP BY code ORDER BY n DESC, code LIMIT 3)
SELECT findings, shown, uncoded, findings - shown - uncoded AS tail FROM (
  SELECT (SELECT count(*) FROM finding) AS findings,
    (SELECT CAST(sum(n) AS BIGINT) FROM top3) AS shown,
    (SELECT count(*) FROM finding WHERE code IS NULL) AS uncoded)
""")(lambda t: board.code_tail(t, n=3))

on_tables("breakdown", f"""
SELECT detector, plane, category, code, detail, count(*) AS count,
  {per_k('count(*)', '(SELECT count(*) FROM observed)')} AS per_thousand
FROM finding GROUP BY detector, plane, category, code, detail""")(board.breakdown)

SERIES = """SELECT coalesce(f.day, c.day) AS day, coalesce(f.n, 0) AS findings, coalesce(c.n, 0) AS tool_calls
FROM (SELECT day, count(*) AS n FROM finding GROUP BY day) f
FULL JOIN (SELECT day, count(*) AS n FROM observed WHERE day IS NOT NULL GROUP BY day) c ON f.day = c.day"""
on_tables("daily_series", SERIES)(board.daily_series)

# every day moved to twice its distance from a fixed one, so that each second day is a gap
STRETCHED = "DATE '2000-01-01' + CAST(2 * (day::DATE - DATE '2000-01-01') AS INTEGER)"


@on_tables("daily_series_dense", f""", series AS ({SERIES}),
far AS (SELECT {STRETCHED} AS d, findings, tool_calls FROM series)
SELECT strftime(a.d, '%Y-%m-%d') AS day, findings, tool_calls
FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM far) a
LEFT JOIN far ON far.d = a.d""")
def _dense(t: Tables):
    start = F.lit("2000-01-01").cast("date")
    far = F.date_add(start, (F.datediff(F.col("day").cast("date"), start) * 2).cast("int"))
    return board.dense_series(board.daily_series(t).withColumn("day", far.cast("string")))


@on_tables("step_throughput", f"""
SELECT s.schema, f.timing_source, count(*) AS steps,
  {r_sql('median(f.decode_tps)', 3)} AS median_decode_tps,
  {r_sql('median(f.ttft_ms)', 1)} AS median_ttft_ms
FROM step f {JOIN_S.format('f')} GROUP BY s.schema, f.timing_source""")
def _throughput(t: Tables):
    return board.step_throughput(t).select(
        "schema", "timing_source", "steps",
        round_half_up(F.col("median_decode_tps"), 3).alias("median_decode_tps"),
        round_half_up(F.col("median_ttft_ms"), 1).alias("median_ttft_ms"))


on_tables("error_by_tool", f"""
SELECT e.name, e.error_code, e.plane, e.errors, c.tool_calls,
  {per_k('e.errors', 'c.tool_calls')} AS per_thousand
FROM (SELECT name, error_code, plane, count(*) AS errors FROM observed
      WHERE error_code IS NOT NULL GROUP BY name, error_code, plane) e
JOIN (SELECT name, count(*) AS tool_calls FROM observed GROUP BY name) c ON c.name = e.name
""")(lambda t: board.error_rates(t).select(
    "name", "error_code", "plane", "errors", "tool_calls", "per_thousand"))

on_tables("outcome_split", f"""
SELECT s.schema, count(*) AS rows, count(*) FILTER (outcome_only) AS outcome_only
FROM tool_call f {JOIN_S.format('f')} GROUP BY s.schema""")(board.outcome_split)

# --- cohorts ----------------------------------------------------------------------------------


def cohort_sql(column: str, where: str = "TRUE") -> str:
    key = f"coalesce(s.{column}, 'unknown')"
    return f""", cohort AS (
  SELECT cohort, CAST(sum(ns) AS BIGINT) AS sessions, CAST(sum(nc) AS BIGINT) AS tool_calls,
    CAST(sum(g) AS BIGINT) AS guard, CAST(sum(m) AS BIGINT) AS misuse, CAST(sum(i) AS BIGINT) AS infra,
    CAST(sum(g) + sum(m) + sum(i) AS BIGINT) AS findings
  FROM (
    SELECT {key} AS cohort, count(DISTINCT session_id) AS ns, 0 AS nc, 0 AS g, 0 AS m, 0 AS i
      FROM session s WHERE {where} GROUP BY 1
    UNION ALL SELECT {key}, 0, count(*), 0, 0, 0 FROM observed f {JOIN_S.format('f')} WHERE {where} GROUP BY 1
    UNION ALL SELECT {key}, 0, 0, count(*) FILTER (plane = 'GUARD'), count(*) FILTER (plane = 'MODEL_MISUSE'),
      count(*) FILTER (plane = 'INFRASTRUCTURE') FROM finding f {JOIN_S.format('f')} WHERE {where} GROUP BY 1
  ) GROUP BY cohort)"""


RATED = f""", rated AS (SELECT *, {per_k('findings', 'tool_calls')} AS findings_per_k,
  {per_k('guard', 'tool_calls')} AS guard_per_k, {per_k('misuse', 'tool_calls')} AS misuse_per_k,
  {per_k('infra', 'tool_calls')} AS infra_per_k FROM cohort)"""

DELTAS = f"""SELECT r.cohort, r.sessions, r.tool_calls, r.findings, r.guard, r.misuse, r.infra,
  r.findings_per_k, r.guard_per_k, r.misuse_per_k, r.infra_per_k,
  {r_sql('r.findings_per_k - b.findings_per_k', 2)} AS findings_per_k_delta,
  {r_sql('r.guard_per_k - b.guard_per_k', 2)} AS guard_per_k_delta,
  {r_sql('r.misuse_per_k - b.misuse_per_k', 2)} AS misuse_per_k_delta,
  {r_sql('r.infra_per_k - b.infra_per_k', 2)} AS infra_per_k_delta,
  r.cohort = b.cohort AS is_baseline
FROM rated r, """

for _axis, _column in (("model", "model"), ("provider", "provider"), ("role", "role"),
                       ("harnessVersion", "harness_version"), ("schema", "schema"),
                       ("preset", "agent_preset")):
    on_tables(f"cohort_counters_{_column}", cohort_sql(_column) + "\nSELECT * FROM cohort")(
        lambda t, axis=_axis: cohorts.cohort_counters(t, axis))

COHORT_RATES = cohort_sql("model") + RATED + DELTAS \
    + "(SELECT * FROM rated ORDER BY tool_calls DESC, cohort LIMIT 1) b"
on_tables("cohort_rates", COHORT_RATES)(lambda t: cohorts.cohort_rates(t, "model"))
on_tables("cohort_rates_filtered", cohort_sql("provider", "s.schema = 'V3'") + RATED + DELTAS
          + "(SELECT * FROM rated WHERE cohort = 'unknown') b")(
    lambda t: cohorts.cohort_rates(t, "provider", Filter(schema="V3"), baseline="unknown"))
on_tables("cohort_baseline", cohort_sql("provider")
          + "\nSELECT cohort, tool_calls FROM cohort ORDER BY tool_calls DESC, cohort LIMIT 1")(
    lambda t: cohorts.baseline_row(cohorts.cohort_counters(t, "provider"))
    .select("cohort", "tool_calls"))
on_tables("basis_note", cohort_sql("schema") + """
SELECT 'schema' AS group_by, cohort AS baseline,
  'no session states its harness_version: the configured harness timeline assigned it by start time; baseline '
  || cohort || ': the cohort with the most tool calls' AS note, TRUE AS all_inferred
FROM cohort ORDER BY tool_calls DESC, cohort LIMIT 1""")(
    lambda t: cohorts.basis_note(t, "schema", timeline_configured=True))

EXPOSURE = f"""SELECT coalesce(s.model, 'unknown') AS cohort, f.session_id, count(*) AS calls
FROM observed f {JOIN_S.format('f')} GROUP BY 1, 2"""
BY_SESSION = f"""SELECT coalesce(s.model, 'unknown') AS cohort, f.session_id, f.plane,
  coalesce(f.code, f.detector) AS code, count(*) AS count
FROM finding f {JOIN_S.format('f')} GROUP BY 1, 2, 3, 4"""
on_tables("session_exposure", EXPOSURE)(lambda t: cohorts.session_exposure(t, "model"))
on_tables("session_findings", BY_SESSION)(lambda t: cohorts.session_findings(t, "model"))
on_tables("code_counts", f"""
SELECT coalesce(s.model, 'unknown') AS cohort, coalesce(f.code, f.detector) AS code, count(*) AS count
FROM finding f {JOIN_S.format('f')} GROUP BY 1, 2""")(lambda t: cohorts.code_counts(t, "model"))

# --- judge ------------------------------------------------------------------------------------

UNITS = f""", exposure AS ({EXPOSURE}), found AS ({BY_SESSION}),
unit AS (SELECT cohort, session_id, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT cohort, session_id, calls AS n FROM exposure
    UNION ALL SELECT cohort, session_id, 0 FROM found) GROUP BY cohort, session_id),
total AS (SELECT cohort, count(*) AS units, CAST(sum(n) AS BIGINT) AS calls FROM unit GROUP BY cohort)"""

on_tables("judge_units", UNITS + """
SELECT cohort, count(*) AS units, CAST(sum(n) AS BIGINT) AS calls, sum(CAST(n AS DOUBLE) * n) AS sum_n2
FROM unit GROUP BY cohort""")(lambda t: judge.judge_units(
    cohorts.session_exposure(t, "model"), cohorts.session_findings(t, "model")))

# phi straight from its definition: residuals of every unit, silent ones included
SIDES = UNITS + """,
scoped AS (SELECT cohort, session_id, 'total' AS scope, 'all' AS key, count FROM found
  UNION ALL SELECT cohort, session_id, 'plane', plane, count FROM found
  UNION ALL SELECT cohort, session_id, 'code', code, count FROM found),
kinds AS (SELECT DISTINCT cohort, scope, key FROM scoped),
xs AS (SELECT u.cohort, k.scope, k.key, u.session_id, u.n, CAST(coalesce(sum(s.count), 0) AS BIGINT) AS x
  FROM unit u JOIN kinds k ON k.cohort = u.cohort
  LEFT JOIN scoped s ON s.cohort = u.cohort AND s.session_id = u.session_id AND s.scope = k.scope AND s.key = k.key
  GROUP BY u.cohort, k.scope, k.key, u.session_id, u.n),
rate AS (SELECT cohort, scope, key, CAST(sum(x) AS BIGINT) AS count, count(*) FILTER (x > 0) AS contributing,
    count(*) AS units, CAST(sum(n) AS BIGINT) AS calls, max(x) AS max_x,
    CASE WHEN sum(n) = 0 THEN 0.0 ELSE CAST(sum(x) AS DOUBLE) / sum(n) END AS r FROM xs GROUP BY cohort, scope, key),
resid AS (SELECT x.cohort, x.scope, x.key, sum((x.x - r.r * x.n) * (x.x - r.r * x.n)) AS sq
  FROM xs x JOIN rate r ON r.cohort = x.cohort AND r.scope = x.scope AND r.key = x.key GROUP BY x.cohort, x.scope, x.key),
side AS (SELECT r.cohort, r.scope, r.key, r.count, r.contributing, r.units, r.calls,
    CASE WHEN r.units < 2 OR r.count = 0 OR r.max_x <= 1 THEN 1.0
      ELSE greatest(1.0, CAST(r.units AS DOUBLE) / (r.units - 1) * q.sq / r.count) END AS phi
  FROM rate r JOIN resid q ON q.cohort = r.cohort AND q.scope = r.scope AND q.key = r.key)"""


@on_tables("dispersion", SIDES + f"""
SELECT cohort, scope, key, count, contributing, units, calls, {r_sql('phi', 6)} AS phi FROM side""")
def _dispersion(t: Tables):
    rows = judge.scope_sides(cohorts.session_exposure(t, "model"), cohorts.session_findings(t, "model"))
    return rows.withColumn("phi", round_half_up(F.col("phi"), 6))


_Z = stats.Z_975
QUANTILE = f"""CASE WHEN isinf({{0}}) THEN {_Z} WHEN floor(least({{0}}, 1e6)) <= 30
  THEN list_extract({list(stats.T_975)}::DOUBLE[], CAST(greatest(1, floor(least({{0}}, 1e6))) AS INTEGER))
  ELSE {_Z} + {_Z ** 3 + _Z} / (4.0 * floor(least({{0}}, 1e6)))
   + {5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z} / (96.0 * floor(least({{0}}, 1e6)) * floor(least({{0}}, 1e6)))
   + {3 * _Z ** 7 + 19 * _Z ** 5 + 17 * _Z ** 3 - 15 * _Z} / (384.0 * floor(least({{0}}, 1e6))
     * floor(least({{0}}, 1e6)) * floor(least({{0}}, 1e6))) END"""


def compare_sql(rows: str) -> str:
    """From ``rows`` with x, phi, s (contributing), u, n for sides 1 and 2 to the judged columns."""
    return f""", c0 AS ({rows}),
c1 AS (SELECT *, x1 = 0 AND x2 = 0 AS silent, CASE WHEN x1 = 0 OR x2 = 0 THEN 0.5 ELSE 0.0 END AS h,
  x1 > 0 AND s1 >= 2 AS own1, x2 > 0 AND s2 >= 2 AS own2 FROM c0),
c2 AS (SELECT *, CASE WHEN NOT silent THEN 1.0 / (x1 + h) END AS a1, CASE WHEN NOT silent THEN 1.0 / (x2 + h) END AS a2,
  CASE WHEN NOT own1 AND own2 THEN greatest(1.0, phi1, phi2) ELSE greatest(1.0, phi1) END AS p1,
  CASE WHEN own1 AND NOT own2 THEN greatest(1.0, phi1, phi2) ELSE greatest(1.0, phi2) END AS p2 FROM c1),
c3 AS (SELECT *, p1 * a1 + p2 * a2 AS v, (p1 * a1 + p2 * a2) / (a1 + a2) AS phi0,
  CASE WHEN own1 THEN s1 ELSE s2 END AS os, s1 + s2 - 2 AS cap FROM c2),
c4 AS (SELECT *, CASE WHEN own1 AND own2 THEN (p1 - 1) * a1 ELSE (phi0 - 1) * (a1 + a2) END AS e1,
  CASE WHEN own1 AND own2 THEN s1 ELSE os END AS k1,
  CASE WHEN own1 AND own2 THEN (p2 - 1) * a2 ELSE 0.0 END AS e2, CASE WHEN own1 AND own2 THEN s2 ELSE 2 END AS k2 FROM c3),
c5 AS (SELECT *,
  CASE WHEN e1 <= 1e-9 * v THEN 0.0 WHEN k1 <= 1 THEN CAST('inf' AS DOUBLE) ELSE e1 * e1 / (k1 - 1) END
  + CASE WHEN e2 <= 1e-9 * v THEN 0.0 WHEN k2 <= 1 THEN CAST('inf' AS DOUBLE) ELSE e2 * e2 / (k2 - 1) END AS den FROM c4),
c6 AS (SELECT *, CASE WHEN silent THEN CAST('inf' AS DOUBLE) WHEN cap < 1 OR u1 < 2 OR u2 < 2 THEN 0.0
  ELSE least(CASE WHEN den = 0 THEN CAST('inf' AS DOUBLE) WHEN isinf(den) THEN 0.0 ELSE v * v / den END, CAST(cap AS DOUBLE)) END AS df,
  CASE WHEN silent THEN 1.0 ELSE phi0 END AS phi FROM c5),
c7 AS (SELECT *, n1 <= 0 OR n2 <= 0 AS nodata,
  CASE WHEN NOT silent AND n1 > 0 AND n2 > 0 THEN ln(((x2 + h) / n2) / ((x1 + h) / n1)) END AS lr,
  CASE WHEN NOT silent AND n1 > 0 AND n2 > 0 AND df >= 1 THEN ({QUANTILE.format('df')}) * sqrt(greatest(1.0, phi) * (a1 + a2)) END AS reach
  FROM c6),
judged AS (SELECT *, {r_sql('exp(lr)', 3)} AS ratio, {r_sql('exp(lr - reach)', 3)} AS low, {r_sql('exp(lr + reach)', 3)} AS high,
  CASE WHEN nodata THEN 'no-data' WHEN exp(lr + reach) < 1 THEN 'better' WHEN exp(lr - reach) > 1 THEN 'worse'
    ELSE 'inconclusive' END AS verdict FROM c7)"""


SHOWN_DF = f"CASE WHEN ratio IS NOT NULL AND NOT isinf(df) THEN {r_sql('df', 1)} END"


def judge_sql(base: str, cand: str, sides: str = SIDES) -> str:
    """``base`` and ``cand`` are SQL expressions."""
    return sides + f""",
every_key AS (SELECT DISTINCT scope, key FROM side WHERE cohort IN ({base}, {cand})
  UNION SELECT 'total', 'all'
  UNION SELECT 'plane', unnest(['INFRASTRUCTURE', 'GUARD', 'MODEL_MISUSE']))""" + compare_sql(f"""
SELECT k.scope, k.key, coalesce(b.count, 0) AS x1, coalesce(c.count, 0) AS x2, coalesce(b.phi, 1.0) AS phi1,
  coalesce(c.phi, 1.0) AS phi2, coalesce(b.contributing, 0) AS s1, coalesce(c.contributing, 0) AS s2,
  tb.units AS u1, tc.units AS u2, tb.calls AS n1, tc.calls AS n2
FROM every_key k LEFT JOIN side b ON b.cohort = {base} AND b.scope = k.scope AND b.key = k.key
LEFT JOIN side c ON c.cohort = {cand} AND c.scope = k.scope AND c.key = k.key
JOIN total tb ON tb.cohort = {base} JOIN total tc ON tc.cohort = {cand}""") + f"""
SELECT scope, key, x1 AS baseline_count, x2 AS candidate_count, {per_k('x1', 'n1')} AS baseline_per_k,
  {per_k('x2', 'n2')} AS candidate_per_k, ratio, low, high, verdict, s1 AS baseline_sessions,
  s2 AS candidate_sessions, {r_sql('phi', 2)} AS dispersion, {SHOWN_DF} AS df FROM judged"""


on_tables("judge", judge_sql("'m-large'", "'m-small'"))(
    lambda t: judge.judge(t, "model", "m-large", "m-small"))
# both cohorts chosen: schema has two, the one with more calls is the baseline
MOST_CALLS = "(SELECT cohort FROM total ORDER BY calls DESC, cohort LIMIT 1)"
on_tables("judge_chosen", judge_sql(
    MOST_CALLS, f"(SELECT cohort FROM total WHERE cohort <> {MOST_CALLS})",
    SIDES.replace("s.model", "s.schema")))(lambda t: judge.judge(t, "schema"))


@query("t_quantile", f"""
, d AS (SELECT event_id, 1 + value / 3.0 + k AS df FROM ev)
SELECT event_id, {r_sql(QUANTILE.format('df'), 6)} AS q FROM d""")
def _quantile(spark, sf):
    df = F.lit(1) + F.col("value") / F.lit(3.0) + F.col("k")
    return src.event_rows(spark, sf).select(
        "event_id", round_half_up(stats.t_quantile(df), 6).alias("q"))


# every event as one made-up comparison: small counts reach all branches
@query("spread", compare_sql("""
SELECT event_id, k % 13 AS x1, event_id % 11 AS x2, 1.0 + (event_id % 17) / 4.0 AS phi1, 1.0 + (k % 19) / 8.0 AS phi2,
  least(k % 13, k % 4) AS s1, least(event_id % 11, event_id % 5) AS s2,
  event_id % 6 AS u1, k % 7 AS u2, event_id % 23 AS n1, k % 29 AS n2 FROM ev""") + f"""
SELECT event_id, {r_sql('phi', 6)} AS phi, CASE WHEN isinf(df) THEN -1.0 ELSE {r_sql('df', 6)} END AS df,
  ratio, low, CASE WHEN high < 1e6 THEN high END AS high, verdict FROM judged""")
def _spread(spark, sf):
    k, i = F.col("k"), F.col("event_id")
    b = F.struct((k % 13).alias("count"), (F.lit(1.0) + (i % 17) / F.lit(4.0)).alias("phi"),
                 F.least(k % 13, k % 4).alias("contributing"), (i % 6).alias("units"),
                 (i % 23).alias("calls"))
    c = F.struct((i % 11).alias("count"), (F.lit(1.0) + (k % 19) / F.lit(8.0)).alias("phi"),
                 F.least(i % 11, i % 5).alias("contributing"), (k % 7).alias("units"),
                 (k % 29).alias("calls"))
    rows = src.event_rows(spark, sf).select("event_id", b.alias("b"), c.alias("c"))
    rows = rows.select("event_id", stats.let(F.struct("b", "c"), lambda s: (
        stats.compare_sides(s["b"], s["c"]))).alias("j"))
    df = F.col("j.df")
    return rows.select("event_id", round_half_up(F.col("j.phi"), 6).alias("phi"),
                       F.when(df == F.lit(stats.INFINITE), F.lit(-1.0))
                       .otherwise(round_half_up(F.when(df < 1e300, df), 6)).alias("df"),
                       "j.r.ratio", "j.r.low",
                       # beyond that the last digits are the exp() implementation's
                       F.when(F.col("j.r.high") < 1e6, F.col("j.r.high")).alias("high"), "j.r.verdict")


# --- findings ---------------------------------------------------------------------------------

@on_tables("findings_page", """
SELECT id, session_id, detector, code, confidence, occurred_at FROM finding WHERE plane = 'MODEL_MISUSE'
ORDER BY confidence DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40""")
def _page(t: Tables):
    page, _ = findings.findings_page(t, plane="MODEL_MISUSE", sort="CONFIDENCE:desc", page=2)
    return page.select("id", "session_id", "detector", "code", "confidence", "occurred_at")


SORTS = [f"{key}:{way}" for key in findings.SORT_COLUMNS for way in ("asc", "desc")]


def _following_sql(sort: str) -> str:
    key, way = sort.split(":")
    order = f"{findings.SORT_COLUMNS[key]} {way} NULLS {'FIRST' if way == 'asc' else 'LAST'}, id {way}"
    return f"""(SELECT '{sort}' AS sort, id FROM finding ORDER BY {order} LIMIT 20 OFFSET 20)"""


@on_tables("findings_following", "\n" + " UNION ALL ".join(map(_following_sql, SORTS)))
def _following(t: Tables):
    """The second page under each of the twelve orders, sought from the last row of the first."""
    pages = []
    for sort in SORTS:
        last = findings.page_end(findings.findings_page(t, sort=sort)[0], sort)
        if last is not None:
            page, _ = findings.findings_page(t, sort=sort, after=last)
            pages.append(page.select(F.lit(sort).alias("sort"), "id"))
    return reduce(DataFrame.unionByName, pages) if pages else \
        t.findings.select(F.lit("").alias("sort"), "id").where("false")


on_tables("findings_total", "SELECT count(*) AS total FROM finding WHERE detector = 'edit-miss'")(
    lambda t: findings.findings_page(t, detector="edit-miss")[1])

DETAIL = f"""
SELECT f.id, f.detector, f.seq, c.name AS tool,
  coalesce(string_agg(e.seq || ':' || e.verb_class || ':' || e.path_hint || ':' || e.excerpt_redacted, ';'), '') AS evidence
FROM finding f LEFT JOIN tool_call c ON c.session_id = f.session_id AND c.source_file = f.source_file AND c.seq = f.seq
LEFT JOIN shell_evidence e ON e.finding_id = f.id GROUP BY f.id, f.detector, f.seq, c.name"""


@on_tables("finding_detail", DETAIL)
def _detail(t: Tables):
    shown = F.transform("evidence", lambda e: F.concat_ws(
        ":", e["seq"].cast("string"), e["verb_class"], e["path_hint"], e["excerpt_redacted"]))
    return findings.finding_detail(t).select(
        "id", "detector", "seq", "tool", F.array_join(shown, ";").alias("evidence"))


SAME = "c.session_id = f.session_id AND c.source_file = f.source_file"
ANCHOR = f""", anchored AS (SELECT f.*, coalesce(f.seq, (SELECT max(c.seq) FROM tool_call c
    WHERE {SAME} AND c.started_at <= f.occurred_at)) AS anchor FROM finding f)"""
on_tables("finding_anchor", ANCHOR + "\nSELECT id, anchor FROM anchored")(
    lambda t: findings.anchor_seq(t.findings, t.calls).select("id", "anchor"))

CONTEXT = ANCHOR + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_file ORDER BY seq) AS n FROM tool_call),
placed AS (SELECT f.*, (SELECT count(*) FROM tool_call c WHERE {SAME} AND c.seq <= f.anchor) AS upto
  FROM anchored f WHERE f.anchor IS NOT NULL),
context AS (SELECT f.id, f.session_id, f.source_file, f.anchor, c.seq, c.name, c.error_code,
    CASE WHEN c.seq = f.seq THEN 'finding' WHEN c.seq = f.cause_seq THEN 'cause' WHEN c.seq = f.stale_seq THEN 'stale' END AS mark
  FROM placed f JOIN numbered c ON {SAME} AND c.n BETWEEN f.upto - 3 AND f.upto + 3)"""
on_tables("finding_context", CONTEXT
          + "\nSELECT id, anchor, seq, name, error_code, mark FROM context")(
    lambda t: findings.finding_context(t.findings, t.calls, window=3).select(
        "id", "anchor", "seq", "name", "error_code", "mark"))

on_tables("neighbours", CONTEXT + """,
span AS (SELECT id, session_id, source_file, min(seq) AS a, max(seq) AS z FROM context GROUP BY 1, 2, 3)
SELECT s.id, f.id AS n_id, f.seq AS n_seq FROM span s
JOIN finding f ON f.session_id = s.session_id AND f.source_file = s.source_file AND f.seq BETWEEN s.a AND s.z
UNION SELECT id, id, seq FROM finding""")(
    lambda t: findings.neighbours(t.findings, t.calls, window=3).select("id", "n_id", "n_seq"))

on_tables("neighbour_spans", CONTEXT + """,
span AS (SELECT id, session_id, source_file, min(seq) AS a, max(seq) AS z FROM context GROUP BY 1, 2, 3),
filed AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_file ORDER BY seq, id) AS place
  FROM finding WHERE seq IS NOT NULL)
SELECT s.id, count(f.id) AS n, min(f.place) AS first_place, max(f.place) AS last_place FROM span s
LEFT JOIN filed f ON f.session_id = s.session_id AND f.source_file = s.source_file AND f.seq BETWEEN s.a AND s.z
GROUP BY s.id""")(lambda t: _spans(t))


def _spans(t: Tables):
    spans = findings.neighbour_spans(findings.ladder(t.findings, t.calls), window=3)
    some = F.col("last") >= F.col("first")
    return spans.select("id", F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)).alias("n"),
                        F.when(some, F.col("first")).alias("first_place"), F.when(some, F.col("last")).alias("last_place"))


on_tables("tool_at", f"""
SELECT f.id, c.name AS tool FROM finding f LEFT JOIN tool_call c ON {SAME} AND c.seq = f.seq
""")(lambda t: findings.tool_at(t.findings, t.calls).select("id", "tool"))

# --- attribution and lookups ------------------------------------------------------------------

on_tables("version_asof", """
SELECT session_id, source_file, started_at, harness_version, version_inferred FROM session""")(
    lambda t: t.sessions.select(*STREAM, "started_at", "harness_version", "version_inferred"))
on_tables("role", "SELECT session_id, source_file, delegation_depth, role FROM session")(
    lambda t: t.sessions.select(*STREAM, "delegation_depth", "role"))
on_tables("day_bucket", "SELECT session_id, seq, day FROM tool_call")(
    lambda t: t.calls.select("session_id", "seq", "day"))
on_tables("plane_lookup", """
SELECT error_code, plane, count(*) AS count FROM tool_call GROUP BY error_code, plane""")(
    lambda t: t.calls.groupBy("error_code", "plane").agg(F.count(F.lit(1)).alias("count")))


@query("unmapped_codes", f"""
SELECT DISTINCT err AS code FROM ev WHERE event_type = 'error' AND err = 'E_UNLISTED'""")
def _unmapped(spark, sf):
    t = src.stored_tables(spark, sf)
    errors = t.calls.select(F.col("error_code").alias("code"))
    return facts.unmapped_codes(errors, code_planes_df(spark))


@query("path_hint", """
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'src/a' || k || '.ts' WHEN k % 4 = 1 THEN 'b' || k || '.ts'
  WHEN k % 4 = 2 THEN NULL ELSE 'plain' || k END AS hint FROM ev""")
def _hint(spark, sf):
    k = F.col("k").cast("string")
    path = src.pick(F.col("k"), [0, 1, 2, 3])
    path = (F.when(path == 0, F.concat(F.lit("/w/p/src/a"), k, F.lit(".ts")))
            .when(path == 1, F.concat(F.lit("/home/x/b"), k, F.lit(".ts")))
            .when(path == 2, F.lit("  ")).otherwise(F.concat(F.lit("plain"), k)))
    root = src.pick(F.col("event_id"), ["/w/p", "/w/p/"])
    return src.event_rows(spark, sf).select("event_id", tx.path_hint(path, root).alias("hint"))


# --- sinks ------------------------------------------------------------------------------------

@on_tables("prune", """
SELECT f.session_id, f.source_file, count(*) AS findings FROM finding f
WHERE EXISTS (SELECT 1 FROM session s WHERE s.session_id = f.session_id AND s.source_file = f.source_file
  AND s.schema = 'V0') GROUP BY 1, 2""")
def _prune(t: Tables):
    left = sinks.prune(t, t.sessions.where("schema = 'V0'"))
    return left.findings.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("findings"))


@on_tables("replace_stream", """
SELECT session_id, source_file, seq, CASE WHEN source_file = 'session.jsonl.zstd' THEN 'again' ELSE name END AS name
FROM tool_call""")
def _replace(t: Tables):
    written = t.calls.where("source_file = 'session.jsonl.zstd'").withColumn("name", F.lit("again"))
    streams = t.sessions.where("schema = 'V0'")
    return sinks.replace_streams(t.calls, written, streams).select(*STREAM, "seq", "name")


on_tables("run_summary", """
SELECT (SELECT count(*) FROM session) AS streams, (SELECT count(DISTINCT session_id) FROM session) AS sessions,
  (SELECT count(*) FROM step) AS steps, (SELECT count(*) FROM tool_call) AS tool_calls,
  (SELECT count(*) FROM finding) AS findings, (SELECT count(*) FROM shell_evidence) AS evidence_rows,
  (SELECT count(*) FROM session WHERE schema = 'V3') AS pruned, CAST(0 AS BIGINT) AS parse_failures""")(
    lambda t: sinks.run_summary(t, pruned=sinks.pruned_streams(
        t.sessions, t.sessions.where("schema = 'V0'"))))

on_tables("snapshot", """
SELECT section, n FROM (
  SELECT 'tiles' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'plane_mix', 3
  UNION ALL SELECT 'code_tail', 1 UNION ALL SELECT 'findings_total', 1 UNION ALL SELECT 'recent_findings', 50
  UNION ALL SELECT 'top_detectors', count(DISTINCT detector) FROM finding
  UNION ALL SELECT 'top_codes', least(8, count(DISTINCT code)) FROM finding
  UNION ALL SELECT 'series', count(DISTINCT day) FROM (SELECT day FROM finding UNION SELECT day FROM observed)
  UNION ALL SELECT 'throughput', count(*) FROM (SELECT DISTINCT source_file, timing_source FROM step)
  UNION ALL SELECT 'breakdown', count(*) FROM (SELECT DISTINCT detector, plane, category, code, detail FROM finding)
  UNION ALL SELECT 'vocabulary', (SELECT count(DISTINCT schema) + count(DISTINCT coalesce(model, '?')) + count(DISTINCT coalesce(agent_preset, '?'))
    + count(DISTINCT harness_version) + count(DISTINCT coalesce(provider, '?')) + count(DISTINCT coalesce(role, '?')) FROM session)
    + (SELECT count(DISTINCT coalesce(code, '?')) + count(DISTINCT detector) FROM finding)
  UNION ALL SELECT 'cohorts.' || a.axis, a.n FROM (
    SELECT 'harnessVersion' AS axis, count(DISTINCT harness_version) AS n FROM session
    UNION ALL SELECT 'model', count(DISTINCT coalesce(model, '?')) FROM session
    UNION ALL SELECT 'provider', count(DISTINCT coalesce(provider, '?')) FROM session
    UNION ALL SELECT 'role', count(DISTINCT coalesce(role, '?')) FROM session) a
  UNION ALL SELECT 'cohorts.' || axis || '.basis', 1 FROM (VALUES ('harnessVersion'), ('model'), ('provider'), ('role')) v(axis)
  UNION ALL SELECT 'judge', 4 + count(DISTINCT coalesce(code, detector)) FROM finding)""")(
    lambda t: report.report_rows(t, "schema", "V0", "V3").groupBy("section")
    .agg(F.count(F.lit(1)).alias("n")))
