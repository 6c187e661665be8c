"""Queries over the event-log view: parsing, folds, command classification, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.catalog.sql import CALLS, LOG, PLANE
from sessionlens.catalog.stored import r_sql
from sessionlens.functions.text import round_half_up
from sessionlens.operators import commands, detectors, facts
from sessionlens.operators.detectors import Facts
from sessionlens.plans.index import derive_facts, hold_facts
from sessionlens.schema import STREAM
from sessionlens.session import materialise
from sessionlens.sources import logs
from sessionlens.sources import tables as src

QUERIES: dict = {}


def on_log(name: str, sql: str | None = None, prefix: str = CALLS):
    def add(fn):
        QUERIES[name] = (lambda spark, sf: fn(src.event_log(spark, sf)),
                         None if sql is None else f"WITH {prefix}\n{sql}")
        return fn
    return add


def on_facts(name: str, sql: str | None = None, prefix: str = CALLS):
    def add(fn):
        on_log(name, sql, prefix)(lambda log: fn(derive_facts(log)))
        return fn
    return add


def on_held_facts(*tables: str):
    """For operators that read these tables more than once: events and tables are written first,
    as an index run does."""
    def on_held(name: str, sql: str | None = None, prefix: str = CALLS):
        def add(fn):
            on_log(name, sql, prefix)(lambda log: fn(
                hold_facts(derive_facts(materialise(log, "events")), tables=tables)))
            return fn
        return add
    return on_held


# --- lines and parsing ------------------------------------------------------------------------

@on_log("parse_events", """
SELECT type, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, CAST(sum(time) AS BIGINT) AS times,
  CAST(sum(turn) AS BIGINT) AS turns, count(step) AS steps, count(arg_path) AS paths,
  count(*) FILTER (arg_partial) AS partial, count(*) FILTER (type = 'tool/call' AND name = 'bash') AS commands,
  count(error_code) AS codes, count(meta_path) AS metas, count(call_id) AS ids,
  count(*) FILTER (type = 'assistant/message' AND k % 4 <> 0) AS windows,
  count(*) FILTER (type = 'turn/end' AND k % 4 IN (0, 2)) AS details
FROM ev_log WHERE pos % 97 <> 0 GROUP BY type""", LOG)
def _parse(log):
    # the lines are written as the log files would be, the parse as an index run does: left lazy,
    # each reference to a line would render it again and a filter on the parse would parse again
    lines = materialise(src.log_lines(log), "lines")
    parsed = logs.good_events(materialise(logs.parse_events(lines), "events"))

    def filled(column: str):
        return F.count(column)

    return parsed.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"), F.sum("time").alias("times"),
        F.sum("turn").cast("bigint").alias("turns"), filled("step").alias("steps"),
        filled("arg_path").alias("paths"), F.count_if("arg_partial").alias("partial"),
        filled("command").alias("commands"), filled("error_code").alias("codes"),
        filled("meta_path").alias("metas"), filled("call_id").alias("ids"),
        filled("stream_last").alias("windows"), filled("fatal_detail").alias("details"))


on_log("bad_lines", """
SELECT session_id, source_file, count(*) FILTER (pos % 97 = 0) AS bad_lines FROM ev_log GROUP BY 1, 2""",
       LOG)(lambda log: logs.bad_lines(logs.parse_events(src.log_lines(log))))


# --- sessions and steps -----------------------------------------------------------------------

on_log("session_header", """
SELECT l.session_id, l.source_file,
  CASE WHEN h.pos IS NULL THEN 1 WHEN h.k % 3 <> 0 THEN h.ms - 1000 ELSE h.ms END AS started_at,
  (SELECT max(time) FROM ev_log e WHERE e.user_id = l.user_id) AS ended_at,
  CASE h.k % 3 WHEN 0 THEN 'builder' WHEN 1 THEN 'planner' END AS agent_preset,
  CASE WHEN h.k % 4 > 0 THEN h.k % 4 - 1 END AS delegation_depth,
  CASE h.k % 4 WHEN 1 THEN 'orchestrator' WHEN 2 THEN 'subagent' WHEN 3 THEN 'subagent' END AS role,
  CASE c.k % 3 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-small' END AS model,
  CASE c.k % 2 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' END AS provider,
  CASE WHEN c.k % 5 <> 0 THEN c.k * 1000 END AS context_window,
  (SELECT CAST(count(*) AS INTEGER) FROM ev_log e WHERE e.user_id = l.user_id AND e.type = 'turn/end' AND e.k % 2 = 0) AS fatal_turns
FROM (SELECT user_id, session_id, source_file, max(CASE WHEN type = 'session' THEN pos END) AS hp,
        max(CASE WHEN type = 'request/context' THEN pos END) AS cp FROM ev_log GROUP BY 1, 2, 3) l
LEFT JOIN ev_log h ON h.pos = l.hp LEFT JOIN ev_log c ON c.pos = l.cp""", LOG)(
    lambda log: facts.session_header(log).select(
        *STREAM, "started_at", "ended_at", "agent_preset", "delegation_depth", "role", "model",
        "provider", "context_window", "fatal_turns"))

STEPS = LOG + """,
sl AS (SELECT *, coalesce(turn, 0) AS t, coalesce(step, 0) AS s FROM ev_log
  WHERE type IN ('step/start', 'assistant/chunk', 'assistant/message', 'step/end')),
marked AS (SELECT *, max(CASE WHEN type <> 'assistant/chunk' THEN pos END) OVER (
    PARTITION BY session_id, source_file, t, s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bp FROM sl),
opened AS (SELECT m.*, b.type AS btype, b.time AS btime FROM marked m LEFT JOIN sl b ON b.pos = m.bp),
chunks AS (SELECT session_id, source_file, t, s, bp, arg_min(time, pos) AS first, arg_max(time, pos) AS last
  FROM opened WHERE type = 'assistant/chunk' AND btype = 'step/start' GROUP BY 1, 2, 3, 4, 5),
msg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_file, t, s ORDER BY pos DESC) AS rn
  FROM opened WHERE type = 'assistant/message') WHERE rn = 1),
last_bound AS (SELECT session_id, source_file, t, s, arg_max(type, pos) AS type, arg_max(time, pos) AS time
  FROM sl WHERE type <> 'assistant/chunk' GROUP BY 1, 2, 3, 4),
ends AS (SELECT session_id, source_file, t, s, max(pos) AS pos, arg_max(time, pos) AS time
  FROM sl WHERE type = 'step/end' GROUP BY 1, 2, 3, 4),
closed AS (SELECT m.*, CASE WHEN m.btype = 'step/start' THEN m.btime ELSE m.time END AS start,
    c.first IS NOT NULL AS chunked, m.k % 4 <> 0 AS embedded,
    CASE WHEN c.first IS NOT NULL THEN c.first WHEN m.k % 4 <> 0 THEN m.ms - 4000 END AS first,
    CASE WHEN c.first IS NOT NULL THEN c.last WHEN m.k % 4 <> 0 THEN m.ms - 1000 - m.k END AS last,
    CASE WHEN m.k % 10 = 0 THEN 0 ELSE m.k * 3 END AS out,
    CASE WHEN e.pos > m.pos THEN e.time END AS ended
  FROM msg m LEFT JOIN chunks c ON c.session_id = m.session_id AND c.source_file = m.source_file AND c.t = m.t AND c.s = m.s AND c.bp = m.bp
  LEFT JOIN ends e ON e.session_id = m.session_id AND e.source_file = m.source_file AND e.t = m.t AND e.s = m.s),
steps AS (
  SELECT session_id, source_file, t AS turn, s AS step, start AS started_at, ended AS ended_at, k AS input_tokens,
    nullif(out, 0) AS output_tokens,
    CASE WHEN last > first AND out > 0 THEN out / ((last - first) / 1000.0) END AS tps,
    CASE WHEN last > first AND out > 0 AND first >= start THEN CAST(first - start AS INTEGER) END AS ttft_ms,
    CASE WHEN chunked THEN 'chunk-events' WHEN embedded THEN 'embedded-stream' ELSE 'none' END AS timing_source
  FROM closed
  UNION ALL
  SELECT l.session_id, l.source_file, l.t, l.s, l.time, NULL, NULL, NULL, NULL, NULL, 'none' FROM last_bound l
  WHERE l.type = 'step/start' AND NOT EXISTS (SELECT 1 FROM msg m WHERE m.session_id = l.session_id
    AND m.source_file = l.source_file AND m.t = l.t AND m.s = l.s))"""

on_log("step_assembly", f"""
SELECT session_id, source_file, turn, step, started_at, ended_at, input_tokens, output_tokens,
  {r_sql('tps', 3)} AS decode_tps, ttft_ms, timing_source FROM steps""", STEPS)(
    # the column is an INTEGER here; the operator's own is a long and holds any wait
    lambda log: facts.assemble_steps(log).withColumns({
        "decode_tps": round_half_up(F.col("decode_tps"), 3), "ttft_ms": F.col("ttft_ms").try_cast("int")}))

on_log("chunk_window", """
SELECT session_id, source_file, t AS turn, s AS step, bp AS opened_pos, first AS chunk_first, last AS chunk_last
FROM chunks""", STEPS)(
    lambda log: facts.step_epochs(log)
    .where(F.col("opened_open") & F.col("chunk_first").isNotNull())
    .select(*STREAM, "turn", "step", "opened_pos", "chunk_first", "chunk_last"))

# --- calls ------------------------------------------------------------------------------------

CALL_COLUMNS = ["turn", "step", "seq", "name", "started_at", "ended_at", "duration_ms",
                "error_code", "abs_path", "outcome_only"]
_CALL_SQL = "SELECT session_id, source_file, " + ", ".join(CALL_COLUMNS) + " FROM calls"

on_log("call_result_pairs", _CALL_SQL)(
    lambda log: facts.pair_calls(log).select(*STREAM, *CALL_COLUMNS))
on_log("orphans", _CALL_SQL + " WHERE outcome_only")(
    lambda log: facts.pair_calls(log).where("outcome_only").select(*STREAM, *CALL_COLUMNS))
on_log("unanswered", _CALL_SQL + " WHERE ended_at IS NULL")(
    lambda log: facts.pair_calls(log).where("ended_at is null").select(*STREAM, *CALL_COLUMNS))


@on_log("dedupe_seq", """
SELECT session_id, source_file, seq, at_pos, name, error_code FROM (
  SELECT session_id, source_file, seq // 8 AS seq, at_pos, name, error_code,
    row_number() OVER (PARTITION BY session_id, source_file, seq // 8 ORDER BY late, at_pos) AS rn FROM calls) WHERE rn = 1""")
def _dedupe(log):
    repeated = facts.pair_calls(log).withColumn("seq", F.floor(F.col("seq") / F.lit(8)))
    return facts.first_per_seq(repeated).select(
        *STREAM, "seq", F.col("rank.at").alias("at_pos"), "name", "error_code")


on_log("tool_call_rows", f"""
SELECT session_id, source_file, seq, error_code, {PLANE.format('error_code')} AS plane,
  CASE WHEN EXISTS (SELECT 1 FROM ev_log h WHERE h.type = 'session' AND h.session_id = c.session_id AND h.source_file = c.source_file)
    THEN substr(abs_path, 7) ELSE substr(abs_path, 11) END AS path_hint,
  strftime(make_timestamp(started_at * 1000), '%Y-%m-%d') AS day FROM calls c""")(
    lambda log: facts.tool_call_table(facts.pair_calls(log), facts.session_header(log)).select(
        *STREAM, "seq", "error_code", "plane", "path_hint", "day"))

on_facts("error_events", "SELECT * FROM errors")(lambda f: f.errors)
on_facts("file_touches", "SELECT * FROM touches")(
    lambda f: f.touches.select(*STREAM, "seq", "abs_path", "op", "partial"))
on_facts("retry_events", """
SELECT session_id, source_file, seq, coalesce(turn, 0) AS turn, coalesce(step, 0) AS step,
  CASE k % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'SERVER' WHEN 2 THEN 'TRANSPORT' END AS code, time AS occurred_at
FROM ev_log WHERE type = 'llm/retry'""", LOG)(lambda f: f.retries.drop("pos"))

FATAL = """SELECT session_id, source_file, coalesce(turn, 0) AS turn,
  CASE k % 3 WHEN 0 THEN 'SERVER' WHEN 2 THEN 'INVALID_REQUEST' END AS code,
  CASE k % 4 WHEN 0 THEN 'a_detail' WHEN 2 THEN 'b_detail' END AS detail, time AS occurred_at
FROM ev_log WHERE type = 'turn/end' AND k % 2 = 0"""
on_facts("fatal_turns", FATAL, LOG)(lambda f: f.fatal_turns.drop("pos"))

# --- commands ---------------------------------------------------------------------------------

COMMAND_FACTS = CALLS + """,
known AS (SELECT *, CASE kind WHEN 1 THEN 'VCS_RESTORE' WHEN 2 THEN 'READ_ONLY' WHEN 3 THEN 'OTHER'
    WHEN 10 THEN 'READ_ONLY' ELSE 'MUTATING' END AS verb_class,
  CASE kind WHEN 0 THEN 'IN_PLACE' WHEN 4 THEN 'REDIRECT' WHEN 5 THEN 'TEE' WHEN 6 THEN 'SCRIPT' WHEN 7 THEN 'FILE_OP'
    WHEN 8 THEN 'CONTENT_TOOL' WHEN 9 THEN 'SCRIPT' WHEN 11 THEN 'REDIRECT' END AS write_kind,
  CASE kind WHEN 0 THEN p WHEN 4 THEN 'src/' || base WHEN 5 THEN base WHEN 6 THEN p WHEN 8 THEN './src/' || base
    WHEN 11 THEN '/other/' || base ELSE '' END AS target,
  CASE kind WHEN 0 THEN '/a/b,' || p WHEN 1 THEN '/' || base || ',src/' || base WHEN 2 THEN p
    WHEN 3 THEN '/run.mjs,tools/run.mjs' WHEN 4 THEN '/' || base || ',src/' || base WHEN 5 THEN base WHEN 6 THEN p
    WHEN 7 THEN p || ',' || p || '.bak' WHEN 8 THEN '/src/' || base || ',./src/' || base
    WHEN 9 THEN '/' || base || ',src/' || base WHEN 10 THEN '/' || base || ',src/' || base
    ELSE '/other/' || base END AS referenced
  FROM commands)"""

on_facts("command_facts", """
SELECT session_id, source_file, seq, verb_class, write_kind, target,
  CASE WHEN target = '' THEN '' ELSE write_kind END AS target_kind, referenced FROM known""", COMMAND_FACTS)(
    lambda f: f.commands.select(
        *STREAM, "seq", "verb_class", "write_kind",
        F.array_join(F.transform("targets", lambda t: t["path"]), ",").alias("target"),
        F.array_join(F.transform("targets", lambda t: t["kind"]), ",").alias("target_kind"),
        F.array_join("referenced", ",").alias("referenced")))

on_log("command_kinds", """
SELECT verb_class, write_kind, count(*) AS count FROM known GROUP BY 1, 2""", COMMAND_FACTS)(
    lambda log: commands.classify(commands.shell_commands(log))
    .groupBy("verb_class", "write_kind").agg(F.count(F.lit(1)).alias("count")))

# --- detectors --------------------------------------------------------------------------------

SHOWN = ["plane", "category", "code", "detail", "confidence", "seq", "stale_seq", "cause_seq",
         "occurred_at", "summary"]


def on_detector(name: str, sql: str | None, prefix: str = CALLS, facts_of=on_facts):
    def add(fn):
        def run(f: Facts):
            return fn(f).select(*STREAM, *SHOWN)
        facts_of(name, sql, prefix)(run)
        return fn
    return add


NULLS = {"category": "NULL::VARCHAR", "code": "NULL::VARCHAR", "detail": "NULL::VARCHAR",
         "confidence": "NULL::DOUBLE", "seq": "NULL::BIGINT", "stale_seq": "NULL::BIGINT",
         "cause_seq": "NULL::BIGINT"}


def finding_sql(source: str, **given: str) -> str:
    cols = ", ".join(f"{given.get(c, NULLS.get(c))} AS {c}" for c in SHOWN)
    return f"SELECT session_id, source_file, {cols} FROM {source}"


ERROR_PLANE = finding_sql(
    "errors WHERE code NOT IN ('FS_STALE_VERSION', 'FS_EDIT_NOT_FOUND')",
    plane=PLANE.format("code"), code="code", seq="seq", occurred_at="occurred_at",
    summary="coalesce(tool, 'tool') || ' returned ' || code")
OWNED = frozenset({detectors.STALE, detectors.MISS})
on_detector("error_plane", ERROR_PLANE)(lambda f: detectors.error_plane(f, OWNED))

FATAL_TURN = finding_sql(
    f"({FATAL})", plane="'INFRASTRUCTURE'", code="code", detail="detail", occurred_at="occurred_at",
    summary="""'turn ' || turn || ' ended in error' || CASE WHEN code IS NULL AND detail IS NULL THEN ''
      WHEN detail IS NULL THEN ': ' || code ELSE ': ' || coalesce(code || ' ', '') || '(' || detail || ')' END""")
on_detector("fatal_turn", FATAL_TURN, LOG)(detectors.fatal_turn)

STORMS = """(SELECT session_id, source_file, count(*) AS n, arg_max(time, pos) AS at_time, arg_max(pos, pos) AS last_seq,
    max(pos) AS lp FROM ev_log WHERE type = 'llm/retry' GROUP BY session_id, source_file, coalesce(turn, 0), coalesce(step, 0)
    HAVING count(*) >= 2) g JOIN (SELECT pos, CASE k % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'SERVER' WHEN 2 THEN 'TRANSPORT' END AS rc
      FROM ev_log) r ON r.pos = g.lp"""
RETRY_STORM = finding_sql(
    STORMS, plane="'INFRASTRUCTURE'", code="rc", seq="last_seq", occurred_at="at_time",
    summary="'step exhausted its retry budget (' || n || ' retries, last ' || coalesce(rc, 'null') || ')'")
on_detector("retry_storm", RETRY_STORM, LOG)(detectors.retry_storm)

MISSES = CALLS + """,
missed AS (SELECT e.*, (SELECT max(c.seq) FROM calls c WHERE c.session_id = e.session_id AND c.source_file = e.source_file
    AND c.abs_path = e.abs_path AND c.seq < e.seq AND c.name IN ('read', 'write', 'edit')
    AND (c.error_code IS NULL OR c.error_code = 'FS_EDIT_NOT_FOUND')) AS prev FROM errors e WHERE e.code = 'FS_EDIT_NOT_FOUND'),
miss AS (SELECT m.*, c.name AS pname, CASE WHEN prev IS NULL THEN 'MISS_UNREAD'
    WHEN c.error_code = 'FS_EDIT_NOT_FOUND' THEN 'REPEATED_MISS'
    WHEN c.name = 'read' THEN CASE WHEN EXISTS (SELECT 1 FROM touches t WHERE t.session_id = m.session_id
      AND t.source_file = m.source_file AND t.seq = prev AND t.partial) THEN 'MISS_AFTER_PARTIAL_READ' ELSE 'MISS_AFTER_READ' END
    ELSE 'MISS_AFTER_EDIT' END AS cat, coalesce(regexp_extract(m.abs_path, '[^/]*$'), '(no path)') AS file
  FROM missed m LEFT JOIN calls c ON c.session_id = m.session_id AND c.source_file = m.source_file AND c.seq = m.prev)"""
EDIT_MISS = finding_sql(
    "miss", plane="'MODEL_MISUSE'", category="cat", code="code", confidence="CAST(0.9 AS DOUBLE)",
    seq="seq", cause_seq="prev", occurred_at="occurred_at",
    summary="""file || ': edit found no match' || CASE cat
      WHEN 'REPEATED_MISS' THEN ' again; the previous miss at seq ' || prev || ' was retried without a read'
      WHEN 'MISS_AFTER_EDIT' THEN '; the model''s own ' || pname || ' at seq ' || prev || ' had already changed the file'
      WHEN 'MISS_AFTER_READ' THEN ' although the file was read at seq ' || prev
      WHEN 'MISS_AFTER_PARTIAL_READ' THEN '; the read at seq ' || prev || ' covered only part of the file'
      ELSE '; nothing in this stream had read the file' END""")
on_detector("edit_miss", EDIT_MISS, MISSES, on_held_facts("calls"))(detectors.edit_miss)

STAMPS = CALLS + """,
staled AS (SELECT e.*, regexp_extract(e.abs_path, '[^/]*$') AS base, (SELECT max(t.seq) FROM touches t
    WHERE t.session_id = e.session_id AND t.source_file = e.source_file AND t.abs_path = e.abs_path AND t.seq < e.seq) AS stale
  FROM errors e WHERE e.code = 'FS_STALE_VERSION'),
caused AS (SELECT s.*, (SELECT min(c.seq) FROM commands c WHERE c.session_id = s.session_id AND c.source_file = s.source_file
      AND c.base = s.base AND c.seq > s.stale AND c.seq < s.seq AND c.kind IN (0, 1, 4, 5, 6, 7, 8, 9, 11)) AS cause,
    (SELECT min(c.seq) FROM commands c WHERE c.session_id = s.session_id AND c.source_file = s.source_file
      AND c.base = s.base AND c.seq > s.stale AND c.seq < s.seq AND c.kind <> 3) AS mention
  FROM staled s),
stamp AS (SELECT s.*, c.kind, c.kind IN (0, 6, 7) AS absolute, t.op FROM caused s
  LEFT JOIN commands c ON c.seq = s.cause LEFT JOIN touches t ON t.seq = s.stale)"""
STAMP_GUARD = finding_sql(
    "stamp", plane="'GUARD'", category="CASE WHEN kind = 1 THEN 'VCS_RESTORE' WHEN cause IS NOT NULL THEN 'DIRECT_MUTATION' ELSE 'EXTERNAL' END",
    code="code", confidence="CAST(CASE WHEN kind = 1 OR absolute THEN 0.9 WHEN cause IS NOT NULL THEN 0.6 END AS DOUBLE)",
    seq="seq", stale_seq="stale", cause_seq="cause", occurred_at="occurred_at",
    summary="""coalesce(base, '') || ' refused: stamp stale' || CASE
      WHEN kind = 1 THEN ' since seq ' || stale || '; a version-control restore at seq ' || cause || ' is legitimate work the stamp cannot know about'
      WHEN cause IS NOT NULL THEN ' since seq ' || stale || ' (' || op || '); consistent with a mutating command at seq ' || cause
        || ' (' || CASE WHEN absolute THEN 'absolute' ELSE 'basename' END || ' path match)'
      WHEN stale IS NULL THEN ' (stale touch not derivable); no prior file-tool operation on this path'
      WHEN mention IS NOT NULL THEN ' since seq ' || stale || '; in-window mention at seq ' || mention || ' is not a mutation'
      ELSE ' since seq ' || stale || '; no shell command in the window referenced this path' END""")
on_detector("stamp_guard", STAMP_GUARD, STAMPS, on_held_facts("calls", "commands"))(detectors.stamp_guard)

EDITS = CALLS + """,
edited AS (SELECT c.*, (SELECT max(t.seq) FROM touches t WHERE t.session_id = c.session_id AND t.source_file = c.source_file
      AND t.abs_path = c.p AND t.seq < c.seq AND NOT EXISTS (SELECT 1 FROM calls x WHERE x.session_id = t.session_id
        AND x.source_file = t.source_file AND x.seq = t.seq AND x.error_code IS NOT NULL)) AS touch,
    CASE kind WHEN 0 THEN 'IN_PLACE' WHEN 4 THEN 'REDIRECT' WHEN 5 THEN 'TEE' WHEN 8 THEN 'CONTENT_TOOL' ELSE 'SCRIPT' END AS form
  FROM commands c WHERE kind IN (0, 4, 5, 6, 8, 9)),
shown AS (SELECT e.*, coalesce((SELECT min(x.started_at) FROM calls x WHERE x.seq = e.seq), s.start) AS at_time
  FROM edited e LEFT JOIN (SELECT l.session_id, l.source_file, CASE WHEN h.pos IS NULL THEN 1 WHEN h.k % 3 <> 0 THEN h.ms - 1000 ELSE h.ms END AS start
    FROM (SELECT session_id, source_file, max(CASE WHEN type = 'session' THEN pos END) AS hp FROM ev_log GROUP BY 1, 2) l
    LEFT JOIN ev_log h ON h.pos = l.hp) s ON s.session_id = e.session_id AND s.source_file = e.source_file
  WHERE touch IS NOT NULL)"""
SHELL_EDIT = finding_sql(
    "shown", plane="'MODEL_MISUSE'", category="'DIRECT_MUTATION'", detail="form",
    confidence="CAST(CASE WHEN kind IN (5, 9) THEN 0.6 ELSE 0.9 END AS DOUBLE)", seq="seq",
    stale_seq="touch", occurred_at="at_time",
    summary="""base || ' rewritten from the shell (' || lower(form) || ') at seq ' || seq
      || '; the file tools had tracked it since seq ' || touch || ' (' || CASE WHEN kind = 5 THEN 'basename' ELSE 'full' END || ' path match)'""")
on_detector("shell_edit", SHELL_EDIT, EDITS, on_held_facts("calls", "commands"))(detectors.shell_edit)

ALL_PREFIX = MISSES + STAMPS[len(CALLS):] + EDITS[len(CALLS):]
UNION = " UNION ALL ".join(
    f"SELECT '{d}' AS detector, plane, category, code, detail, confidence, occurred_at FROM ({sql})"
    for d, sql in (("error-plane", ERROR_PLANE), ("fatal-turn", FATAL_TURN),
                   ("retry-storm", RETRY_STORM), ("edit-miss", EDIT_MISS),
                   ("stamp-guard", STAMP_GUARD), ("shell-edit", SHELL_EDIT)))
KINDS = ["detector", "plane", "category", "code", "detail", "confidence"]


@on_held_facts("calls", "commands")("finding_union", f"""
SELECT {', '.join(KINDS)}, count(*) AS count, CAST(sum(occurred_at) AS BIGINT) AS times FROM ({UNION})
GROUP BY {', '.join(KINDS)}""", ALL_PREFIX)
def _union(f: Facts):
    return detectors.detect_all(f).groupBy(*KINDS).agg(
        F.count(F.lit(1)).alias("count"), F.sum("occurred_at").alias("times"))


on_held_facts("calls", "commands")("evidence_rows", """
SELECT 'stamp-guard' AS detector, CASE WHEN kind = 1 THEN 'VCS_RESTORE' ELSE 'MUTATING' END AS verb_class, count(*) AS count
FROM stamp WHERE cause IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'shell-edit', 'MUTATING', count(*) FROM shown""", ALL_PREFIX)(
    lambda f: detectors.stamp_guard(f).unionByName(detectors.shell_edit(f))
    .select("detector", F.explode("evidence").alias("e"))
    .groupBy("detector", "e.verb_class").agg(F.count(F.lit(1)).alias("count")))


@on_held_facts("calls")("added_detector", f"""
SELECT 'abort-watch' AS detector, 'GUARD' AS plane, code, seq, occurred_at FROM errors WHERE code = 'ABORTED'
UNION ALL SELECT 'error-plane', {PLANE.format("code")}, code, seq, occurred_at FROM errors WHERE code <> 'ABORTED'""")
def _added(f: Facts):
    """A detector of the caller's own takes its code from the one for all errors."""
    def aborted(facts: Facts):
        return detectors.finding_rows(
            facts.errors.where("code = 'ABORTED'"), "abort-watch", plane=F.lit("GUARD"), code=F.col("code"),
            seq=F.col("seq"), occurred_at=F.col("occurred_at"), summary=F.lit("aborted"))

    registry = detectors.register([], detectors.Detector("abort-watch", aborted, frozenset({"ABORTED"})))
    return detectors.detect_all(f, registry).select("detector", "plane", "code", "seq", "occurred_at")
