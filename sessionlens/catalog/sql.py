"""The same two views of ``events`` in plain SQL, as prefixes for the comparison queries."""

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) // 1000 AS ms,
         'u' || CAST(user_id // 2 AS VARCHAR) AS session_id,
         CASE WHEN user_id % 2 = 0 THEN 'session.jsonl.zstd' ELSE 'session.v3.jsonl.zstd' END AS source_file,
         CASE WHEN user_id % 2 = 0 THEN 'V0' ELSE 'V3' END AS schema,
         CASE k % 8 WHEN 0 THEN 'FS_STALE_VERSION' WHEN 1 THEN 'FS_EDIT_NOT_FOUND'
           WHEN 2 THEN 'FS_NOT_FOUND' WHEN 3 THEN 'SEARCH_FAILED'
           WHEN 4 THEN 'WEB_PROVIDER_CREDENTIAL_MISSING' WHEN 5 THEN 'ABORTED'
           WHEN 6 THEN 'E_UNLISTED' END AS err
  FROM events
)"""

PLANE = """CASE WHEN {0} IN ('FS_STALE_VERSION', 'FS_NOT_OBSERVED', 'FS_SANDBOX_DENIED',
    'GOAL_TOOL_AUTHORITY_REQUIRED', 'ASK_ABORTED', 'ABORTED') THEN 'GUARD'
  WHEN {0} IN ('FS_EDIT_NOT_FOUND', 'FS_AMBIGUOUS_EDIT', 'FS_NOT_FOUND', 'INVALID_ARGS',
    'SEARCH_INVALID_PATTERN', 'SEARCH_FAILED', 'FS_NOT_REGULAR_FILE') THEN 'MODEL_MISUSE'
  WHEN {0} IS NOT NULL THEN 'INFRASTRUCTURE' END"""

DAY = "strftime(make_timestamp({0} * 1000), '%Y-%m-%d')"

STORED = EVENTS + f""",
session AS (
  SELECT session_id, source_file, schema, 'p' || CAST(user_id % 5 AS VARCHAR) AS project_slug,
    min(ms) AS started_at, max(ms) AS ended_at,
    CASE user_id % 3 WHEN 0 THEN 'builder' WHEN 1 THEN 'planner' END AS agent_preset,
    CASE user_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS delegation_depth,
    CASE user_id % 4 WHEN 1 THEN 'm-large' WHEN 2 THEN 'm-small' WHEN 3 THEN 'm-large' END AS model,
    CASE user_id % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'local' WHEN 2 THEN 'remote' WHEN 3 THEN 'remote' END AS provider,
    CASE user_id % 4 WHEN 1 THEN 'orchestrator' WHEN 2 THEN 'subagent' WHEN 3 THEN 'orchestrator' END AS role,
    CASE WHEN min(ms) >= 1704132000000 THEN 'v2' WHEN min(ms) >= 1704088800000 THEN 'v1' ELSE 'v0' END AS harness_version,
    TRUE AS version_inferred,
    CAST(count(*) FILTER (event_type = 'signup' AND k % 4 = 1) AS INTEGER) AS fatal_turns
  FROM ev GROUP BY user_id, session_id, source_file, schema
),
tool_call0 AS (
  SELECT session_id, source_file, k % 5 AS turn, k % 3 AS step, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'bash'
      ELSE CASE k % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' ELSE 'write' END END AS name,
    CASE WHEN event_type = 'error' AND k % 10 = 0 THEN NULL ELSE ms END AS started_at,
    ms + CAST(floor(value * 10) AS BIGINT) AS ended_at,
    CASE WHEN event_type = 'error' AND k % 10 = 0 THEN NULL
      ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms,
    CASE WHEN event_type = 'error' THEN err END AS error_code,
    'src/f' || CAST(k % 7 AS VARCHAR) || '.ts' AS path_hint,
    event_type = 'error' AND k % 10 = 0 AS outcome_only
  FROM ev WHERE event_type IN ('view', 'click', 'purchase', 'error')
),
tool_call AS (
  SELECT *, {PLANE.format('error_code')} AS plane, {DAY.format('started_at')} AS day FROM tool_call0
),
finding0 AS (
  SELECT *, event_type = 'signup' AND k % 4 = 0 AS is_edit, event_type = 'signup' AND k % 4 = 1 AS is_fatal,
    CASE WHEN event_type = 'error' THEN err WHEN event_type = 'signup' AND k % 4 = 1 THEN 'SERVER' END AS code
  FROM ev
),
finding1 AS (
  SELECT event_id AS id, session_id, source_file,
    CASE WHEN is_edit THEN 'shell-edit' WHEN is_fatal THEN 'fatal-turn'
      WHEN code = 'FS_STALE_VERSION' THEN 'stamp-guard' WHEN code = 'FS_EDIT_NOT_FOUND' THEN 'edit-miss'
      ELSE 'error-plane' END AS detector,
    CASE WHEN is_edit THEN 'MODEL_MISUSE' ELSE {PLANE.format('code')} END AS plane,
    CASE WHEN is_edit THEN 'DIRECT_MUTATION'
      WHEN code = 'FS_STALE_VERSION' THEN CASE k % 3 WHEN 0 THEN 'DIRECT_MUTATION' WHEN 1 THEN 'VCS_RESTORE' ELSE 'EXTERNAL' END
      WHEN code = 'FS_EDIT_NOT_FOUND' THEN CASE k % 3 WHEN 0 THEN 'REPEATED_MISS' WHEN 1 THEN 'MISS_AFTER_READ' ELSE 'MISS_AFTER_EDIT' END
      END AS category,
    code,
    CASE WHEN is_edit THEN CASE k % 3 WHEN 0 THEN 'REDIRECT' WHEN 1 THEN 'IN_PLACE' ELSE 'SCRIPT' END
      WHEN is_fatal AND k % 3 = 0 THEN 'unavailable_error' END AS detail,
    CASE WHEN is_edit THEN CASE k % 2 WHEN 0 THEN 0.9 ELSE 0.6 END
      WHEN code = 'FS_STALE_VERSION' AND k % 3 < 2 THEN 0.9 WHEN code = 'FS_EDIT_NOT_FOUND' THEN 0.9 END::DOUBLE AS confidence,
    'src/f' || CAST(k % 7 AS VARCHAR) || '.ts' AS path_hint,
    CASE WHEN NOT is_fatal THEN event_id END AS seq,
    CASE WHEN code = 'FS_STALE_VERSION' AND k % 3 < 2 THEN event_id - 40 END AS stale_seq,
    CASE WHEN (code = 'FS_STALE_VERSION' AND k % 3 < 2) OR code = 'FS_EDIT_NOT_FOUND' THEN event_id - 20 END AS cause_seq,
    CASE WHEN event_type = 'error' THEN ms + CAST(floor(value * 10) AS BIGINT) ELSE ms END AS occurred_at,
    'finding ' || CAST(event_id AS VARCHAR) AS summary
  FROM finding0 WHERE is_edit OR code IS NOT NULL
),
finding AS (SELECT *, {DAY.format('occurred_at')} AS day FROM finding1),
step AS (
  SELECT session_id, source_file, event_id AS turn, k % 3 AS step, ms AS started_at, ms + k * 100 AS ended_at,
    k AS input_tokens, nullif(k % 10, 0) AS output_tokens,
    CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN value END AS decode_tps,
    CASE WHEN k % 3 <> 0 AND k % 7 <> 0 THEN k * 10 END AS ttft_ms,
    CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'chunk-events' ELSE 'embedded-stream' END AS timing_source
  FROM ev WHERE event_type IN ('purchase', 'view')
),
shell_evidence AS (
  SELECT event_id AS finding_id, event_id - 20 AS seq,
    CASE k % 2 WHEN 0 THEN 'MUTATING' ELSE 'VCS_RESTORE' END AS verb_class,
    'src/f' || CAST(k % 7 AS VARCHAR) || '.ts' AS path_hint, 'sed -i x f' || CAST(k AS VARCHAR) AS excerpt_redacted
  FROM ev WHERE (event_type = 'signup' AND k % 4 = 0) OR (event_type = 'error' AND k % 8 = 0 AND k % 3 < 2)
),
observed AS (SELECT * FROM tool_call WHERE NOT outcome_only)"""

LOG = EVENTS + """,
lines AS (
  SELECT ev.*, line, event_id * 2 + line AS pos, event_id * 2 + line AS seq, ms AS time,
    CASE WHEN line = 0 THEN CASE event_type WHEN 'signup' THEN 'step/start' WHEN 'view' THEN 'assistant/chunk'
        WHEN 'purchase' THEN 'assistant/message' WHEN 'click' THEN 'tool/call' ELSE 'tool/result' END
      ELSE CASE event_id % 7 WHEN 0 THEN 'step/end' WHEN 1 THEN 'llm/retry' WHEN 2 THEN 'turn/end'
        WHEN 3 THEN 'session' WHEN 4 THEN 'request/context' ELSE 'tool/call' END END AS type
  FROM ev CROSS JOIN (VALUES (0), (1)) AS l(line)
),
log AS (
  SELECT *, CASE WHEN k % 17 <> 0 THEN k % 3 END AS turn, CASE WHEN k % 19 <> 0 THEN k % 2 END AS step,
    CASE WHEN type = 'tool/call' THEN
      CASE WHEN line = 0 THEN CASE k % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'edit' WHEN 3 THEN 'bash' ELSE 'search' END
        WHEN event_id % 7 = 5 THEN 'bash'
        ELSE CASE k % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' ELSE 'write' END END
      WHEN type = 'tool/result' AND k % 5 <> 0 THEN 'search' END AS name,
    CASE WHEN (type = 'tool/call' AND line = 0) OR type = 'tool/result'
        THEN CASE WHEN k % 9 <> 0 THEN 'c' || CAST(k % 11 AS VARCHAR) END
      WHEN type = 'tool/call' THEN CASE WHEN event_id % 7 = 5 THEN 'b' ELSE 'd' END || CAST(event_id AS VARCHAR) END AS call_id,
    '/w/p' || CAST(user_id % 5 AS VARCHAR) || '/src/f' || CAST(k % 4 AS VARCHAR) || '.ts' AS p
  FROM lines
),
ev_log AS (
  SELECT *,
    CASE WHEN type = 'tool/call' AND name <> 'bash' AND k % 13 <> 0 THEN p END AS arg_path,
    CASE WHEN type = 'tool/call' THEN k % 2 = 0 AND name <> 'bash' END AS arg_partial,
    CASE WHEN type = 'tool/result' THEN err END AS error_code,
    CASE WHEN type = 'tool/result' AND k % 3 = 0 THEN p END AS meta_path
  FROM log
)"""

CALLS = LOG + """,
chain AS (
  SELECT *, lag(type) OVER w AS prev_type, lag(pos) OVER w AS prev_pos, lead(type) OVER w AS next_type
  FROM ev_log WHERE type IN ('tool/call', 'tool/result') AND call_id IS NOT NULL
  WINDOW w AS (PARTITION BY session_id, source_file, call_id ORDER BY pos)
),
waiting AS (
  SELECT *, max(CASE WHEN type = 'tool/call' AND coalesce(prev_type, 'tool/result') = 'tool/result' THEN pos END)
    OVER (PARTITION BY session_id, source_file, call_id) AS since FROM chain
),
results AS (
  SELECT r.session_id, r.source_file, r.pos, r.seq, r.turn, r.step, r.name, r.time, r.error_code, r.meta_path,
    CASE WHEN c.prev_type = 'tool/call' THEN c.prev_pos END AS call_pos
  FROM ev_log r LEFT JOIN chain c ON r.pos = c.pos WHERE r.type = 'tool/result'
),
calls AS (
  SELECT r.session_id, r.source_file, 0 AS late, r.pos AS at_pos,
    CASE WHEN o.pos IS NULL THEN r.turn ELSE o.turn END AS turn,
    CASE WHEN o.pos IS NULL THEN r.step ELSE o.step END AS step,
    coalesce(o.seq, r.seq) AS seq,
    CASE WHEN o.pos IS NULL THEN r.name ELSE o.name END AS name,
    o.time AS started_at, r.time AS ended_at, r.time - o.time AS duration_ms, r.error_code,
    coalesce(o.arg_path, r.meta_path) AS abs_path, o.pos IS NULL AS outcome_only
  FROM results r LEFT JOIN ev_log o ON r.call_pos = o.pos
  UNION ALL
  SELECT session_id, source_file, 1, since, turn, step, seq, name, time, NULL, NULL, NULL, arg_path, FALSE
  FROM waiting WHERE type = 'tool/call' AND next_type IS NULL
),
errors AS (
  SELECT session_id, source_file, seq, turn, step, CASE WHEN NOT outcome_only THEN name END AS tool,
    error_code AS code, abs_path, ended_at AS occurred_at
  FROM calls WHERE error_code IS NOT NULL
),
touches AS (
  SELECT session_id, source_file, seq, arg_path AS abs_path,
    CASE name WHEN 'read' THEN 'READ' ELSE 'WRITE' END AS op, name = 'read' AND arg_partial AS partial
  FROM ev_log WHERE type = 'tool/call' AND arg_path IS NOT NULL AND name IN ('read', 'write', 'edit')
),
commands AS (
  SELECT session_id, source_file, pos, seq, time, event_id % 12 AS kind, p, 'f' || CAST(k % 4 AS VARCHAR) || '.ts' AS base
  FROM ev_log WHERE type = 'tool/call' AND name = 'bash'
)"""
