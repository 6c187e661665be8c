"""Keys, vocabularies and the typed event layout every operator shares."""

from __future__ import annotations

# One log file of one session. Every ordered fold is scoped to it, and sequence numbers are never
# compared across it.
STREAM = ["session_id", "source_file"]

UNKNOWN = "unknown"
PLANES = ("INFRASTRUCTURE", "GUARD", "MODEL_MISUSE")
DEFAULT_PLANE = "INFRASTRUCTURE"
HIGH = 0.9
MEDIUM = 0.6

# Log file names and the convention each stands for.
CONVENTIONS = {
    "session.jsonl.zstd": "V0",
    "session.v3.jsonl.zstd": "V3",
}

# Tool error code -> plane. A code not listed takes DEFAULT_PLANE.
CODE_PLANES = {
    "WEB_PROVIDER_CREDENTIAL_MISSING": "INFRASTRUCTURE",
    "CODEGRAPH_UNAVAILABLE": "INFRASTRUCTURE",
    "TOOL_OUTCOME_UNKNOWN": "INFRASTRUCTURE",
    "INVALID_TOOL_OUTPUT": "INFRASTRUCTURE",
    "FS_STALE_VERSION": "GUARD",
    "FS_NOT_OBSERVED": "GUARD",
    "FS_SANDBOX_DENIED": "GUARD",
    "GOAL_TOOL_AUTHORITY_REQUIRED": "GUARD",
    "ASK_ABORTED": "GUARD",
    "ABORTED": "GUARD",
    "FS_EDIT_NOT_FOUND": "MODEL_MISUSE",
    "FS_AMBIGUOUS_EDIT": "MODEL_MISUSE",
    "FS_NOT_FOUND": "MODEL_MISUSE",
    "INVALID_ARGS": "MODEL_MISUSE",
    "SEARCH_INVALID_PATTERN": "MODEL_MISUSE",
    "SEARCH_FAILED": "MODEL_MISUSE",
    "FS_NOT_REGULAR_FILE": "MODEL_MISUSE",
}

# Filter name -> session column. The same names are the grouping axes of the cohort tables.
FACETS = {
    "schema": "schema",
    "model": "model",
    "preset": "agent_preset",
    "harnessVersion": "harness_version",
    "provider": "provider",
    "role": "role",
}
AXES = ("harnessVersion", "model", "provider", "role", "schema", "preset")

# A JSON number field is DOUBLE here, so a quoted number stays NULL and 2.7 truncates to 2;
# seq, time and outputTokens also accept quoted numbers, so they are read as text first.
EVENT_JSON = """
  type STRING, seq STRING, time STRING,
  id STRING, createdAt DOUBLE, cwd STRING, agentPreset STRING, delegationDepth DOUBLE,
  data STRUCT<
    turn: DOUBLE, step: DOUBLE,
    model: STRING, provider: STRING, contextWindow: DOUBLE,
    usage: STRUCT<inputTokens: DOUBLE, outputTokens: STRING>,
    stream: ARRAY<STRUCT<type: STRING, time: DOUBLE>>,
    callId: STRING, name: STRING, arguments: STRING,
    message: STRUCT<name: STRING, source: STRUCT<callId: STRING>>,
    error: STRUCT<code: STRING>,
    meta: STRUCT<path: STRING>,
    failure: STRUCT<code: STRING>,
    reason: STRUCT<kind: STRING, message: STRING, error: STRUCT<code: STRING, message: STRING>>
  >,
  _corrupt STRING
"""

# Columns of a parsed event: one narrow row per log line, the line's text already dropped.
EVENT_COLUMNS = [
    "session_id", "source_file", "project_slug", "schema", "pos", "type", "seq", "time",
    "header_id", "created_at", "cwd", "agent_preset", "delegation_depth",
    "turn", "step", "model", "provider", "context_window",
    "input_tokens", "output_tokens", "stream_first", "stream_last",
    "call_id", "name", "arg_path", "arg_partial", "command",
    "error_code", "meta_path", "retry_code", "reason_kind", "fatal_code", "fatal_detail",
]

FINDING_COLUMNS = [
    "session_id", "source_file", "detector", "plane", "category", "code", "detail", "confidence",
    "abs_path", "seq", "stale_seq", "cause_seq", "occurred_at", "summary", "evidence",
]
FINDING_TYPES = {
    "session_id": "string", "source_file": "string", "detector": "string", "plane": "string",
    "category": "string", "code": "string", "detail": "string", "confidence": "double",
    "abs_path": "string", "seq": "bigint", "stale_seq": "bigint", "cause_seq": "bigint",
    "occurred_at": "bigint", "summary": "string",
    "evidence": "array<struct<seq:bigint,verb_class:string,path:string,excerpt:string>>",
}
