"""The driver's tables seen as session data, so every operator runs on them at any scale.

Two views of ``events``, one stream per user:

* ``stored_tables``: the five stored tables, for the questions asked of an index;
* ``event_log``: typed log events, two lines per row, for the operators that build an index.

Each column is a function of its own row, so a view adds no shuffle but the one per-user aggregate
of the session table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import text as tx
from sessionlens.operators.facts import attribute_version
from sessionlens.schema import EVENT_COLUMNS, STREAM

TIMELINE = [("2024-01-01T06:00:00Z", "v1"), ("2024-01-01T18:00:00Z", "v2")]
FALLBACK_VERSION = "v0"
ERROR_CODES = ["FS_STALE_VERSION", "FS_EDIT_NOT_FOUND", "FS_NOT_FOUND", "SEARCH_FAILED",
               "WEB_PROVIDER_CREDENTIAL_MISSING", "ABORTED", "E_UNLISTED", None]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys``, by all columns if none are given, over as many tasks as a shuffle has, one a
    core at least.

    For work that costs far more a row than moving the row does: a file is cut by row groups only, and a
    few large ones would hold up the rest. The number is given, so it is not coalesced again.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *(keys or df.columns))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(index: Column, values: list) -> Column:
    """The value at a row's index; an absent value is NULL."""
    return F.try_element_at(tx.literal_array(values), (index % len(values) + 1).cast("int"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.from_json("props", "k INT")["k"].alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.concat(F.lit("u"), F.floor(user / F.lit(2)).cast("string")).alias("session_id"),
        F.when(user % 2 == 0, "session.jsonl.zstd").otherwise("session.v3.jsonl.zstd")
        .alias("source_file"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def stored_sessions(e: DataFrame) -> DataFrame:
    user = F.col("user_id")
    per_user = e.groupBy(*STREAM, "user_id").agg(
        F.min("ms").alias("started_at"), F.max("ms").alias("ended_at"),
        F.count_if((F.col("event_type") == "signup") & (F.col("k") % 4 == 1)).cast("int")
        .alias("fatal_turns"))
    depth = pick(user, [None, 0, 1, 0])
    return attribute_version(per_user.select(
        *STREAM, _text("p", user % 5).alias("project_slug"),
        F.when(user % 2 == 0, "V0").otherwise("V3").alias("schema"),
        "started_at", "ended_at",
        pick(user, ["builder", "planner", None]).alias("agent_preset"),
        depth.alias("delegation_depth"),
        pick(user, [None, "m-large", "m-small", "m-large"]).alias("model"),
        pick(user, ["local", "local", "remote", "remote", None]).alias("provider"),
        tx.role_of(depth).alias("role"), "fatal_turns"), TIMELINE, FALLBACK_VERSION)


def stored_calls(e: DataFrame) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    failed = kind == "error"
    orphan = failed & (k % 10 == 0)
    took = F.floor(F.col("value") * 10).cast("bigint")
    code = F.when(failed, pick(k, ERROR_CODES))
    rows = e.where(kind.isin("view", "click", "purchase", "error")).select(
        *STREAM, (k % 5).alias("turn"), (k % 3).alias("step"), F.col("event_id").alias("seq"),
        F.when(kind == "view", "read").when(kind == "click", "edit").when(kind == "purchase", "bash")
        .otherwise(pick(k, ["read", "edit", "write"])).alias("name"),
        F.when(~orphan, F.col("ms")).alias("started_at"), (F.col("ms") + took).alias("ended_at"),
        F.when(~orphan, took).alias("duration_ms"), code.alias("error_code"),
        _text("src/f", k % 7, ".ts").alias("path_hint"), orphan.alias("outcome_only"))
    return (rows.withColumn("plane", tx.plane_of(F.col("error_code")))
            .withColumn("day", tx.utc_day(F.col("started_at"))))


def stored_findings(e: DataFrame) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    code = F.when(kind == "error", pick(k, ERROR_CODES)) \
        .when((kind == "signup") & (k % 4 == 1), "SERVER")
    edit, fatal = (kind == "signup") & (k % 4 == 0), (kind == "signup") & (k % 4 == 1)
    rows = e.select("*", code.alias("code"), edit.alias("edit"), fatal.alias("fatal")) \
        .where(F.col("edit") | F.col("code").isNotNull())
    code, edit, fatal = F.col("code"), F.col("edit"), F.col("fatal")
    stale, miss = code == "FS_STALE_VERSION", code == "FS_EDIT_NOT_FOUND"
    third = k % 3
    seq = F.col("event_id")
    occurred = F.when(kind == "error", F.col("ms") + F.floor(F.col("value") * 10).cast("bigint")) \
        .otherwise(F.col("ms"))
    rows = rows.select(
        F.col("event_id").alias("id"), *STREAM,
        F.when(edit, "shell-edit").when(fatal, "fatal-turn").when(stale, "stamp-guard")
        .when(miss, "edit-miss").otherwise("error-plane").alias("detector"),
        F.when(edit, "MODEL_MISUSE").otherwise(tx.plane_of(code)).alias("plane"),
        F.when(edit, "DIRECT_MUTATION")
        .when(stale, pick(third, ["DIRECT_MUTATION", "VCS_RESTORE", "EXTERNAL"]))
        .when(miss, pick(third, ["REPEATED_MISS", "MISS_AFTER_READ", "MISS_AFTER_EDIT"]))
        .alias("category"),
        "code",
        F.when(edit, pick(third, ["REDIRECT", "IN_PLACE", "SCRIPT"]))
        .when(fatal & (third == 0), "unavailable_error").alias("detail"),
        F.when(edit, pick(k, [0.9, 0.6])).when(stale & (third < 2), 0.9).when(miss, 0.9)
        .alias("confidence"),
        _text("src/f", k % 7, ".ts").alias("path_hint"),
        F.when(~fatal, seq).alias("seq"),
        F.when(stale & (third < 2), seq - 40).alias("stale_seq"),
        F.when((stale & (third < 2)) | miss, seq - 20).alias("cause_seq"),
        occurred.alias("occurred_at"),
        _text("finding ", seq).alias("summary"))
    return rows.withColumn("day", tx.utc_day(F.col("occurred_at")))


def stored_steps(e: DataFrame) -> DataFrame:
    k, third = F.col("k"), F.col("k") % 3
    timed = third != 0
    return e.where(F.col("event_type").isin("purchase", "view")).select(
        *STREAM, F.col("event_id").alias("turn"), third.alias("step"),
        F.col("ms").alias("started_at"), (F.col("ms") + k * 100).alias("ended_at"),
        k.alias("input_tokens"), F.nullif(k % 10, F.lit(0)).alias("output_tokens"),
        F.when(timed & (k % 5 != 0), F.col("value")).alias("decode_tps"),
        F.when(timed & (k % 7 != 0), k * 10).alias("ttft_ms"),
        pick(third, ["none", "chunk-events", "embedded-stream"]).alias("timing_source"))


def stored_evidence(e: DataFrame) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    rows = e.where(((kind == "signup") & (k % 4 == 0))
                   | ((kind == "error") & (k % 8 == 0) & (k % 3 < 2)))
    return rows.select(
        F.col("event_id").alias("finding_id"), *STREAM, (F.col("event_id") - 20).alias("seq"),
        pick(k, ["MUTATING", "VCS_RESTORE"]).alias("verb_class"),
        _text("src/f", k % 7, ".ts").alias("path_hint"), _text("sed -i x f", k).alias(
            "excerpt_redacted"))


class StoredTables:
    """The five tables over ``events``, each planned only when a question asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._events = event_rows(spark, sf_dir)

    sessions = cached_property(lambda self: stored_sessions(self._events))
    steps = cached_property(lambda self: stored_steps(self._events))
    calls = cached_property(lambda self: stored_calls(self._events))
    findings = cached_property(lambda self: stored_findings(self._events))
    evidence = cached_property(lambda self: stored_evidence(self._events))


def stored_tables(spark: SparkSession, sf_dir: str) -> StoredTables:
    return StoredTables(spark, sf_dir)


# --- the event log view -----------------------------------------------------------------------

def command_text(template: Column, path: Column, name: Column) -> Column:
    """Shell commands over a file, twelve kinds: what each must be classified as is known."""
    kinds = [
        _text("sed -i 's/a/b/' ", path),
        _text("git checkout HEAD -- src/", name),
        _text("cat ", path, " | head -5"),
        _text("node tools/run.mjs"),
        _text("echo x > src/", name),
        _text("echo x | tee ", name),
        _text("python3 -c \"open('", path, "','w').write('x')\""),
        _text("cp ", path, " ", path, ".bak"),
        _text("truncate -s 0 ./src/", name),
        _text("python3 -c \"p='src/", name, "'; open(p,'w').write('x')\""),
        _text("grep -n x src/", name, " 2>/dev/null"),
        _text("echo y >> /other/", name),
    ]
    return F.try_element_at(F.array(*kinds), (template % len(kinds) + 1).cast("int"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed log events: an activity line and a housekeeping line per row of ``events``."""
    k, user, at = F.col("k"), F.col("user_id"), F.col("event_id")
    lines = spread(event_rows(spark, sf_dir), "event_id") \
        .withColumn("line", F.explode(F.array(F.lit(0), F.lit(1))))
    activity = tx.literal_map({
        "signup": "step/start", "view": "assistant/chunk", "purchase": "assistant/message",
        "click": "tool/call", "error": "tool/result"})
    housekeeping = pick(at % 7, ["step/end", "llm/retry", "turn/end", "session",
                                 "request/context", "tool/call", "tool/call"])
    first = F.col("line") == 0
    lines = lines.withColumn("type", F.when(first, activity[F.col("event_type")])
                             .otherwise(housekeeping))
    kind = F.col("type")
    call, result, message = kind == "tool/call", kind == "tool/result", kind == "assistant/message"
    shell = ~first & (at % 7 == 5)
    tool = F.when(call, F.when(first, pick(k, ["read", "write", "edit", "bash", "search"]))
                  .when(shell, "bash").otherwise(pick(k, ["read", "edit", "write"])))
    path = _text("/w/p", user % 5, "/src/f", k % 4, ".ts")
    header, context, turn_end = kind == "session", kind == "request/context", kind == "turn/end"
    retry = kind == "llm/retry"
    shared_id = F.when(k % 9 != 0, _text("c", k % 11))
    columns = {
        "project_slug": _text("p", user % 5),
        "schema": F.when(user % 2 == 0, "V0").otherwise("V3"),
        "pos": at * 2 + F.col("line"), "seq": at * 2 + F.col("line"), "time": F.col("ms"),
        "header_id": F.when(header, F.col("session_id")),
        "created_at": F.when(header & (k % 3 != 0), F.col("ms") - 1000),
        "cwd": F.when(header, _text("/w/p", user % 5)),
        "agent_preset": F.when(header, pick(k, ["builder", "planner", None])),
        "delegation_depth": F.when(header, pick(k, [None, 0, 1, 2])),
        "turn": F.when(k % 17 != 0, k % 3), "step": F.when(k % 19 != 0, k % 2),
        "model": F.when(context, pick(k, ["m-large", "m-small", None])),
        "provider": F.when(context, pick(k, ["local", "remote"])),
        "context_window": F.when(context & (k % 5 != 0), k * 1000),
        "input_tokens": F.when(message, k),
        "output_tokens": F.when(message, F.when(k % 10 == 0, 0).otherwise(k * 3)),
        "stream_first": F.when(message & (k % 4 != 0), F.col("ms") - 4000),
        "stream_last": F.when(message & (k % 4 != 0), F.col("ms") - 1000 - k),
        "call_id": F.when((call & first) | result, shared_id)
        .when(call, _text(F.when(shell, "b").otherwise("d"), at)),
        "name": F.coalesce(tool, F.when(result & (k % 5 != 0), "search")),
        "arg_path": F.when(call & (tool != "bash") & (k % 13 != 0), path),
        "arg_partial": F.when(call, (k % 2 == 0) & (tool != "bash")),
        "command": F.when(tool == "bash", command_text(at, path, _text("f", k % 4, ".ts"))),
        "error_code": F.when(result, pick(k, ERROR_CODES)),
        "meta_path": F.when(result & (k % 3 == 0), path),
        "retry_code": F.when(retry, pick(k, ["TIMEOUT", "SERVER", "TRANSPORT", None])),
        "reason_kind": F.when(turn_end, pick(k, ["error", "done"])),
        "fatal_code": F.when(turn_end & (k % 2 == 0), pick(k, ["SERVER", None, "INVALID_REQUEST"])),
        "fatal_detail": F.when(turn_end & (k % 2 == 0), pick(k, ["a_detail", None, "b_detail", None])),
    }
    kept = [c for c in EVENT_COLUMNS if c not in columns]
    return lines.select(*kept, *[v.alias(c) for c, v in columns.items()]).select(*EVENT_COLUMNS)


def log_lines(log: DataFrame, bad_every: int = 97) -> DataFrame:
    """The event log written as JSON lines, every 97th of them broken."""
    c = F.col
    message = F.when(
        c("type") == "tool/result",
        F.struct(c("name"), F.struct(c("call_id").alias("callId")).alias("source")))
    stream = F.when(c("stream_first").isNotNull(), F.array(
        F.struct(F.lit("reasoning-chunks").alias("type"), F.lit(None).cast("bigint").alias("time")),
        F.struct(F.lit("chunk").alias("type"), c("stream_first").alias("time")),
        F.struct(F.lit("chunk").alias("type"), c("stream_last").alias("time"))))
    is_call = c("type") == "tool/call"
    arguments = F.when(is_call, F.to_json(F.struct(
        c("arg_path").alias("file_path"), F.when(c("arg_partial"), 10).alias("offset"),
        c("command"))))
    body = F.concat(
        pick(c("pos"), ["400: ", "503: "]), F.lit('{"code":"'), c("fatal_detail"), F.lit('"}'))
    data = F.struct(
        "turn", "step", "model", "provider", c("context_window").alias("contextWindow"),
        F.struct(c("input_tokens").alias("inputTokens"),
                 c("output_tokens").alias("outputTokens")).alias("usage"),
        stream.alias("stream"),
        F.when(is_call, c("call_id")).alias("callId"), F.when(is_call, c("name")).alias("name"),
        arguments.alias("arguments"), message.alias("message"),
        F.struct(c("error_code").alias("code")).alias("error"),
        F.struct(c("meta_path").alias("path")).alias("meta"),
        F.struct(c("retry_code").alias("code")).alias("failure"),
        F.struct(c("reason_kind").alias("kind"),
                 F.struct(c("fatal_code").alias("code"), body.alias("message")).alias("error"))
        .alias("reason"))
    line = F.to_json(F.struct(
        "type", "seq", "time", c("header_id").alias("id"), c("created_at").alias("createdAt"),
        "cwd", c("agent_preset").alias("agentPreset"),
        c("delegation_depth").alias("delegationDepth"), data.alias("data")))
    return log.select(*STREAM, "project_slug", "schema", "pos",
                      F.when(c("pos") % bad_every == 0, F.concat(F.lit("{bad "), line))
                      .otherwise(line).alias("line"))
