"""Event rows to typed facts: sessions, steps, tool calls, touches, errors, retries, fatal turns.

Order inside a stream is line position. Last-wins facts are ``max_by`` aggregates with map-side
combine; the two state machines (steps, call pairing) are previous-row scans over blocks of a
stream (see ``ordered``), so a stream that holds a third of all lines is still many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import text as tx
from sessionlens.operators.ordered import BLOCK_BITS, with_previous
from sessionlens.schema import STREAM
from sessionlens.sources.dimensions import version_at

STEP = [*STREAM, "turn", "step"]


# --- session ----------------------------------------------------------------------------------

def stream_ends(events: DataFrame) -> DataFrame:
    """D3: the time of each stream's last line, of any type.

    The one aggregate over every line: fixed-width values and keys that are functions of the
    stream, so it hashes and combines map-side down to a row per stream and task.
    """
    return events.groupBy(*STREAM, "project_slug", "schema").agg(
        F.max_by("time", "pos").alias("ended_at"))


def session_header(events: DataFrame) -> DataFrame:
    """D1 header (the last line wins, NULLs included), D2 last context, D3 end, D5 fatal turns."""
    header = F.col("type") == "session"
    context = F.col("type") == "request/context"
    fatal = (F.col("type") == "turn/end") & (F.col("reason_kind") == "error")
    declared = (
        events.where(header | context | fatal).groupBy(*STREAM)
        .agg(F.max_by(F.struct("header_id", "cwd", "agent_preset", "delegation_depth",
                               F.coalesce("created_at", "time").alias("started_at")),
                      F.when(header, F.col("pos"))).alias("h"),
             F.max_by(F.struct("model", "provider", "context_window"),
                      F.when(context, F.col("pos"))).alias("c"),
             F.count_if(fatal).cast("int").alias("fatal_turns"))
    )
    return (
        stream_ends(events).join(declared, STREAM, "left")
        .select(*STREAM, F.coalesce("h.header_id", "session_id").alias("id"),
                "project_slug", "schema",
                F.coalesce(F.nullif("h.started_at", F.lit(0)), F.lit(1)).cast("bigint")
                .alias("started_at"),
                "ended_at", "h.agent_preset", "h.delegation_depth",
                "c.model", "c.provider", tx.role_of(F.col("h.delegation_depth")).alias("role"),
                "c.context_window", F.coalesce("fatal_turns", F.lit(0)).alias("fatal_turns"),
                "h.cwd")
    )


def attribute_version(sessions: DataFrame, timeline: list[tuple[str, str]],
                      fallback: str = "unknown") -> DataFrame:
    return (sessions
            .withColumn("harness_version", version_at(F.col("started_at"), timeline, fallback))
            .withColumn("version_inferred", F.lit(True)))


# --- steps ------------------------------------------------------------------------------------

BOUNDARIES = ("step/start", "assistant/message", "step/end")


def step_epochs(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per stretch between two boundary events of a step, with the chunk window inside.

    ``opened_*`` is the boundary a stretch follows, ``next`` the one that ends it. Only a stretch
    after ``step/start`` is an open step, so only its chunks count.
    """
    rows = (
        events.where(F.col("type").isin(*BOUNDARIES, "assistant/chunk"))
        .select(*STREAM, F.coalesce("turn", F.lit(0)).alias("turn"),
                F.coalesce("step", F.lit(0)).alias("step"),
                "pos", "type", "time", "input_tokens", "output_tokens",
                "stream_first", "stream_last")
    )
    boundary = F.col("type") != "assistant/chunk"
    rows = with_previous(rows, STEP, "pos", {
        "opened_pos": F.when(boundary, F.col("pos")),
        "opened_time": F.when(boundary, F.col("time")),
        "opened_open": F.when(boundary, F.col("type") == "step/start")}, bits)
    chunk_at = F.when(~boundary, F.col("pos"))

    def ending(column: Column, name: str) -> Column:
        # only one boundary can end a stretch: the next one
        return F.max(F.when(boundary, column)).alias(f"next_{name}")

    return (
        rows.groupBy(*STEP, "opened_pos", "opened_time", "opened_open")
        .agg(F.min_by("time", chunk_at).alias("chunk_first"),
             F.max_by("time", chunk_at).alias("chunk_last"),
             ending(F.array_position(F.lit(list(BOUNDARIES)), F.col("type")), "kind"),
             *[ending(F.col(c), c) for c in ("pos", "time", "input_tokens", "output_tokens",
                                             "stream_first", "stream_last")])
    )


def assemble_steps(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The last message of a (turn, step) closes it; a step still open is a bare row.

    Every value kept is of fixed width and stands alone, so both aggregates hash.
    """
    epochs = step_epochs(events, bits)
    starts, closes, ends = (F.col("next_kind") == k for k in range(1, 1 + len(BOUNDARIES)))
    at, is_open = F.col("next_pos"), F.col("opened_open")
    message = {
        "start": F.when(is_open, F.col("opened_time")).otherwise(F.col("next_time")),
        "chunk_first": F.when(is_open, F.col("chunk_first")),
        "chunk_last": F.when(is_open, F.col("chunk_last")),
        **{c: F.col(f"next_{c}") for c in ("input_tokens", "output_tokens", "stream_first", "stream_last",
                                           "pos")}}
    grouped = (
        epochs.groupBy(*STEP)
        .agg(*[F.max_by(v, F.when(closes, at)).alias(f"m_{c}") for c, v in message.items()],
             F.max(F.when(ends, at)).alias("end_pos"),
             F.max_by("next_time", F.when(ends, at)).alias("end_time"),
             F.max_by(starts, at).alias("reopened"), F.max_by("next_time", at).alias("latest_time"))
        .select(*STEP, F.when(F.col("m_pos").isNotNull(), F.struct(*[F.col(f"m_{c}").alias(c) for c in message]))
                .alias("m"),
                F.struct(F.col("end_pos").alias("pos"), F.col("end_time").alias("time")).alias("end"),
                F.when(F.col("reopened"), F.col("latest_time")).alias("open_since"))
        .where(F.col("m").isNotNull() | F.col("open_since").isNotNull())
    )
    return step_timing(grouped)


def step_timing(grouped: DataFrame) -> DataFrame:
    """Decode rate and time to first token from chunk events, else from the message's own stream.

    A wait is a long: a step left open for more than 24 days waits longer than an int of milliseconds holds.
    """
    m = F.col("m")
    from_chunks = m["chunk_first"].isNotNull()
    first = F.when(from_chunks, m["chunk_first"]).otherwise(m["stream_first"])
    last = F.when(from_chunks, m["chunk_last"]).otherwise(m["stream_last"])
    measured = (last > first) & (m["output_tokens"] > 0)
    seconds = F.when(measured, (last - first) / F.lit(1000.0))
    waited = first - m["start"]
    return grouped.select(
        *STEP,
        F.coalesce(m["start"], F.col("open_since")).alias("started_at"),
        F.when(F.col("end.pos") > m["pos"], F.col("end.time")).alias("ended_at"),
        m["input_tokens"].alias("input_tokens"),
        F.nullif(m["output_tokens"], F.lit(0)).alias("output_tokens"),
        (m["output_tokens"] / seconds).alias("decode_tps"),
        F.when(measured & (waited >= 0), waited).alias("ttft_ms"),
        F.when(from_chunks, "chunk-events")
        .when(m["stream_first"].isNotNull(), "embedded-stream")
        .otherwise("none").alias("timing_source"))


# --- tool calls -------------------------------------------------------------------------------

def pair_calls(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Every result with the call it answers, orphan results, unanswered calls.

    A result answers the previous event of its call id if that is a call. The last event of an id,
    if a call, went unanswered; a call followed by another call with its id was replaced. ``rank``
    is the order rows were observed in: results as they came, then unanswered calls.
    """
    is_result, is_call = F.col("type") == "tool/result", F.col("type") == "tool/call"
    rows = events.where(F.col("type").isin("tool/call", "tool/result")) \
        .select(*STREAM, "call_id", "pos", "type", "seq", "turn", "step", "name", "time", "arg_path",
                "error_code", "meta_path")
    # what is carried is a place and a flag; the call itself is fetched by its place
    chained = with_previous(
        rows.where(F.col("call_id").isNotNull()), [*STREAM, "call_id"], "pos",
        {"prev_pos": F.col("pos"), "prev_call": is_call}, bits)
    after_call = F.coalesce(F.col("prev_call"), F.lit(False))
    no_call = {"prev_pos": F.lit(None).cast("bigint"), "prev_call": F.lit(False)}
    results = chained.where(is_result).unionByName(
        rows.where(is_result & F.col("call_id").isNull()).withColumns(no_call))
    call = F.struct("seq", "turn", "step", "name", "time", "arg_path").alias("call")
    calls = rows.where(is_call).select(*STREAM, F.col("pos").alias("call_pos"), call)
    unanswered = (
        chained.groupBy(*STREAM, "call_id")
        .agg(F.max("pos").alias("call_pos"), F.max_by(is_call, "pos").alias("waits"),
             # replaced calls keep the place of the first one waiting
             F.max(F.when(is_call & ~after_call, F.col("pos"))).alias("waiting_since"))
        .where("waits")
        .join(calls, [*STREAM, "call_pos"])
        .select(*STREAM,
                F.struct(F.lit(1).alias("late"), F.col("waiting_since").alias("at")).alias("rank"),
                "call.turn", "call.step", "call.seq", "call.name",
                F.col("call.time").alias("started_at"),
                F.lit(None).cast("bigint").alias("ended_at"),
                F.lit(None).cast("bigint").alias("duration_ms"),
                F.lit(None).cast("string").alias("error_code"),
                F.col("call.arg_path").alias("abs_path"), F.lit(False).alias("outcome_only"))
    )
    known, call = F.col("call").isNotNull(), F.col("call")
    answered = (
        results.withColumn("call_pos", F.when(after_call, F.col("prev_pos")))
        .join(calls, [*STREAM, "call_pos"], "left")
        .select(
            *STREAM,
            F.struct(F.lit(0).alias("late"), F.col("pos").alias("at")).alias("rank"),
            *[F.when(known, call[c]).otherwise(F.col(c)).alias(c) for c in ("turn", "step", "seq", "name")],
            call["time"].alias("started_at"), F.col("time").alias("ended_at"),
            (F.col("time") - call["time"]).alias("duration_ms"),
            "error_code", F.coalesce(call["arg_path"], "meta_path").alias("abs_path"),
            (~known).alias("outcome_only"))
    )
    return answered.unionByName(unanswered)


def first_per_seq(calls: DataFrame) -> DataFrame:
    """One row per event seq, the first observed; an aggregate, so a repeated seq combines."""
    rest = [c for c in calls.columns if c not in (*STREAM, "seq")]
    return (calls.groupBy(*STREAM, "seq")
            .agg(F.min_by(F.struct(*rest), "rank").alias("c"))
            .select(*STREAM, "seq", *[f"c.{c}" for c in rest]))


def tool_call_table(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """The stored call rows: one per seq, plane by code, path reduced to a hint."""
    roots = sessions.select(*STREAM, "cwd")
    return (
        first_per_seq(calls).join(roots, STREAM, "left")
        .select(*STREAM, "turn", "step", "seq", "name", "started_at", "ended_at", "duration_ms",
                "error_code", tx.plane_of(F.col("error_code")).alias("plane"),
                tx.path_hint(F.col("abs_path"), F.col("cwd")).alias("path_hint"),
                "outcome_only", tx.utc_day(F.col("started_at")).alias("day"))
    )


def error_events(calls: DataFrame) -> DataFrame:
    """Results that carry a code, at the result's time. An orphan has no known tool."""
    return (calls.where(F.col("error_code").isNotNull())
            .select(*STREAM, "seq", "turn", "step",
                    F.when(~F.col("outcome_only"), F.col("name")).alias("tool"),
                    F.col("error_code").alias("code"), "abs_path",
                    F.col("ended_at").alias("occurred_at")))


def unmapped_codes(errors: DataFrame, code_planes: DataFrame) -> DataFrame:
    """Codes that fell to the default plane; the plane map is a fixed 17 rows."""
    return (errors.select("code").where(F.col("code").isNotNull()).distinct()
            .join(F.broadcast(code_planes.select("code")), "code", "left_anti")
            .orderBy("code"))


def file_touches(events: DataFrame) -> DataFrame:
    """File-tool operations on a path; a ranged read is partial."""
    op: Column = (F.when(F.col("name") == "read", "READ")
                  .when(F.col("name").isin("write", "edit"), "WRITE"))
    return (events.where((F.col("type") == "tool/call") & F.col("arg_path").isNotNull())
            .select(*STREAM, "pos", "seq", F.col("arg_path").alias("abs_path"), op.alias("op"),
                    ((op == "READ") & F.col("arg_partial")).alias("partial"))
            .where(F.col("op").isNotNull()))


def retry_events(events: DataFrame) -> DataFrame:
    return (events.where(F.col("type") == "llm/retry")
            .select(*STREAM, "pos", "seq", F.coalesce("turn", F.lit(0)).alias("turn"),
                    F.coalesce("step", F.lit(0)).alias("step"),
                    F.col("retry_code").alias("code"), F.col("time").alias("occurred_at")))


def fatal_turns(events: DataFrame) -> DataFrame:
    """Turns that ended in a typed error; text is never matched."""
    return (events.where((F.col("type") == "turn/end") & (F.col("reason_kind") == "error"))
            .select(*STREAM, "pos", F.coalesce("turn", F.lit(0)).alias("turn"),
                    F.col("fatal_code").alias("code"), F.col("fatal_detail").alias("detail"),
                    F.col("time").alias("occurred_at")))
