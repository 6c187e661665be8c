"""Session log files: discovery, the compressed line scan, and the tolerant typed parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import text as tx
from sessionlens.schema import CONVENTIONS, EVENT_COLUMNS, EVENT_JSON, STREAM

# exactly the two known names, nothing that merely ends like them
FILE_GLOB = "{" + ",".join(CONVENTIONS) + "}"


def _stream_columns(path: Column, encoded: bool) -> list[Column]:
    """Names from a path; of an encoded one percent escapes alone are decoded, a plus sign is one."""
    parts = F.split(path, "/")
    named = [F.coalesce(F.try_element_at(parts, F.lit(-i)), F.lit("unknown")) for i in (1, 2, 3)]

    def plain(name: Column) -> Column:
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))) if encoded else name

    return [plain(named[1]).alias("session_id"), named[0].alias("source_file"),
            plain(named[2]).alias("project_slug"),
            F.try_element_at(tx.literal_map(CONVENTIONS), named[0]).alias("schema")]


def file_key(file: Column) -> Column:
    """What stands for a file's path while its lines are folded: two files never share one."""
    return F.md5(file)


def scan_streams(spark: SparkSession, root: str) -> DataFrame:
    """One row per log file under ``root``; a missing root raises, an empty one gives no rows.

    A file of zero bytes is no log yet: Spark's listings leave it out. A compressed empty text is one.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", True).option("pathGlobFilter", FILE_GLOB).load(root))
    # the content column is never read: only names, sizes and times are listed
    return files.select(*_stream_columns(F.col("path"), False), "length",
                        F.col("modificationTime").alias("modified"),
                        F.col("_metadata.file_path").alias("file"))


def files_of(files: DataFrame) -> DataFrame:
    """Files of (file, length, modified) as ``scan_streams`` lists them."""
    return files.select(*_stream_columns(F.col("file"), True), "length", "modified", "file")


def read_events(spark: SparkSession, root: str | list[str], keyed: bool = False) -> DataFrame:
    """The lines of every log file with their position in file order; blank lines are left out.

    ``root`` is a folder, or the paths of single files. zstd is not splittable, so one task reads a
    file front to back and the generated id follows file order. Write the result once before reading
    it twice: the id is stable only then.
    """
    if not root:
        return lines_of(spark.createDataFrame([], "value string, file string"), F.col("file"), keyed)
    return lines_of(spark.read.option("recursiveFileLookup", True)
                    .option("pathGlobFilter", FILE_GLOB).text(root),
                    F.col("_metadata.file_path"), keyed)


def lines_of(text: DataFrame, file_path: Column, keyed: bool = False) -> DataFrame:
    """``value`` rows in file order to lines with their stream and position.

    ``keyed``: the file's key is in the place of its session's name, so that files whose folders
    share a name stay apart.
    """
    lines = (
        text.select(*_stream_columns(file_path, True), file_key(file_path).alias("file_key"),
                    F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
        .where(F.col("line").rlike(r"\S"))
    )
    return lines.withColumn("session_id", F.col("file_key")).drop("file_key") if keyed else lines.drop("file_key")


def _whole(number: Column, kind: str) -> Column:
    """A JSON number as an integer, truncated toward zero."""
    return number.try_cast(kind)


def parse_events(lines: DataFrame) -> DataFrame:
    """Lines to typed event rows plus ``malformed``; unknown types and missing fields are kept.

    The line, message text and argument text end here: only a shell command is carried on, for the
    classification job, and no fact table has a column for it.
    """
    parsed = lines.withColumn("e", F.from_json(
        "line", EVENT_JSON, {"columnNameOfCorruptRecord": "_corrupt"}))
    e, data = F.col("e"), F.col("e.data")
    kind = F.coalesce(e["type"], F.lit(""))
    # A value of an unexpected type also fills _corrupt; only a line no JSON parser reads is bad.
    malformed = F.coalesce(
        F.when(e["_corrupt"].isNotNull(), F.try_parse_json("line").isNull()), F.lit(False))
    is_call, is_result = kind == "tool/call", kind == "tool/result"
    parsed = parsed.withColumn("malformed", malformed).withColumn(
        "args", F.when(is_call, tx.arguments_struct(data["arguments"])))
    args = F.col("args")
    timed = F.filter(data["stream"], lambda s: (s["type"] == "chunk") & s["time"].isNotNull())
    is_message = kind == "assistant/message"

    def edge(i: int) -> Column:
        return F.when(is_message, _whole(F.try_element_at(timed, F.lit(i))["time"], "bigint"))

    fatal_message = F.coalesce(data["reason"]["error"]["message"], data["reason"]["message"])
    columns = {
        "type": kind,
        "seq": F.coalesce(_whole(e["seq"].try_cast("double"), "bigint"), F.lit(-1)),
        "time": F.coalesce(_whole(e["time"].try_cast("double"), "bigint"), F.lit(0)),
        "header_id": e["id"],
        "created_at": _whole(e["createdAt"], "bigint"),
        "cwd": e["cwd"],
        "agent_preset": e["agentPreset"],
        "delegation_depth": _whole(e["delegationDepth"], "int"),
        "turn": _whole(data["turn"], "int"),
        "step": _whole(data["step"], "int"),
        "model": data["model"],
        "provider": data["provider"],
        "context_window": _whole(data["contextWindow"], "int"),
        "input_tokens": _whole(data["usage"]["inputTokens"], "int"),
        "output_tokens": _whole(data["usage"]["outputTokens"].try_cast("double"), "int"),
        "stream_first": edge(1),
        "stream_last": edge(-1),
        "call_id": F.when(is_call, data["callId"])
        .when(is_result, data["message"]["source"]["callId"]),
        "name": F.when(is_call, data["name"]).when(is_result, data["message"]["name"]),
        "arg_path": tx.argument_path(args),
        "arg_partial": F.when(is_call, tx.argument_partial(args)),
        "command": F.when(data["name"] == "bash", tx.blank_to_null(args["command"])),
        "error_code": F.when(is_result, data["error"]["code"]),
        "meta_path": data["meta"]["path"],
        "retry_code": data["failure"]["code"],
        "reason_kind": data["reason"]["kind"],
        "fatal_code": data["reason"]["error"]["code"],
        "fatal_detail": F.when((kind == "turn/end") & (data["reason"]["kind"] == "error"),
                               tx.provider_detail(fatal_message)),
    }
    kept = [c for c in EVENT_COLUMNS if c not in columns]
    return parsed.select(*kept, *[v.alias(k) for k, v in columns.items()], "malformed") \
        .select(*EVENT_COLUMNS, "malformed")


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("malformed")).drop("malformed")


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Unparseable lines per stream: counted, never fatal."""
    return parsed.groupBy(*STREAM).agg(F.count_if("malformed").alias("bad_lines"))
