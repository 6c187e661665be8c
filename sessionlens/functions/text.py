"""Column functions over paths, messages, times and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.schema import CODE_PLANES, DEFAULT_PLANE, UNKNOWN

# Credential words and the length from which a token counts as opaque.
CREDENTIAL = (
    r"(?i)(?=[abpst])(?<![A-Za-z0-9_])"  # the first look only skips hopeless positions fast
    r"(token|secret|password|passwd|api[_-]?key|authorization|bearer)"
    r"(?![A-Za-z0-9_])\s*[=:]?\s*\S+"
)
OPAQUE_RUN = r"[A-Za-z0-9+/_=-]{24,}"
MASK = "[REDACTED]"
EXCERPT_LIMIT = 160

# A provider failure is an HTTP status, a colon and a JSON body; a detail is a
# constant of at most 64 characters.
STATUS_BODY = r"(?s)^\d{3}:\s*(\{.*\})\s*$"
CONSTANT = r"^[A-Za-z][A-Za-z0-9_.-]{0,63}\z"
DETAIL_FIELDS = ("$.code", "$.type", "$.error.code", "$.error.type")

# Argument names that hold a path or ask for part of a file, in order of preference.
PATH_ARGUMENTS = ("file_path", "path", "notebook_path")
RANGE_ARGUMENTS = ("offset", "limit", "start_line", "end_line", "lines")


def literal(value) -> str:
    """A constant as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_array(values) -> Column:
    """A constant array in one expression, instead of one call per element."""
    return F.expr("array(" + ", ".join(map(literal, values)) + ")")


def literal_map(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items()) + ")")


def blank_to_null(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_hint(path: Column, root: Column) -> Column:
    """Relative to the project root, else the last segment; an absolute path never comes out."""
    prefix = F.when(F.endswith(root, F.lit("/")), root).otherwise(F.concat(root, F.lit("/")))
    under_root = blank_to_null(root).isNotNull() & F.startswith(path, prefix)
    return F.when(
        blank_to_null(path).isNotNull(),
        F.when(under_root, F.substr(path, F.length(prefix) + 1)).otherwise(base_name(path)))


def utc_day(millis: Column) -> Column:
    """Day string of epoch millis, independent of the session time zone."""
    days = F.floor(millis / F.lit(86_400_000)).cast("int")
    return F.date_from_unix_date(days).cast("string")


def role_of(depth: Column) -> Column:
    return F.when(depth == 0, "orchestrator").when(depth.isNotNull(), "subagent")


def plane_of(code: Column) -> Column:
    """Plane of a tool error code; NULL stays NULL, an unlisted code takes the default."""
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(literal_map(CODE_PLANES), code),
                                               F.lit(DEFAULT_PLANE)))


def or_unknown(column: Column) -> Column:
    return F.coalesce(column, F.lit(UNKNOWN))


def mask_secrets(text: Column) -> Column:
    """Credential assignments, then long opaque runs, replaced by the mask."""
    masked = F.regexp_replace(text, CREDENTIAL, f"$1={MASK}")
    return F.regexp_replace(masked, OPAQUE_RUN, MASK)


def redact_excerpt(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """First line with secrets masked, cut at ``limit`` characters: the form evidence is kept in."""
    masked = mask_secrets(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    return (F.when(F.length(masked) > limit,
                   F.concat(F.substring(masked, 1, limit), F.lit("…")))
            .otherwise(masked))


def provider_detail(message: Column) -> Column:
    """The provider's own constant out of a ``NNN: {json}`` message; prose yields NULL."""
    trimmed = F.regexp_replace(message, r"^\s+|\s+$", "")
    body = F.try_parse_json(F.nullif(F.regexp_extract(trimmed, STATUS_BODY, 1), F.lit("")))
    found = []
    for field in DETAIL_FIELDS:
        node = F.try_variant_get(body, field, "variant")
        text = F.try_variant_get(body, field, "string")
        found.append(F.when((F.schema_of_variant(node) == "STRING") & text.rlike(CONSTANT), text))
    return F.coalesce(*found)


def arguments_struct(arguments: Column) -> Column:
    fields = (*PATH_ARGUMENTS, *RANGE_ARGUMENTS, "command")
    return F.from_json(arguments, ", ".join(f"`{f}` STRING" for f in fields))


def argument_path(parsed: Column) -> Column:
    return F.coalesce(*[blank_to_null(parsed[p]) for p in PATH_ARGUMENTS])


def argument_partial(parsed: Column) -> Column:
    ranged = F.lit(False)
    for p in RANGE_ARGUMENTS:
        ranged = ranged | F.coalesce(parsed[p].isNotNull(), F.lit(False))
    return ranged


def round_half_up(value: Column, places: int) -> Column:
    scale = F.lit(float(10 ** places))
    return F.floor(value * scale + F.lit(0.5)) / scale
