"""Shell command classification as native regex columns: text in, facts out, no UDF.

Fixed values below: the patterns that decide what counts as a write, a restore or a read. Word
boundaries are spelled out as ASCII look-arounds so results do not depend on the JDK's idea of a
word character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.functions.text import base_name

# --- fixed values -----------------------------------------------------------------------------
B = r"(?<![A-Za-z0-9_])"
E = r"(?![A-Za-z0-9_])"
OPTION_I = r"(?:sed|perl)\s+(?:[^\s;&|]+\s+){0,16}?-[A-Za-z]*i" + E
AT_COMMAND = r"(?:^|[;&|(]\s*|" + B + r"sudo\s+|" + B + r"xargs\s+(?:-\S+\s+){0,8}|-exec\s+)"
SCRIPT_CALLS = (
    r"open\([^)]{0,60}['\"][wax]|writeFileSync|writeFile\s*\(|writeText\s*\("
    r"|\.write_(?:text|bytes)\s*\(|createWriteStream"
)

VCS_RESTORE = (
    B + r"git\s+(?:checkout|restore|stash|reset|clean|revert|pull|merge|rebase|switch)" + E
)
MUTATING = (
    B + OPTION_I
    + r"|>>?\s*(?:/(?!dev/)\S|\./\S|~/\S|[A-Za-z_][A-Za-z0-9_./-]*)"
    + "|" + B + r"(?:tee|truncate|cp|mv|rm|install|patch|touch|mkdir|chmod|chown|ln|dd)" + E
    + "|" + SCRIPT_CALLS + r"|\.write\s*\(|File\.write|fwrite\("
)
READ_ONLY = (
    B + r"(?:cat|head|tail|wc|ls|cd|pwd|echo|printf|grep|rg|ag|find|fd|stat|file|du|df|less"
    r"|more|jq|awk|cut|sort|uniq|diff|comm)" + E
    + "|" + B + r"sed\s+-n" + E
    + "|" + B + r"git\s+(?:status|log|diff|show|blame|ls-files)" + E
)

IN_PLACE = r"(?m)" + AT_COMMAND + OPTION_I
REDIRECT = (
    r"(?<![=<>&0-9-])>>?\s*((?:/(?!dev/)|\./|\.\./|~/)[^\s'\"`;|&<>()]+"
    r"|[A-Za-z0-9_.-]+/[^\s'\"`;|&<>()]+|[A-Za-z0-9_-]+\.[A-Za-z0-9]{1,8}" + E + ")"
)
TEE = r"(?m)" + AT_COMMAND + "tee" + E
SCRIPT_WRITE = SCRIPT_CALLS + r"|(?<!stdout)(?<!stderr)\.write\s*\(|File\.write|fwrite\("
TRUNCATE = r"(?m)" + AT_COMMAND + "truncate" + E
CONTENT_TOOL = r"(?m)" + AT_COMMAND + "(?:truncate|patch|dd)" + E
FILE_OP = r"(?m)" + AT_COMMAND + "(?:cp|mv|rm|install|touch|mkdir|chmod|chown|ln)" + E

SCRIPT_TARGET = (
    r"open\(\s*(['\"])([^'\"]+)\1\s*,\s*['\"][wax]"
    r"|(?:writeFileSync|writeFile|createWriteStream|appendFileSync)\(\s*(['\"])([^'\"]+)\3"
    r"|Path\(\s*(['\"])([^'\"]+)\5\s*\)\.write_(?:text|bytes)"
)
DD_OUTPUT = B + r"of=([^\s'\"`;|&<>()]+)"
SEGMENT = r"(?=([^;&|\n]*))"
REDIRECTION_WORD = r"^[0-9]*(?:<<<|<|>>|>|>\|)\z"
REDIRECTION_TAKES = r"[0-9]*(?:<<<|<|>>|>\||>)"
REDIRECTION_START = r"^(?:[<>]|[0-9]+[<>].*\z)"
SCRIPT_OPTION = r"^-[A-Za-z]*[ef]\z"
SCRIPT_TAKES = r"-[A-Za-z]*[ef]"
SCRIPT_OPTION_INSIDE = r"(?s)\s-[A-Za-z]*[ef]\s"
PATH_LIKE = (
    r"^(?:(?:[~.]{0,2}/)?[A-Za-z0-9_.~+-]*(?:/[A-Za-z0-9_.~+-]+){1,64}"
    r"|[A-Za-z0-9_~+-][A-Za-z0-9_.~+-]*\.[A-Za-z0-9]{1,8})\z"
)
HEREDOC = r"(?<!<)<<-?(?!<)\s*['\"]?([A-Za-z_][A-Za-z0-9_]*)['\"]?"
QUOTED = r"\"[^\"\\]*+(?:(?s:\\.)[^\"\\]*+)*+\"|'[^']*+'"

ABSOLUTE = r"/[A-Za-z0-9._~+-](?:[^\s'\"`;|&<>()]*[A-Za-z0-9._~+-])?"
RELATIVE = (
    r"(?<![A-Za-z0-9_./~+-])(?:[A-Za-z0-9._~+-]{1,255}+/){0,32}[A-Za-z0-9._~+-]{0,254}[A-Za-z]"
    r"[A-Za-z0-9._~+-]{0,254}\.[A-Za-z][A-Za-z0-9]{0,5}"
)
# ----------------------------------------------------------------------------------------------

CONTENT_KINDS = ("IN_PLACE", "REDIRECT", "TEE", "SCRIPT", "CONTENT_TOOL")


def _find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def verb_class(command: Column) -> Column:
    return (F.when(command.rlike(VCS_RESTORE), "VCS_RESTORE")
            .when(command.rlike(MUTATING), "MUTATING")
            .when(command.rlike(READ_ONLY), "READ_ONLY")
            .when(command.isNotNull(), "OTHER"))


def blank_quoted(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "''")


def shell_surface(command: Column) -> Column:
    """What the shell itself parses: heredoc bodies dropped, quoted strings blanked."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("until"))

    def step(seen: Column, line: Column) -> Column:
        inside = seen["until"] != ""
        closes = F.regexp_replace(line, r"^\s+|\s+$", "") == seen["until"]
        return F.struct(
            F.when(inside, seen["out"])
            .otherwise(F.concat(seen["out"], line, F.lit("\n"))).alias("out"),
            F.when(inside & closes, "").when(inside, seen["until"])
            .otherwise(F.regexp_extract(line, HEREDOC, 1)).alias("until"))

    kept = F.aggregate(F.split(command, "\n", -1), start, step, lambda seen: seen["out"])
    # the fold is needed only where a heredoc can start
    return blank_quoted(F.when(F.contains(command, F.lit("<<")), kept)
                        .otherwise(F.concat(command, F.lit("\n"))))


def write_kind(command: Column, surface: Column) -> Column:
    """How a MUTATING command writes; content forms win over file operations."""
    return (F.when(surface.rlike(IN_PLACE), "IN_PLACE")
            .when(surface.rlike(REDIRECT), "REDIRECT")
            .when(surface.rlike(TEE), "TEE")
            .when(command.rlike(SCRIPT_WRITE), "SCRIPT")
            .when(surface.rlike(CONTENT_TOOL), "CONTENT_TOOL")
            .when(surface.rlike(FILE_OP), "FILE_OP"))


def redirect_targets(surface: Column) -> Column:
    return F.array_distinct(_find_all(surface, REDIRECT, 1))


def dd_targets(surface: Column) -> Column:
    return _find_all(surface, DD_OUTPUT, 1)


def script_targets(command: Column) -> Column:
    """Literal paths of script write calls: whichever of the three call shapes matched."""
    def either(a: Column, b: Column) -> Column:
        return F.concat(a, b)  # a shape that did not match extracts ''

    named = F.zip_with(
        _find_all(command, SCRIPT_TARGET, 2),
        F.zip_with(_find_all(command, SCRIPT_TARGET, 4), _find_all(command, SCRIPT_TARGET, 6),
                   either),
        either)
    return F.array_distinct(named)


def _segment_operands(tail: Column, script_given: Column | None) -> Column:
    """The file operands of one segment's text, in order.

    A redirection operator takes the word after it, and so does a script option of a tool that has
    one; both words go in one left-to-right replacement. ``script_given`` says whether an option
    before the segment already named a script. None means the tool takes no script, so its first
    word is an operand like the others.
    """
    takes = REDIRECTION_TAKES if script_given is None else f"{REDIRECTION_TAKES}|{SCRIPT_TAKES}"
    pair = rf"(?<!\S)({takes})(?!\S)\s+\S+"
    words = F.split(F.regexp_replace(tail, pair, " "), r"\s+")
    plain = F.filter(words, lambda w: ~((w == "") | w.rlike(REDIRECTION_WORD) | F.startswith(w, F.lit("-"))
                                        | w.rlike(REDIRECTION_START)))
    later = F.filter(F.slice(plain, 2, F.greatest(F.size(plain), F.lit(1))),
                     lambda w: w.rlike(PATH_LIKE))
    if script_given is None:
        return F.filter(plain, lambda w: w.rlike(PATH_LIKE))
    scripted = (script_given | F.exists(_find_all(tail, pair, 1), lambda w: w.rlike(SCRIPT_OPTION))
                | F.exists(words, lambda w: w.rlike(SCRIPT_OPTION)))
    return F.when(scripted, F.filter(plain, lambda w: w.rlike(PATH_LIKE))).otherwise(later)


def operands(surface: Column, command_pattern: str, script_first: bool) -> Column:
    """File operands after each occurrence of a command word, up to the end of its segment."""
    pattern = f"({command_pattern}){SEGMENT}"
    found = F.arrays_zip(_find_all(surface, pattern, 1).alias("head"),
                         _find_all(surface, pattern, 2).alias("tail"))

    def per_match(m: Column) -> Column:
        given = m["head"].rlike(SCRIPT_OPTION_INSIDE) if script_first else None
        return _segment_operands(m["tail"], given)

    return F.array_distinct(F.flatten(F.transform(found, per_match)))


def target_list(command: Column, surface: Column) -> Column:
    """``array<struct<path, kind>>`` of the files the text names as written.

    A path that two forms name keeps the form of higher precedence.
    """
    forms = F.struct(
        operands(surface, IN_PLACE, True).alias("IN_PLACE"),
        redirect_targets(surface).alias("REDIRECT"),
        operands(surface, TEE, False).alias("TEE"),
        script_targets(command).alias("SCRIPT"),
        F.concat(operands(surface, TRUNCATE, False), dd_targets(surface)).alias("CONTENT_TOOL"))

    def tagged(paths: Column, kind: str) -> Column:
        return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(kind).alias("kind")))

    def named(found: Column) -> Column:
        parts, seen = [], F.array().cast("array<string>")
        for kind in CONTENT_KINDS:
            fresh = F.array_except(found[kind], seen)
            parts.append(tagged(fresh, kind))
            seen = F.concat(seen, found[kind])
        return F.concat(*parts)

    # bound once, as the element of an array, so that no form is searched for twice
    return F.when(command.isNotNull(), F.get(F.transform(F.array(forms), named), F.lit(0)))


def referenced_paths(command: Column) -> Column:
    """Absolute then relative paths the text mentions, distinct, device files left out."""
    mentioned = F.concat(_find_all(command, ABSOLUTE), _find_all(command, RELATIVE))
    kept = F.filter(mentioned, lambda p: ~F.startswith(p, F.lit("/dev/"))
                    & ~F.startswith(p, F.lit("/proc/")))
    return F.array_distinct(kept)


def evidence_path(failed: Column, referenced: Column) -> Column:
    """The referenced path an evidence row shows: the failed one, its namesake, else the least."""
    namesakes = F.filter(referenced, lambda p: base_name(p) == base_name(failed))
    return F.coalesce(
        F.when(F.array_contains(referenced, failed), failed),
        F.try_element_at(namesakes, F.lit(1)),
        F.array_min(referenced))
