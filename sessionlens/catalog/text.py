"""Text jobs over the document, page and conversation tables: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import shell as sh
from sessionlens.functions import text as tx
from sessionlens.operators import commands
from sessionlens.sources.tables import load, pick, spread

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


CREDENTIAL = (r"(?i)\b(token|secret|password|passwd|api[_-]?key|authorization|bearer)\b"
              r"\s*[=:]?\s*\S+")
OPAQUE = "[A-Za-z0-9+/_=-]{24,}"


def masked_sql(text: str) -> str:
    return (f"regexp_replace(regexp_replace({text}, '{CREDENTIAL}', '\\1=[REDACTED]', 'g'), "
            f"'{OPAQUE}', '[REDACTED]', 'g')")


def _redact(table: str, key: str, text: str):
    first = f"regexp_extract({text}, '^([^\\r\\n]*)', 1)"
    sql = f"""
WITH m AS (SELECT {key}, {masked_sql(first)} AS line, {masked_sql(text)} AS whole FROM {table})
SELECT {key}, CASE WHEN length(line) > 160 THEN left(line, 160) || '…' ELSE line END AS excerpt,
  CAST(len(string_split(whole, '[REDACTED]')) - 1 AS INTEGER) AS masks, md5(whole) AS whole_md5 FROM m"""

    def run(spark, sf):
        rows = spread(load(spark, sf, table).select(key, text))
        whole = tx.mask_secrets(F.col(text))
        return rows.select(
            key, tx.redact_excerpt(F.col(text)).alias("excerpt"),
            (F.size(F.split(whole, r"\[REDACTED\]")) - 1).alias("masks"),
            F.md5(whole).alias("whole_md5"))
    query(f"redact_{table}", sql)(run)


_redact("documents", "doc_id", "text")
_redact("conversations", "conv_id", "text")

# RE2 has no look-ahead: "/ followed by anything but dev/" is spelled out
NOT_DEV = (r"/(?:[^\sd]|d(?:[^e]|$)|de(?:[^v]|$)|dev(?:[^/]|$))")
VERB_SQL = r"""CASE
  WHEN regexp_matches({0}, '\bgit\s+(?:checkout|restore|stash|reset|clean|revert|pull|merge|rebase|switch)\b') THEN 'VCS_RESTORE'
  WHEN regexp_matches({0}, '\b(?:sed|perl)\s+(?:[^\s;&|]+\s+){{0,16}}?-[A-Za-z]*i\b') THEN 'MUTATING'
  WHEN regexp_matches({0}, '>>?\s*(?:NOT_DEV|\./\S|~/\S|[A-Za-z_][A-Za-z0-9_./-]*)') THEN 'MUTATING'
  WHEN regexp_matches({0}, '\b(?:tee|truncate|cp|mv|rm|install|patch|touch|mkdir|chmod|chown|ln|dd)\b') THEN 'MUTATING'
  WHEN regexp_matches({0}, 'open\([^)]{{0,60}}[''"][wax]|writeFileSync|writeFile\s*\(|writeText\s*\(|\.write_(?:text|bytes)\s*\(|createWriteStream|\.write\s*\(|File\.write|fwrite\(') THEN 'MUTATING'
  WHEN regexp_matches({0}, '\b(?:cat|head|tail|wc|ls|cd|pwd|echo|printf|grep|rg|ag|find|fd|stat|file|du|df|less|more|jq|awk|cut|sort|uniq|diff|comm)\b') THEN 'READ_ONLY'
  WHEN regexp_matches({0}, '\bsed\s+-n\b|\bgit\s+(?:status|log|diff|show|blame|ls-files)\b') THEN 'READ_ONLY'
  WHEN {0} IS NOT NULL THEN 'OTHER' END""".replace("NOT_DEV", NOT_DEV)


def _verb(table: str, key: str, text: str):
    query(f"verb_class_{table}", f"SELECT {key}, {VERB_SQL.format(text)} AS verb_class FROM {table}")(
        lambda spark, sf: spread(load(spark, sf, table).select(key, text)).select(
            key, sh.verb_class(F.col(text)).alias("verb_class")))


_verb("documents", "doc_id", "text")
_verb("pages", "page_id", "html")


@query("page_url_hint", """
SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN nullif(substr(url, 9), '?')
  ELSE regexp_extract(url, '[^/]*$') END AS hint FROM pages""")
def _url_hint(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id", tx.path_hint(F.col("url"), F.lit("https://")).alias("hint"))


ABSOLUTE_SQL = r"""
WITH a AS (SELECT page_id, list_filter(regexp_extract_all(html,
    '/[A-Za-z0-9._~+-](?:[^\s''"`;|&<>()]*[A-Za-z0-9._~+-])?'),
    lambda p: NOT starts_with(p, '/dev/') AND NOT starts_with(p, '/proc/')) AS l FROM pages),
o AS (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM a),
f AS (SELECT page_id, p, min(i) AS i FROM o GROUP BY page_id, p),
r AS (SELECT page_id, string_agg(p, ' ' ORDER BY i) AS paths FROM f GROUP BY page_id)
SELECT page_id, coalesce(paths, '') AS paths FROM pages LEFT JOIN r USING (page_id)"""


@query("referenced_paths_pages", ABSOLUTE_SQL)
def _paths(spark, sf):
    """The absolute paths that each page mentions; SQL has no look-around for the relative ones."""
    absolute = F.filter(sh.referenced_paths(F.col("html")), lambda p: F.startswith(p, F.lit("/")))
    return spread(load(spark, sf, "pages").select("page_id", "html")).select(
        "page_id", F.array_join(absolute, " ").alias("paths"))


@query("document_commands")
def _document_commands(spark, sf):
    """Every classified fact of every document taken as a command text."""
    rows = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return commands.target_kinds(commands.classify(rows, "text")).select(
        "doc_id", "verb_class", "write_kind",
        F.array_join(F.map_keys("target_kinds"), " ").alias("targets"),
        F.array_join("referenced", " ").alias("referenced"), "excerpt")


@query("shell_surface", """
SELECT conv_id, turn, md5(pre || '''''' || chr(10) || '''''' || post || chr(10)) AS surface_md5 FROM (
  SELECT conv_id, turn, 'run <<END ' AS pre, ' ' || role AS post FROM conversations)""")
def _surface(spark, sf):
    """Each message as a heredoc body and as a quoted string: neither may reach the surface."""
    rows = load(spark, sf, "conversations")
    safe = F.regexp_replace("text", "['\"\\\\]", "")
    command = F.concat(F.lit("run <<END '"), F.regexp_replace(safe, r"\n", " "), F.lit("'\n"), safe,
                       F.lit("\n  END\n\""), safe, F.lit("\" "), F.col("role"))
    return rows.select("conv_id", "turn", F.md5(sh.shell_surface(command)).alias("surface_md5"))


DETAIL_KINDS = 6


@query("provider_detail", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN lang END AS detail FROM documents""")
def _detail(spark, sf):
    """Failure messages around each document: typed code, nested code, type beside a numeric code,
    then a sentence, prose and a broken body, which yield nothing."""
    text = F.to_json(F.struct(F.col("text").alias("message")))
    inner = F.substring(text, 2, 2_147_483_647)
    message = pick(F.col("doc_id"), list(range(DETAIL_KINDS)))
    body = (F.when(message == 0, F.concat(F.lit('400: {"code":"'), F.col("source"), F.lit('",'), inner))
            .when(message == 1, F.concat(F.lit(' 500: {"error":{"code":"'), F.col("source"),
                                         F.lit('"},'), inner, F.lit("\n")))
            .when(message == 2, F.concat(F.lit('503: {"code":503,"type":"'), F.col("lang"),
                                         F.lit('",'), inner))
            .when(message == 3, F.concat(F.lit('400: {"code":"not a constant",'), inner))
            .when(message == 4, F.col("text"))
            .otherwise(F.concat(F.lit('400: {"code":"X",'), F.lit("oops}"))))
    return load(spark, sf, "documents").select("doc_id", tx.provider_detail(body).alias("detail"))


@query("dd_targets", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/w/out/' || event_id || '.bin' WHEN 1 THEN 'rel/' || event_id || '.img' ELSE '' END AS paths,
  CASE WHEN event_id % 3 < 2 THEN 'CONTENT_TOOL' ELSE '' END AS kinds FROM events""")
def _dd(spark, sf):
    """What ``dd`` writes, as a map of path to form: an absolute, a relative path, and a command only named alike."""
    i = F.col("event_id").cast("string")
    text = pick(F.col("event_id"), [0, 1, 2])
    command = (F.when(text == 0, F.concat(F.lit("dd if=/dev/zero of=/w/out/"), i, F.lit(".bin bs=1")))
               .when(text == 1, F.concat(F.lit("cd /w && dd of=rel/"), i, F.lit(".img if=a count=2")))
               .otherwise(F.concat(F.lit("ddrescue of=/w/no/"), i, F.lit(" a b"))))
    rows = commands.target_kinds(commands.classify(
        load(spark, sf, "events").select("event_id", command.alias("command"))))
    return rows.select("event_id", F.array_join(F.map_keys("target_kinds"), ",").alias("paths"),
                       F.array_join(F.map_values("target_kinds"), ",").alias("kinds"))
