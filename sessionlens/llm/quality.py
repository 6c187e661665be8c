"""Line-first cleaning.

Each line of a text is judged by itself: is it navigation, boilerplate, or without the punctuation and
letters of prose? Failing lines go; a document that loses more than a share of its text this way goes
with them. Everything is an expression over one row, so a text is read once and nothing is shuffled.

Repeated five-word windows are found inside the row: window hashes are compared as a set first, and
only a text that has repeats sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20

# Line rules. Patterns stay within what both Java and RE2 read alike.
SEPARATORS = r"[|•·»›]"
MIN_SEPARATORS = 3
MENU = (r"^(home|menu|login|log in|logout|log out|sign in|sign up|register|search|contact|contact us"
        r"|about|about us|next|previous|next page|previous page|read more|share|share this|subscribe"
        r"|sitemap|site map|back to top|skip to content|follow us|print|download)[ |>»:.]*$")
BOILERPLATE = (r"all rights reserved|privacy policy|cookie policy|uses? cookies|accept (all )?cookies"
               r"|terms of (use|service)|enable javascript|javascript is (disabled|required)"
               r"|powered by |lorem ipsum|click here to|subscribe to our newsletter")
NO_LETTER = r"^[^\p{L}]*$"
ENDED = r"[.!?…:;。！？][\"'”’»)\]]*$"
MIN_UNENDED_WORDS = 3
MAX_LOST_SHARE = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule."""
    low = F.lower(F.regexp_replace(line, f"^{SPACE}|{SPACE}$", ""))
    words = F.size(_words(line))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = ((separators >= MIN_SEPARATORS) & (separators * 4 >= words)) | low.rlike(MENU)
    punctuation = low.rlike(NO_LETTER) | (~low.rlike(ENDED) & (words < MIN_UNENDED_WORDS))
    return navigation | low.rlike(BOILERPLATE) | punctuation


def _repeated_words() -> Column:
    """How many words lie in a window that the text has twice or more."""
    spread = F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.sort_array(spread)

    def positions(rows: Column) -> Column:
        alike = lambda a, b: F.coalesce(F.get(rows, a)["h"] == F.get(rows, b)["h"], F.lit(False))
        return F.sort_array(F.filter(
            F.transform(rows, lambda r, j: F.when((j > 0) & alike(j, j - 1) | alike(j, j + 1), r["i"])),
            lambda i: i.isNotNull()))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(found, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    # each array is bound once, as the single element of an array that is then transformed
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return once(ordered, lambda rows: once(positions(rows), covered))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text",
          lost: float = MAX_LOST_SHARE) -> DataFrame:
    """One row per document: key, the base counts, base_failed, the line verdicts and kept.

    ``n_lines`` lines have a word, ``n_failed_lines`` of them break a rule, ``lost_chars`` of
    ``line_chars`` characters go with them; ``clean_text`` is what stays, its blank lines included.
    ``kept`` is false where the base fails or more than the ``lost`` share of the text goes.

    An absent text has no words, fails the base and stays absent in ``clean_text``; an empty one is
    empty. Repeated rows are judged one by one, an absent key is carried. An empty table gives no
    rows. Other columns are not carried.
    """
    return _judged(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), lost).select(
        F.col("_key").alias(key), *VERDICT)


def cleaned(docs: DataFrame, text: str = "text", lost: float = MAX_LOST_SHARE) -> DataFrame:
    """The documents that are kept, all their columns, with their failing lines removed."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                         docs[text].alias("_text"))
    # a generator, as a filter would be pushed below the steps and spell each of them out again
    row = F.when(F.col("kept"), F.array(F.struct("_row", "clean_text")))
    return _judged(packed, lost).select(F.explode(row).alias("_kept")).select(*[
        F.col("_kept.clean_text").alias(c) if c == text else
        F.col("_kept._row").getField(c).alias(c) for c in docs.columns])


VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_lines", "n_failed_lines", "line_chars", "lost_chars", "clean_text", "kept"]


def _judged(rows: DataFrame, lost: float) -> DataFrame:
    """``rows`` with the verdict on their column ``_text``."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    split = rows.select("*", _words(body).alias("_words"), F.split(body, "\n").alias("_all_lines"))
    hashed = split.select(
        "*",
        F.filter("_all_lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(F.size("_words") > WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))).alias("_hash"))
    failed = hashed.select("*", F.filter("_lines", _fails).alias("_failed"))
    chars = lambda lines: F.length(F.array_join(lines, ""))
    repeats = F.size(F.array_distinct("_hash")) < F.size("_hash")
    counted = failed.select(
        *rows.columns, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _repeated_words()).otherwise(0).cast("long")
        .alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"), F.size("_failed").alias("n_failed_lines"),
        chars("_lines").alias("line_chars"), chars("_failed").alias("lost_chars"),
        F.when(F.size("_failed") == 0, F.col("_text")).otherwise(F.array_join(
            F.filter("_all_lines", lambda line: ~F.array_contains("_failed", line)), "\n")).alias("clean_text"))
    base = ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return counted.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= lost * F.col("line_chars")))
