"""Findings pages, details, and the sequence of calls around every finding at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators.filters import (NO_FILTER, Filter, Tables, UnknownFilterValue,
                                           apply_axis, findings_in)
from sessionlens.operators.ordered import (BLOCK_BITS, TIME_BLOCK_BITS, as_of, with_position,
                                           with_sums)
from sessionlens.schema import STREAM
from sessionlens.session import materialise

SORT_COLUMNS = {"time": "occurred_at", "plane": "plane", "detector": "detector",
                "code": "code", "session": "session_id", "confidence": "confidence"}
DEFAULT_PAGE_SIZE = 20
DEFAULT_CONTEXT = 12


def sort_columns(token: str) -> list[Column]:
    """R2: ``key[:asc|desc]`` to order columns, case-insensitive, id breaking ties the same way."""
    key, _, direction = token.partition(":")
    direction = direction if ":" in token else "desc"
    column = SORT_COLUMNS.get(key.lower())
    if column is None:
        raise UnknownFilterValue("sort", key, list(SORT_COLUMNS))
    if direction.lower() not in ("asc", "desc"):
        raise UnknownFilterValue("sort", direction, ["asc", "desc"])
    if direction.lower() == "asc":
        return [F.asc_nulls_first(column), F.asc("id")]
    return [F.desc_nulls_last(column), F.desc("id")]


def beyond(sort: str, value, last_id: int) -> Column:
    """R1 by key: the rows that come after the row of (sort value, id) in the order of ``sort``."""
    key, _, direction = sort.partition(":")
    sort_columns(sort)
    column, same = F.col(SORT_COLUMNS[key.lower()]), F.lit(last_id)
    if direction.lower() == "asc":  # NULL first
        later, tied = F.col("id") > same, column == F.lit(value)
        if value is None:
            return column.isNotNull() | (column.isNull() & later)
        return (column > F.lit(value)) | (tied & later)
    later, tied = F.col("id") < same, column == F.lit(value)
    if value is None:
        return column.isNull() & later
    return (column < F.lit(value)) | (tied & later) | column.isNull()


def findings_page(t: Tables, f: Filter = NO_FILTER, *, plane: str | None = None,
                  detector: str | None = None, code: str | None = None,
                  session: str | None = None, sort: str = "time:desc", page: int = 0,
                  size: int = DEFAULT_PAGE_SIZE,
                  after: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of findings and the total, as two frames. A page is a top-k, never a full sort.

    ``after``: the (sort value, id) of the last row of the page before. Such a page holds ``size`` rows
    whatever comes ahead of it, and its condition reaches the scan; ``page`` alone counts its way there
    over all rows ahead, and is for the first few pages.
    """
    if page < 0:
        raise ValueError(f"page must be >= 0, was {page}")
    if size < 1:
        raise ValueError(f"size must be at least 1, was {size}")
    if after is not None and page:
        raise ValueError("a page follows a row or has a number, not both")
    rows = apply_axis(findings_in(t, f), plane, detector, code, session)
    seen = rows if after is None else rows.where(beyond(sort, *after))
    ordered = seen.orderBy(*sort_columns(sort))
    return ((ordered.offset(page * size) if page else ordered).limit(size),
            rows.agg(F.count(F.lit(1)).alias("total")))


def page_end(page: DataFrame, sort: str = "time:desc") -> tuple | None:
    """The (sort value, id) of a page's last row; None for an empty page."""
    rows = page.select(SORT_COLUMNS[sort.partition(":")[0].lower()], "id").collect()  # one page
    return tuple(rows[-1]) if rows else None


def tool_at(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """The tool a finding's seq points at, NULL for a seq that is no call."""
    names = calls.select(*STREAM, "seq", F.col("name").alias("tool"))
    return findings.join(names, [*STREAM, "seq"], "left")


def finding_detail(t: Tables) -> DataFrame:
    """Findings with their tool and evidence; the one read that returns excerpts.

    Restrict ``t.findings`` first to open a single finding.
    """
    evidence = t.evidence.groupBy(*STREAM, F.col("finding_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "seq", "verb_class", "path_hint", "excerpt_redacted"))).alias("evidence"))
    nothing = F.array().cast(evidence.schema["evidence"].dataType)
    return (tool_at(t.findings, t.calls).join(evidence, [*STREAM, "id"], "left")
            .withColumn("evidence", F.coalesce("evidence", nothing)))


def anchor_seq(findings: DataFrame, calls: DataFrame, bits: int = TIME_BLOCK_BITS) -> DataFrame:
    """Adds ``anchor``: a finding's own seq, else the greatest seq started by its time."""
    own = findings.where(F.col("seq").isNotNull()).withColumn("anchor", F.col("seq"))
    placed = as_of(findings.where(F.col("seq").isNull()), calls, STREAM, at="occurred_at",
                   order="started_at", payloads={"anchor": F.col("seq")}, inclusive=True,
                   greatest=True, bits=bits)
    return own.unionByName(placed)


@dataclass(frozen=True)
class Ladder:
    """The places of a set of streams, written once: what any window around a finding is read from.

    ``rungs`` has one row per seq at which a call, a finding or an anchor stands: the calls up to it
    (``number``), the findings before it and the findings through it. ``placed`` has the findings asked
    about, each with its anchor and that anchor's rung.
    """

    rungs: DataFrame
    placed: DataFrame


ASKED = ["id", "seq", "cause_seq", "stale_seq", "occurred_at"]


def ladder(findings: DataFrame, calls: DataFrame, bits: int = BLOCK_BITS,
           around: DataFrame | None = None) -> Ladder:
    """One scan by seq over calls, findings and the anchors of ``around`` (all findings if not given).

    The few narrow columns that the anchors (by time) and the rungs (by seq) need are written first, so
    that whatever ``findings`` and ``calls`` are derived from is read once for both.
    """
    findings = materialise(findings.select(*STREAM, *ASKED), "findings_seen")
    calls = materialise(calls.select(*STREAM, "seq", "started_at"), "calls_seen")
    asked = findings if around is None else around.select(*STREAM, *ASKED)
    anchored = materialise(anchor_seq(asked, calls).where(F.col("anchor").isNotNull()), "anchored")
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    stands = (
        calls.select(*STREAM, "seq", one.alias("call"), none.alias("found"))
        .unionByName(findings.where(F.col("seq").isNotNull())
                     .select(*STREAM, "seq", none.alias("call"), one.alias("found")))
        .unionByName(anchored.select(*STREAM, F.col("anchor").alias("seq"), none.alias("call"),
                                     none.alias("found")))
        .groupBy(*STREAM, "seq").agg(F.max("call").alias("call"), F.sum("found").alias("found"))
    )
    rungs = materialise(
        with_sums(stands, STREAM, "seq", {"number": F.col("call"), "through": F.col("found")}, bits)
        .select(*STREAM, "seq", (F.col("call") == 1).alias("is_call"), "number",
                (F.col("through") - F.col("found")).alias("before"), "through"), "rungs")
    at_anchor = rungs.select(*STREAM, F.col("seq").alias("anchor"), F.col("number").alias("upto"),
                             "before", "through")
    return Ladder(rungs, anchored.join(at_anchor, [*STREAM, "anchor"]))


def finding_context(findings: DataFrame, calls: DataFrame, window: int = DEFAULT_CONTEXT,
                    bits: int = BLOCK_BITS, steps: Ladder | None = None) -> DataFrame:
    """The calls around every finding, its own stream, unfiltered, marked.

    Calls are numbered inside their stream; a finding asks for the numbers around its anchor, so
    the join is on (stream, number) and grows with findings x window, not with pairs per stream.
    """
    if window < 1:
        raise ValueError(f"window must be at least 1, was {window}")
    steps = steps or ladder(findings, calls, bits)
    wanted = steps.placed.select(
        "id", *STREAM, "anchor", F.col("seq").alias("f_seq"), F.col("cause_seq").alias("f_cause"),
        F.col("stale_seq").alias("f_stale"),
        F.explode(F.sequence(F.col("upto") - window, F.col("upto") + window)).alias("number"))
    numbered = steps.rungs.where("is_call").select(*STREAM, "number", "seq")
    shown = wanted.join(numbered, [*STREAM, "number"]).join(
        calls.select(*STREAM, "seq", "name", "error_code", "plane", "path_hint", "duration_ms",
                     "started_at"), [*STREAM, "seq"])
    mark = (F.when(F.col("seq") == F.col("f_seq"), "finding")
            .when(F.col("seq") == F.col("f_cause"), "cause")
            .when(F.col("seq") == F.col("f_stale"), "stale"))
    return shown.select("id", *STREAM, "anchor", "seq", "name", "error_code", "plane", "path_hint",
                        "duration_ms", "started_at", mark.alias("mark"))


def neighbour_spans(steps: Ladder, window: int = DEFAULT_CONTEXT) -> DataFrame:
    """R7 for every finding at once: the ``filed`` places of its neighbours, from first to last.

    One row per finding however many findings stand around it. The neighbours are the findings from the
    first to the last call shown; in a stream without calls, those at the anchor itself.
    """
    calls = steps.rungs.where("is_call").select(*STREAM, "number", "before", "through")
    low = calls.select(*STREAM, F.col("number").alias("low"), F.col("before").alias("before_low"))
    high = calls.select(*STREAM, F.col("number").alias("high"), F.col("through").alias("through_high"))
    known = calls.groupBy(*STREAM).agg(F.max("number").alias("calls"))
    return (
        steps.placed.join(known, STREAM, "left")
        .withColumns({"low": F.greatest(F.col("upto") - window, F.lit(1)),
                      "high": F.least(F.col("upto") + window, F.col("calls"))})
        .join(low, [*STREAM, "low"], "left").join(high, [*STREAM, "high"], "left")
        .select("id", *STREAM, (F.coalesce("before_low", "before") + 1).alias("first"),
                F.when(F.col("calls").isNull(), F.col("through")).otherwise(F.col("through_high")).alias("last"))
    )


def filed(findings: DataFrame, steps: Ladder) -> DataFrame:
    """Findings with a seq, each with its ``place`` among those of its stream in order of (seq, id)."""
    before = steps.rungs.select(*STREAM, "seq", "before")
    # ids are spread over all 64-bit values: a seq's findings fall in at most 2 ** 16 blocks
    ranked = with_position(findings.where(F.col("seq").isNotNull()), [*STREAM, "seq"], "id", "__rank", 48)
    return (ranked.join(before, [*STREAM, "seq"])
            .withColumn("place", F.col("before") + F.col("__rank")).drop("before", "__rank"))


def neighbours(findings: DataFrame, calls: DataFrame, window: int = DEFAULT_CONTEXT,
               bits: int = BLOCK_BITS, around: DataFrame | None = None,
               steps: Ladder | None = None) -> DataFrame:
    """R7 spelled out: the findings among the calls shown around each finding, itself always there.

    ``around`` limits the findings whose surroundings are asked for; all of ``findings`` otherwise.
    The rows are the pairs themselves, which many findings around one call make many of: where each finding's
    neighbours only have to be known, take ``neighbour_spans``.
    """
    steps = steps or ladder(findings, calls, bits, around)
    as_neighbour = [F.col("id").alias("n_id"), F.col("detector").alias("n_detector"),
                    F.col("code").alias("n_code"), F.col("category").alias("n_category"),
                    F.col("seq").alias("n_seq")]
    found = ["id", *STREAM, "n_id", "n_detector", "n_code", "n_category", "n_seq"]
    spans = neighbour_spans(steps, window).where(F.col("last") >= F.col("first")) \
        .select("id", *STREAM, F.explode(F.sequence("first", "last")).alias("place"))
    others = (spans.join(filed(findings, steps).select(*STREAM, "place", *as_neighbour), [*STREAM, "place"])
              .where(F.col("n_id") != F.col("id")).select(*found))
    itself = (findings if around is None else around).select("id", *STREAM, *as_neighbour)
    return others.unionByName(itself.select(*found))
