"""The analysis snapshot as one JSON document, and as rows for any size.

``report_rows`` is the whole report as ``(section, position, body)`` rows. A document is put
together from them only when they are few enough to be one, which is counted first.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators import board, cohorts, findings, judge
from sessionlens.operators.filters import Tables, UnknownFilterValue, vocabulary
from sessionlens.schema import PLANES

REPORT_AXES = ("harnessVersion", "model", "provider", "role")


def _section(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A section's rows with the sort values they are listed by, as text."""
    key = F.to_json(F.array(*[c.cast("string") for c in order])) if order else F.lit("")
    return df.select(F.lit(name).alias("section"), key.alias("sort_key"),
                     F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))


def _padded(number: Column) -> Column:
    """Greatest number first in text order."""
    return F.lpad((F.lit(Decimal(10 ** 19)) - number.cast("decimal(20,0)")).cast("string"), 20, "0")


def report_rows(t: Tables, group_by: str = "harnessVersion", baseline: str | None = None,
                candidate: str | None = None, recent: int = 50) -> DataFrame:
    """Every section of the report. No section carries an evidence excerpt."""
    plane = F.array_position(F.array(*[F.lit(p) for p in PLANES]), F.col("plane"))
    page, total = findings.findings_page(t, sort="time:desc", size=recent)
    parts = [
        _section(board.tiles(t), "tiles"),
        _section(board.plane_mix(t), "plane_mix", plane),
        _section(board.top_detectors(t), "top_detectors", _padded(F.col("count")),
                 F.col("detector")),
        _section(board.top_codes(t), "top_codes", _padded(F.col("count")), F.col("code")),
        _section(board.code_tail(t), "code_tail"),
        _section(board.daily_series(t), "series", F.col("day")),
        _section(board.step_throughput(t), "throughput", F.col("schema"), F.col("timing_source")),
        _section(vocabulary(t), "vocabulary", F.col("facet"), F.col("value")),
        _section(board.breakdown(t), "breakdown", _padded(F.col("count")),
                 *[F.coalesce(F.col(k), F.lit("")) for k in board.KIND]),
        _section(total, "findings_total"),
        _section(page, "recent_findings", _padded(F.col("occurred_at")), _padded(F.col("id"))),
    ]
    for axis in REPORT_AXES:
        parts.append(_section(cohorts.cohort_rates(t, axis), f"cohorts.{axis}", F.col("cohort")))
        parts.append(_section(cohorts.basis_note(t, axis), f"cohorts.{axis}.basis"))
    try:
        verdicts = judge.judge(t, group_by, baseline, candidate)
        parts.append(_section(
            verdicts, "judge",
            *[F.lpad(F.coalesce(c.cast("string"), F.lit("")), 4, "0")
              for c in judge.row_order()[:2]],
            _padded(F.col("baseline_count") + F.col("candidate_count")), F.col("key")))
    except (UnknownFilterValue, ValueError) as reason:
        spark = t.sessions.sparkSession
        note = f"no judge: {reason}; name two cohorts of {group_by} as baseline and candidate"
        parts.append(_section(spark.createDataFrame([(note,)], "note string"), "judge_note"))
    return reduce(DataFrame.unionByName, parts)


def write_report_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("section").json(path)


def report_document(rows: DataFrame) -> DataFrame:
    """One row, one column ``document``: the sections as arrays in their listing order.

    One document is one value; ``write_report_rows`` stores a report that outgrows one.
    """
    sections = rows.groupBy("section").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "body"))),
                    lambda r: r["body"]).alias("bodies"))
    return sections.agg(F.array_sort(F.collect_list(F.concat(
        F.to_json(F.array("section")).substr(F.lit(2), F.length(F.to_json(F.array("section"))) - 2),
        F.lit(":["), F.array_join("bodies", ","), F.lit("]")))).alias("s")) \
        .select(F.concat(F.lit("{"), F.array_join("s", ","), F.lit("}")).alias("document"))
