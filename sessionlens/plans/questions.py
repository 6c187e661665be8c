"""The questions asked of an index, each with its checks: what a dashboard or a notebook calls.

Filter values are checked against the vocabulary first, so a value that does not exist raises with
the allowed ones and never reads as "nothing matched". Answers are lazy DataFrames.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.operators import board, cohorts, findings, judge
from sessionlens.operators.filters import (NO_FILTER, Filter, Tables, require_known,
                                           validate_filter, vocabulary)
from sessionlens.schema import STREAM


def overview(t: Tables, f: Filter = NO_FILTER) -> dict[str, DataFrame]:
    validate_filter(t, f)
    return {
        "tiles": board.tiles(t, f),
        "plane_mix": board.plane_mix(t, f),
        "top_detectors": board.top_detectors(t, f),
        "top_codes": board.top_codes(t, f),
        "code_tail": board.code_tail(t, f),
        "series": board.daily_series(t, f),
        "throughput": board.step_throughput(t, f),
        "vocabulary": vocabulary(t),
    }


def breakdown(t: Tables, f: Filter = NO_FILTER) -> DataFrame:
    validate_filter(t, f)
    return board.breakdown(t, f)


def cohort_table(t: Tables, axis: str, f: Filter = NO_FILTER, baseline: str | None = None,
                 timeline_configured: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cohort rows in key order, and the one-row note on their basis."""
    cohorts.axis_column(axis)
    validate_filter(t, f)
    if baseline is not None:
        cohorts.require_cohort(cohorts.cohort_counters(t, axis, f), "baseline", baseline)
    return (cohorts.cohort_rates(t, axis, f, baseline).orderBy("cohort"),
            cohorts.basis_note(t, axis, f, baseline, timeline_configured))


def judgement(t: Tables, axis: str, baseline: str | None = None, candidate: str | None = None,
              f: Filter = NO_FILTER) -> tuple[DataFrame, str]:
    """The judged rows in their order, and the note on how to read them."""
    counters = cohorts.cohort_counters(t, axis, f)
    validate_filter(t, f)
    base, cand = judge.choose_pair(counters, baseline, candidate)
    inferred = cohorts.basis_note(t, axis, f, baseline).head().all_inferred
    return (judge.judge(t, axis, base, cand, f),
            judge.judge_basis(axis, inferred, baseline is None, f))


def findings_page(t: Tables, f: Filter = NO_FILTER, *, plane: str | None = None,
                  detector: str | None = None, code: str | None = None,
                  session: str | None = None, sort: str = "time:desc", page: int = 0,
                  size: int = findings.DEFAULT_PAGE_SIZE,
                  after: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    validate_filter(t, f)
    axis = {"plane": plane, "detector": detector, "code": code, "session": session}
    for name, value in axis.items():
        require_known(t, name, value)
    return findings.findings_page(t, f, **axis, sort=sort, page=page, size=size,
                                  after=after)


def finding(t: Tables, finding_id: int) -> DataFrame:
    """One finding with its tool and evidence; no row when there is no such id."""
    one = replace(t, findings=t.findings.where(F.col("id") == finding_id),
                  evidence=t.evidence.where(F.col("finding_id") == finding_id))
    return findings.finding_detail(one)


def context(t: Tables, finding_id: int, window: int = findings.DEFAULT_CONTEXT,
            ) -> tuple[DataFrame, DataFrame]:
    """The calls around one finding in order, and the findings among them.

    Only the finding's own stream is numbered; both answers are empty for an unknown id.
    """
    one = t.findings.where(F.col("id") == finding_id)
    stream = one.select(*STREAM)
    calls = t.calls.join(stream, STREAM, "left_semi")
    own = t.findings.join(stream, STREAM, "left_semi")
    steps = findings.ladder(own, calls, around=one)
    near = findings.neighbours(own, calls, window, around=one, steps=steps)
    return (findings.finding_context(one, calls, window, steps=steps).orderBy("seq"),
            near.orderBy("n_seq", "n_id"))
