"""What the plans must look like whatever the data: no pairs, no Python, filters at the scan."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionlens.operators import board, cohorts, facts
from sessionlens.operators.filters import Filter, Tables
from sessionlens.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1_000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "tiles_windowed", "breakdown", "daily_series", "step_throughput", "cohort_rates", "judge",
    "findings_page", "finding_context", "neighbours", "step_assembly", "call_result_pairs",
    "error_plane", "edit_miss", "stamp_guard", "shell_edit", "redact_documents"])
def test_no_pairs_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "MapInPandas", "FlatMapGroups", "Scan ExistingRDD"):
        assert bad not in text, bad


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    made = src.stored_tables(spark, SF)
    out = {}
    for name in ("sessions", "steps", "calls", "findings"):
        getattr(made, name).write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return Tables(**out)


def scans(df):
    return [(re.search(r"PushedFilters: \[(.*?)\], ReadSchema", s).group(1),
             re.search(r"ReadSchema: struct<(.*?)>", s).group(1))
            for s in plan(df).split("FileScan parquet")[1:]]


def test_window_and_columns_reach_the_scan(stored):
    (pushed, schema), = scans(board.top_codes(stored, Filter(start=5, end=9)))
    assert "GreaterThanOrEqual(occurred_at,5)" in pushed and "LessThanOrEqual(occurred_at,9)" in pushed
    assert {c.split(":")[0] for c in schema.split(",")} == {"code", "occurred_at"}


def test_no_facet_means_no_join(stored):
    assert "Join" not in plan(board.daily_series(stored))
    assert "Join" in plan(board.daily_series(stored, Filter(schema="V0")))


def test_each_table_is_read_once_for_a_cohort_table(stored):
    read = scans(cohorts.cohort_rates(stored, "schema"))
    by_time = [s for _, s in read if "outcome_only" in s or "plane" in s]
    assert len(by_time) == 2
    assert all("summary" not in s and "path_hint" not in s for _, s in read)


def test_folds_read_only_their_lines(spark, tmp_path):
    src.event_log(spark, SF).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    for pushed, schema in scans(facts.assemble_steps(events)):
        assert "In(type" in pushed and "command" not in schema and "arg_path" not in schema
    for pushed, schema in scans(facts.pair_calls(events)):
        assert "In(type" in pushed or "EqualTo(type" in pushed
        assert "command" not in schema


@pytest.mark.parametrize("name", ["step_assembly", "call_result_pairs", "edit_miss"])
def test_folds_carry_fixed_widths(spark, name):
    assert "SortAggregate" not in plan(entry.queries()[name](spark, SF))


def test_page_is_a_top_k(stored):
    from sessionlens.operators import findings

    page, _ = findings.findings_page(stored)
    assert "TakeOrderedAndProject" in plan(page)


def test_a_context_reads_each_table_at_most_twice(stored, monkeypatch):
    """Scans of the tables in every plan that runs, those written on the way included."""
    from sessionlens.operators import findings

    written = []

    def write(df, name, folder=None, through=findings.materialise):
        written.append(df)
        return through(df, name, folder)

    monkeypatch.setattr(findings, "materialise", write)
    steps = findings.ladder(stored.findings, stored.calls)
    last = findings.finding_context(stored.findings, stored.calls, steps=steps)
    spans = findings.neighbour_spans(steps)
    reads = {}
    for df in [*written, last, spans]:
        df.collect()  # the plan as it ended, with the shuffles it used again
        final = plan(df).split("== Initial Plan ==")[0]
        for place in re.findall(r"Location: InMemoryFileIndex\(1 paths\)\[[^\]]*/(\w+)\]", final):
            reads[place] = reads.get(place, 0) + 1
    assert reads["calls"] == 2 and reads["findings"] == 1, reads


def test_a_page_by_key_is_cut_at_the_scan(stored):
    from sessionlens.operators import findings

    page, _ = findings.findings_page(stored, sort="time:asc", after=(1_000, 7))
    (pushed, _), = scans(page)
    assert "GreaterThan(occurred_at,1000)" in pushed and "Offset" not in plan(page)


def test_one_stream_with_most_rows_gives_the_same_answer(spark):
    """The same log with all users but a few folded into one stream: block size must not matter."""
    log = src.event_log(spark, SF).withColumn(
        "session_id", F.when(F.col("pos") % 10 < 7, "hot").otherwise(F.col("session_id")))
    for fold in (facts.assemble_steps, facts.pair_calls):
        a, b = fold(log, 2), fold(log, 30)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
