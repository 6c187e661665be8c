"""End to end: log files to stored tables, with golden counts."""

import json

import pytest
from pyspark.sql import functions as F

from logwriter import Scene, write_corpus
from sessionlens.operators import findings
from sessionlens.operators.detectors import Detector, finding_rows
from sessionlens.operators.filters import Filter, UnknownFilterValue
from sessionlens.plans import index, questions, report, sinks
from sessionlens.sources import logs

TIMELINE = (("2026-09-01T00:00:00Z", "rules-v1"), ("2026-09-07T00:00:00Z", "rules-v2"))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    write_corpus(folder)
    return folder


@pytest.fixture(scope="module")
def run(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return index.index_run(spark, root, f"{out}/v1", index.IndexConfig(timeline=TIMELINE))


def counts(df, *keys):
    return {tuple(r[:-1]) if len(keys) > 1 else r[0]: r[-1]
            for r in df.groupBy(*keys).count().collect()}


#: What each session's situations must give, by the rules: (detector, category, code, detail).
EXPECTED = {
    "amber": [("error-plane", None, "SEARCH_FAILED", None),
              ("shell-edit", "DIRECT_MUTATION", None, "REDIRECT"),
              ("stamp-guard", "DIRECT_MUTATION", "FS_STALE_VERSION", None),
              ("stamp-guard", "VCS_RESTORE", "FS_STALE_VERSION", None)],
    "birch": [("retry-storm", None, "SERVER", None), ("shell-edit", "DIRECT_MUTATION", None, "SCRIPT"),
              ("stamp-guard", "DIRECT_MUTATION", "FS_STALE_VERSION", None)],
    "cedar": [("edit-miss", "MISS_AFTER_EDIT", "FS_EDIT_NOT_FOUND", None),
              ("edit-miss", "MISS_AFTER_READ", "FS_EDIT_NOT_FOUND", None),
              ("edit-miss", "REPEATED_MISS", "FS_EDIT_NOT_FOUND", None),
              ("fatal-turn", None, "INVALID_REQUEST", "prompt_too_long")],
    "dune": [("error-plane", None, "FS_NOT_FOUND", None),
             ("error-plane", None, "WEB_PROVIDER_CREDENTIAL_MISSING", None)],
    "elm": [("retry-storm", None, "TRANSPORT", None),
            ("stamp-guard", "EXTERNAL", "FS_STALE_VERSION", None)],
    "fjord": [("fatal-turn", None, "SERVER", "overloaded"),
              ("shell-edit", "DIRECT_MUTATION", None, "IN_PLACE")],
}
TOTAL = sum(map(len, EXPECTED.values()))


def test_scan(spark, root, tmp_path):
    streams = logs.scan_streams(spark, root)
    assert counts(streams, "project_slug", "schema") == {
        ("ops", "V0"): 1, ("ops", "V3"): 1, ("site", "V0"): 2, ("site", "V3"): 1,
        ("lab", "V0"): 1, ("lab", "V3"): 1}
    empty = str(tmp_path)
    assert logs.scan_streams(spark, empty).count() == 0 == logs.read_events(spark, empty).count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        logs.read_events(spark, str(tmp_path / "none")).count()


def test_folder_names_are_taken_as_they_are(spark, tmp_path):
    names = {"a+b", "a b", "c%20d", "pct%zz", "ü&x"}
    for name in names:
        Scene(name, 1, "/w").reads_in_a_step("f").saved(str(tmp_path), "p+q r")
    for found in (logs.scan_streams(spark, str(tmp_path)), logs.read_events(spark, str(tmp_path))):
        rows = found.select("session_id", "project_slug").distinct().collect()
        assert {r.session_id for r in rows} == names and {r.project_slug for r in rows} == {"p+q r"}


def test_findings(run):
    t = run.tables
    found = {}
    for r in t.findings.collect():
        found.setdefault(r.session_id, []).append((r.detector, r.category, r.code, r.detail))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        k: sorted(v, key=str) for k, v in EXPECTED.items()}
    assert t.sessions.count() == 7 and t.findings.select("id").distinct().count() == TOTAL
    assert counts(t.findings, "plane") == {"GUARD": 4, "INFRASTRUCTURE": 5, "MODEL_MISUSE": 8}
    assert run.bad_lines.agg(F.sum("bad_lines")).head()[0] == 1
    assert run.unmapped_codes.count() == 0
    assert t.findings.where("path_hint like '/%'").count() == 0
    assert t.evidence.where("path_hint like '/%'").count() == 0


def one(run, session, detector, category=None):
    rows = run.tables.findings.where(
        (F.col("session_id") == session) & (F.col("detector") == detector)
        & F.col("category").eqNullSafe(F.lit(category))).collect()
    assert len(rows) == 1
    return rows[0]


def test_what_a_finding_says(run):
    guard, edit = one(run, "amber", "stamp-guard", "DIRECT_MUTATION"), one(
        run, "amber", "shell-edit", "DIRECT_MUTATION")
    assert (guard.confidence, guard.path_hint, edit.confidence) == (0.9, "deploy.sh", 0.9)
    assert guard.stale_seq == edit.stale_seq < guard.cause_seq == edit.seq < guard.seq
    outside = one(run, "elm", "stamp-guard", "EXTERNAL")
    assert outside.cause_seq is None and outside.stale_seq is not None and outside.confidence is None
    assert one(run, "fjord", "shell-edit", "DIRECT_MUTATION").confidence == 0.6  # named without folder
    assert "2 retries" in one(run, "birch", "retry-storm").summary
    assert "prompt_too_long" in one(run, "cedar", "fatal-turn").summary
    assert one(run, "birch", "stamp-guard", "DIRECT_MUTATION").source_file.endswith("v3.jsonl.zstd")


def test_steps(run):
    got = counts(run.tables.steps, "timing_source", "decode_tps", "ttft_ms", "output_tokens")
    assert got == {("chunk-events", 155 / 2.2, 3200, 155): 4, ("embedded-stream", 190 / 2.7, 900, 190): 2,
                   ("none", None, None, 77): 1}


def test_sessions(run):
    rows = {(r.session_id, r.schema): r for r in run.tables.sessions.collect()}
    assert {k: (r.model, r.harness_version, r.role, r.fatal_turns) for k, r in rows.items()} == {
        ("amber", "V0"): ("m-large", "rules-v1", "orchestrator", 0),
        ("birch", "V3"): ("m-small", "rules-v2", "subagent", 0),
        ("cedar", "V0"): ("m-small", "rules-v1", "orchestrator", 1),
        ("dune", "V0"): ("m-large", "rules-v1", "orchestrator", 0),
        ("dune", "V3"): ("m-large", "rules-v1", "orchestrator", 0),
        ("elm", "V0"): (None, "rules-v2", "orchestrator", 0),
        ("fjord", "V3"): ("m-large", "rules-v2", "orchestrator", 1)}
    assert rows[("cedar", "V0")].agent_preset is None and rows[("birch", "V3")].agent_preset == "planner"
    assert "cwd" not in run.tables.sessions.columns


def test_privacy(run):
    for table in (run.tables.sessions, run.tables.steps, run.tables.calls, run.tables.findings,
                  run.tables.evidence):
        assert not {"line", "command", "abs_path", "cwd", "text"} & set(table.columns)


def test_detail_and_context(run):
    t = run.tables
    guard = one(run, "amber", "stamp-guard", "VCS_RESTORE")
    outside = one(run, "elm", "stamp-guard", "EXTERNAL")
    detail = {r.id: r for r in findings.finding_detail(t).collect()}
    assert detail[guard.id].tool == "write" and detail[outside.id].evidence == []
    assert [(e.verb_class, e.path_hint) for e in detail[guard.id].evidence] == [
        ("VCS_RESTORE", "roles.yml")]
    ctx = findings.finding_context(t.findings, t.calls)
    marks = {r["mark"] for r in ctx.where(F.col("id") == guard.id).collect()}
    assert marks == {"finding", "cause", "stale", None}


def test_report(run, spark):
    rows = report.report_rows(run.tables, "harnessVersion")
    document = json.loads(report.report_document(rows).head()[0])
    assert document["tiles"][0]["findings"] == TOTAL
    assert document["tiles"][0]["sessions"] == 6
    assert [p["plane"] for p in document["plane_mix"]] == ["INFRASTRUCTURE", "GUARD", "MODEL_MISUSE"]
    assert document["judge"][0]["scope"] == "total"
    assert [r["key"] for r in document["judge"][1:4]] == ["INFRASTRUCTURE", "GUARD", "MODEL_MISUSE"]
    assert len(document["recent_findings"]) == TOTAL
    times = [f["occurred_at"] for f in document["recent_findings"]]
    assert times == sorted(times, reverse=True)
    assert "excerpt" not in json.dumps(document)
    no_judge = report.report_rows(run.tables, "provider", baseline="nowhere")
    note = no_judge.where("section = 'judge_note'").head().body
    assert "no judge" in note


def test_questions(run):
    t = run.tables
    assert questions.overview(t, Filter(model="m-large"))["tiles"].head().sessions == 3
    assert questions.breakdown(t).agg(F.sum("count")).head()[0] == TOTAL
    with pytest.raises(UnknownFilterValue):
        questions.overview(t, Filter(model="M-LARGE"))
    rows, note = questions.cohort_table(t, "harnessVersion", timeline_configured=True)
    assert [r.cohort for r in rows.collect()] == ["rules-v1", "rules-v2"]
    assert "configured harness timeline" in note.head().note
    with pytest.raises(UnknownFilterValue):
        questions.cohort_table(t, "model", baseline="gone")
    verdicts, basis = questions.judgement(t, "harnessVersion")
    assert verdicts.head().scope == "total" and "no session states it" in basis
    page, total = questions.findings_page(t, detector="edit-miss", sort="time:asc", size=2)
    assert [r.category for r in page.collect()] == ["MISS_AFTER_READ", "MISS_AFTER_EDIT"]
    assert total.head().total == 3
    with pytest.raises(UnknownFilterValue):
        questions.findings_page(t, session="zebra")
    guard = one(run, "amber", "stamp-guard", "DIRECT_MUTATION")
    assert questions.finding(t, guard.id).head().tool == "edit"
    assert questions.finding(t, 1).count() == 0
    calls, near = questions.context(t, guard.id, window=2)
    assert [c.mark for c in calls.collect()][:3] == ["stale", "cause", "finding"]
    assert {n.n_detector for n in near.collect()} >= {"stamp-guard", "shell-edit"}
    fatal = one(run, "fjord", "fatal-turn")
    calls, near = questions.context(t, fatal.id, window=1)
    assert [c.name for c in calls.collect()][-1] == "bash"


def test_rerun_is_idempotent_and_prunes(spark, root, run, tmp_path):
    t = run.tables
    again = sinks.merge_facts(t, t)
    for a, b in ((t.findings, again.findings), (t.calls, again.calls), (t.steps, again.steps)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    scanned = t.sessions.where("session_id <> 'cedar'")
    left = sinks.prune(t, scanned)
    assert left.sessions.count() == 6 and left.findings.where("session_id='cedar'").count() == 0
    summary = sinks.run_summary(left, run.bad_lines, sinks.pruned_streams(t.sessions, scanned)).head()
    assert (summary.streams, summary.pruned, summary.parse_failures) == (6, 1, 1)
    sinks.write_facts(left, str(tmp_path / "prev"))
    second = index.index_run(spark, root, str(tmp_path / "next"),
                             index.IndexConfig(timeline=TIMELINE, store_evidence=False),
                             previous=str(tmp_path / "prev"))
    assert second.tables.findings.count() == TOTAL
    assert second.pruned.count() == 0
    assert second.tables.evidence.where("session_id = 'amber'").count() == 0


def test_added_detector(spark, root):
    parsed = logs.parse_events(logs.read_events(spark, root))
    events = logs.good_events(parsed)
    from sessionlens.operators import detectors as d

    def slow(facts):
        late = facts.calls.where("error_code = 'SEARCH_FAILED'")
        return finding_rows(late, "search-watch", plane=F.lit("MODEL_MISUSE"),
                            code=F.col("error_code"), seq=F.col("seq"),
                            occurred_at=F.col("ended_at"), summary=F.lit("search failed"))

    registry = d.register(d.default_detectors(),
                          Detector("search-watch", slow, frozenset({"SEARCH_FAILED"})))
    found = d.detect_all(index.derive_facts(events), registry)
    assert counts(found.where("code = 'SEARCH_FAILED'"), "detector") == {"search-watch": 1}
    with pytest.raises(ValueError):
        d.register(registry, Detector("again", slow, frozenset({"SEARCH_FAILED"})))


def test_streamed_index_equals_batch(spark, root, run, tmp_path):
    from sessionlens.streaming.replay import index_stream

    query = index_stream(spark, root, str(tmp_path / "out"), str(tmp_path / "cp"),
                         index.IndexConfig(timeline=TIMELINE), files_per_batch=5)
    query.awaitTermination()
    streamed = sinks.read_tables(spark, str(tmp_path / "out"))
    assert counts(streamed.findings, "detector") == counts(run.tables.findings, "detector")
    same = [c for c in run.tables.steps.columns]
    assert sorted(map(str, streamed.steps.select(*same).collect())) == \
        sorted(map(str, run.tables.steps.collect()))
