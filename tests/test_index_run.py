"""A second run over the same folder: what it reads, writes, keeps and prunes."""

import os
import shutil
from pathlib import Path

import pytest
import zstandard
from logwriter import V0, Scene

from sessionlens.plans import index, sinks

CONFIG = index.IndexConfig(timeline=(("2026-09-01T00:00:00Z", "rules-v1"),))
BUCKETS = 8


def scene(name, day=1, **options):
    return (Scene(name, day, "/data/ops", "m-large", **options).reads_in_a_step("a.ini")
            .does("read", "deploy.sh").runs("printf done >> /data/ops/deploy.sh")
            .does("edit", "deploy.sh", "FS_STALE_VERSION"))


def raw(root, session, payload, compressed=True, slug="ops"):
    folder = os.path.join(root, slug, session)
    os.makedirs(folder, exist_ok=True)
    data = zstandard.ZstdCompressor().compress(payload) if compressed else payload
    Path(folder, V0).write_bytes(data)


def data_files(path):
    """Data file -> modification time."""
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def bucket_files(path, names):
    return {f for f in names if f"/bucket={path}/" in f}


def sessions(tables):
    return sorted(r.session_id for r in tables.sessions.collect())


def everything(tables):
    return [sorted(map(str, df.select(*sorted(df.columns)).collect()))
            for df in (tables.sessions, tables.steps, tables.calls, tables.findings, tables.evidence)]


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    root, path = (str(tmp_path_factory.mktemp(n)) for n in ("logs", "index"))
    for name in ("oak", "pine", "rowan"):
        scene(name).saved(root, "ops")
    raw(root, "blank", b"")
    raw(root, "hollow", b"", compressed=False)  # of no bytes at all: not listed, see scan_streams
    raw(root, "broken", b"{not json\n\n[1, \n")
    return root, path, index.index_run(spark, root, path, CONFIG, buckets=BUCKETS)


def test_files_without_a_good_line_are_sessions(spark, first):
    _, _, run = first
    assert sessions(run.tables) == ["blank", "broken", "oak", "pine", "rowan"]
    row = run.tables.sessions.where("session_id = 'broken'").head()
    assert (row.started_at, row.ended_at, row.fatal_turns, row.schema, row.project_slug, row.harness_version) == \
        (1, None, 0, "V0", "ops", "unknown")
    bad = {r.session_id: r.bad_lines for r in run.bad_lines.collect()}
    assert bad == {"blank": 0, "broken": 2, "oak": 0, "pine": 0, "rowan": 0}
    summary = sinks.run_summary(run.tables, run.bad_lines, run.pruned).head()
    assert (summary.streams, summary.sessions, summary.pruned, summary.parse_failures) == (5, 5, 0, 2)


def test_nothing_changed_nothing_written(spark, first):
    root, path, run = first
    before = data_files(path)
    again = index.index_run(spark, root, path, CONFIG)
    assert data_files(path) == before and everything(again.tables) == everything(run.tables)
    assert again.bad_lines.count() == 5 and again.pruned.count() == 0


def test_only_buckets_of_changed_and_vanished_files_are_written(spark, first, tmp_path):
    root, path = str(tmp_path / "logs"), str(tmp_path / "index")
    shutil.copytree(first[0], root)
    shutil.copytree(first[1], path)
    # the copied manifest names the first folder: under another root nothing may be pruned
    moved = index.index_run(spark, root, path, CONFIG)
    assert moved.pruned.count() == 0 and sessions(moved.tables) == sessions(first[2].tables)

    place = {r.session_id: r.b for r in moved.tables.sessions.select(
        "session_id", sinks.bucket_of(BUCKETS).alias("b")).collect()}
    before = data_files(path)
    longer = scene("oak").does("read", "lost.png", "FS_NOT_FOUND")
    longer.saved(root, "ops")
    shutil.rmtree(os.path.join(root, "ops", "pine"))
    run = index.index_run(spark, root, path, CONFIG)
    assert {r.session_id for r in run.pruned.collect()} == {"pine"}
    assert sessions(run.tables) == ["blank", "broken", "oak", "rowan"]
    assert run.tables.findings.where("session_id = 'oak' and code = 'FS_NOT_FOUND'").count() == 1
    after = data_files(path)
    assert before.items() <= after.items()
    written = {int(f.split("/bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()}
    assert written <= {place["oak"], place["pine"]}
    for df in (run.tables.steps, run.tables.calls, run.tables.findings, run.tables.evidence):
        assert df.where("session_id = 'pine'").count() == 0
    assert run.tables.calls.groupBy("session_id", "source_file", "seq").count().where("count > 1").count() == 0

    whole = index.index_run(spark, root, str(tmp_path / "fresh"), CONFIG, buckets=3)
    assert everything(whole.tables) == everything(run.tables)
    # a run that fell over after writing its version, before its pointer, shows nothing
    stray = sinks.open_index(spark, path).version + 1
    shutil.copytree(f"{path}/session/version={stray - 1}", f"{path}/session/version={stray}")
    assert everything(sinks.read_tables(spark, path)) == everything(run.tables)


def test_an_empty_or_other_root_prunes_nothing(spark, first, tmp_path):
    _, path, run = first
    empty = str(tmp_path / "empty")
    os.makedirs(empty)
    index_copy = str(tmp_path / "index")
    shutil.copytree(path, index_copy)
    with pytest.warns(UserWarning, match="no session logs") as said:
        other = index.index_run(spark, empty, index_copy, CONFIG)
    assert empty not in str(said[0].message)
    assert everything(other.tables) == everything(run.tables) and other.pruned.count() == 0


def test_declared_ids_and_shared_folder_names(spark, tmp_path):
    root = str(tmp_path / "logs")
    for slug, day in (("ops", 1), ("web", 2)):
        scene("twin", day).saved(root, slug)  # one id in two projects: the last by path stands
    lone = scene("declared")
    lone.saved(root, "ops")
    os.rename(f"{root}/ops/declared", f"{root}/ops/folder")
    t = index.index_run(spark, root, str(tmp_path / "index"), CONFIG, buckets=2).tables
    assert sessions(t) == ["declared", "twin"]
    assert t.sessions.where("session_id = 'twin'").head().project_slug == "web"
    assert {r.session_id for r in t.calls.collect()} == {"declared", "twin"}
    assert t.calls.groupBy("session_id", "source_file", "seq").count().where("count > 1").count() == 0


def test_a_streamed_file_written_anew_is_there_once(spark, tmp_path):
    from sessionlens.streaming.replay import index_stream

    root, path = str(tmp_path / "logs"), str(tmp_path / "index")
    scene("oak").saved(root, "ops")
    for checkpoint in ("a", "b"):  # a new checkpoint sees every file again
        index_stream(spark, root, path, str(tmp_path / checkpoint), CONFIG, buckets=2).awaitTermination()
        scene("oak").does("read", "lost.png", "FS_NOT_FOUND").saved(root, "ops")
    t = sinks.read_tables(spark, path)
    assert sessions(t) == ["oak"]
    assert t.findings.where("code = 'FS_NOT_FOUND'").count() == 1
    assert t.calls.groupBy("seq").count().where("count > 1").count() == 0
