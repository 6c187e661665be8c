"""The event folds and detectors on hand-built and random streams."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import detectors, facts
from sessionlens.operators.detectors import Facts
from sessionlens.schema import EVENT_COLUMNS
from sessionlens.sources import dimensions, logs

TYPES = {
    "session_id": "string", "source_file": "string", "project_slug": "string", "schema": "string",
    "pos": "bigint", "type": "string", "seq": "bigint", "time": "bigint", "header_id": "string",
    "created_at": "bigint", "cwd": "string", "agent_preset": "string", "delegation_depth": "int",
    "turn": "int", "step": "int", "model": "string", "provider": "string", "context_window": "int",
    "input_tokens": "int", "output_tokens": "int", "stream_first": "bigint", "stream_last": "bigint",
    "call_id": "string", "name": "string", "arg_path": "string", "arg_partial": "boolean",
    "command": "string", "error_code": "string", "meta_path": "string", "retry_code": "string",
    "reason_kind": "string", "fatal_code": "string", "fatal_detail": "string",
}


def log(spark, rows, stream="s"):
    """Events in file order; seq defaults to the position, time to ten per position."""
    full = []
    for i, (kind, fields) in enumerate(rows):
        row = dict.fromkeys(EVENT_COLUMNS)
        row |= {"session_id": stream, "source_file": "f", "pos": i, "seq": i, "time": i * 10,
                "type": kind} | fields
        full.append(tuple(row[c] for c in EVENT_COLUMNS))
    return spark.createDataFrame(full, ", ".join(f"{c} {TYPES[c]}" for c in EVENT_COLUMNS))


def call(name, path=None, cid=None, **more):
    return ("tool/call", {"name": name, "arg_path": path, "call_id": cid, "arg_partial": False} | more)


def result(cid, code=None, **more):
    return ("tool/result", {"call_id": cid, "error_code": code} | more)


def tool(name, path=None, code=None, cid=[0], **more):
    cid[0] += 1
    return [call(name, path, f"c{cid[0]}", **more), result(f"c{cid[0]}", code)]


def shell(command):
    return tool("bash", command=command)


def found(spark, rows, which):
    return sorted((r for r in which(Facts(log(spark, sum(rows, [])))).collect()), key=lambda r: r.seq)


# --- parsing ----------------------------------------------------------------------------------

def test_tolerant_parse(spark):
    lines = ['{bad', '{"type":"x","seq":"5","time":2.7,"data":{"turn":"1","step":2.7}}', '[]', '7',
             '{"type":"tool/call","data":{"name":"read","callId":"c","arguments":"{oops"}}',
             '{"type":"tool/call","data":{"name":"read","arguments":"{\\"path\\":\\" \\",\\"notebook_path\\":\\"/n\\",\\"limit\\":3}"}}',
             '{"type":"assistant/message","data":{"stream":"none","turn":4}}',
             '{"type":"session","id":"z","createdAt":"9","delegationDepth":1,"data":{}}']
    rows = [("d", "f", "p", "V0", i, x) for i, x in enumerate(lines)]
    parsed = logs.parse_events(spark.createDataFrame(
        rows, "session_id string, source_file string, project_slug string, schema string, pos bigint, "
        "line string"))
    got = {r.pos: r for r in parsed.collect()}
    assert [p for p, r in got.items() if r.malformed] == [0]
    assert (got[1].seq, got[1].time, got[1].turn, got[1].step) == (5, 2, None, 2)
    assert (got[2].type, got[2].seq, got[2].time) == ("", -1, 0) and got[3].type == ""
    assert (got[4].name, got[4].arg_path) == ("read", None)
    assert (got[5].arg_path, got[5].arg_partial) == ("/n", True)
    assert (got[6].turn, got[6].stream_first) == (4, None)
    assert (got[7].header_id, got[7].created_at, got[7].delegation_depth) == ("z", None, 1)
    assert logs.bad_lines(parsed).head().bad_lines == 1


# --- sessions and steps -----------------------------------------------------------------------

def test_last_header_and_context_win_whole(spark):
    events = log(spark, [
        ("session", {"header_id": "s", "created_at": 5, "cwd": "/a", "agent_preset": "x", "delegation_depth": 0}),
        ("request/context", {"model": "m", "provider": "p", "context_window": 1}),
        ("session", {"header_id": "s", "created_at": None, "cwd": "/b"}),
        ("request/context", {"model": "n"}), ("anything", {})])
    r = facts.session_header(events).head()
    assert (r.started_at, r.cwd, r.agent_preset, r.role, r.ended_at) == (20, "/b", None, None, 40)
    assert (r.model, r.provider, r.context_window) == ("n", None, None)
    bare = facts.session_header(log(spark, [("x", {})])).head()
    assert (bare.id, bare.started_at, bare.model) == ("s", 1, None)


def fold_steps(rows):
    """A plain loop over one stream."""
    opened, closed = {}, {}
    for i, (kind, f) in enumerate(rows):
        key, t = (f.get("turn") or 0, f.get("step") or 0), i * 10
        if kind == "step/start":
            opened[key] = [t, None, None]
        elif kind == "assistant/chunk" and key in opened:
            opened[key][1] = opened[key][1] if opened[key][1] is not None else t
            opened[key][2] = t
        elif kind == "assistant/message":
            start, first, last = opened.pop(key, [t, None, None])
            source = "chunk-events"
            if first is None:
                first, last = f.get("stream_first"), f.get("stream_last")
                source = "none" if first is None else "embedded-stream"
            out, tps, ttft = f.get("output_tokens") or 0, None, None
            if first is not None and last > first and out > 0:
                tps = out / ((last - first) / 1000.0)
                ttft = first - start if first >= start else None
            closed[key] = [start, None, out or None, tps, ttft, source]
        elif kind == "step/end":
            if key in closed:
                closed[key][1] = t
            opened.pop(key, None)
    for key, (start, _, _) in opened.items():
        closed.setdefault(key, [start, None, None, None, None, "none"])
    return {k: tuple(v) for k, v in closed.items()}


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_steps_equal_a_plain_fold(spark, bits):
    rng = random.Random(bits)
    rows = []
    for i in range(400):
        kind = rng.choice(["step/start", "assistant/chunk", "assistant/chunk", "assistant/message", "step/end"])
        f = {"turn": rng.choice([None, 0, 1, 2]), "step": rng.choice([0, 1])}
        if kind == "assistant/message":
            f |= {"output_tokens": rng.choice([None, 0, 50])}
            if rng.random() < 0.5:
                f |= {"stream_first": i * 10 - 30, "stream_last": i * 10 - rng.choice([30, 5])}
        rows.append((kind, f))
    got = {(r.turn, r.step): (r.started_at, r.ended_at, r.output_tokens, r.decode_tps, r.ttft_ms,
                              r.timing_source)
           for r in facts.assemble_steps(log(spark, rows), bits).collect()}
    assert got == fold_steps(rows)


def test_a_step_that_waits_longer_than_an_int_holds(spark, tmp_path):
    late = 40 * 86_400_000
    rows = [("step/start", {}), ("assistant/chunk", {"time": late}), ("assistant/chunk", {"time": late + 1000}),
            ("assistant/message", {"time": late + 1500, "output_tokens": 50})]
    step, = facts.assemble_steps(log(spark, rows)).collect()
    assert (step.started_at, step.ttft_ms, step.decode_tps) == (0, late, 50.0)

    import __spark_entry__ as entry

    table = [(1, 0, "signup"), (8, 40, "view"), (15, 41, "view"), (22, 42, "purchase")]
    spark.createDataFrame(table, "event_id bigint, day int, event_type string").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(day) as ts", "1L as user_id", "event_type",
        "1.0D as value", "'{\"k\": 1}' as props").write.parquet(f"{tmp_path}/events.parquet")
    step, = entry.queries()["step_assembly"](spark, str(tmp_path)).collect()
    assert (step.timing_source, step.ttft_ms, step.decode_tps) == ("chunk-events", None, 0.0)


# --- pairing ----------------------------------------------------------------------------------

def fold_calls(rows):
    pending, out = {}, []
    for i, (kind, f) in enumerate(rows):
        cid = f.get("call_id")
        if kind == "tool/call" and cid is not None:
            pending[cid] = (i, f["name"], i * 10)
        elif kind == "tool/result":
            c = pending.pop(cid, None) if cid is not None else None
            out.append((c[0], c[1], c[2], i * 10, f.get("error_code"), False) if c
                       else (i, f.get("name"), None, i * 10, f.get("error_code"), True))
    return out + [(s, n, t, None, None, False) for s, n, t in pending.values()]


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_calls_equal_a_plain_fold(spark, bits):
    rng = random.Random(20 + bits)
    rows = []
    for _ in range(400):
        cid = rng.choice([None, "hot", "hot", "a", "b", "c"])
        rows.append(call(rng.choice(["read", "bash"]), cid=cid) if rng.random() < 0.5
                    else result(cid, rng.choice([None, "E"]), name="n"))
    calls = facts.pair_calls(log(spark, rows), bits)
    got = [(r.seq, r.name, r.started_at, r.ended_at, r.error_code, r.outcome_only)
           for r in calls.orderBy("rank").collect()]
    assert got == fold_calls(rows)


def test_first_row_of_a_seq_is_kept(spark):
    events = log(spark, [call("read", cid="a", seq=7), call("edit", cid="b", seq=7), result("b"),
                         result(None, "E", seq=7, name="x")])
    kept = facts.first_per_seq(facts.pair_calls(events)).collect()
    assert [(r.seq, r.name) for r in kept] == [(7, "edit")]


# --- detectors --------------------------------------------------------------------------------

P = "/w/src/App.java"


def test_stamp_guard_rules(spark):
    read, stale = tool("read", P), tool("edit", P, "FS_STALE_VERSION")
    sed, git = shell(f"sed -i s/a/b/ {P}"), shell("git checkout -- App.java")

    def one(*rows):
        r = found(spark, list(rows), detectors.stamp_guard)[-1]
        return r.category, r.confidence, r.stale_seq, r.cause_seq

    assert one(read, sed, stale) == ("DIRECT_MUTATION", 0.9, 0, 2)
    assert one(read, shell("sed -i s/a/b/ App.java"), stale) == ("DIRECT_MUTATION", 0.6, 0, 2)
    assert one(read, git, sed, stale) == ("VCS_RESTORE", 0.9, 0, 2)
    assert one(read, sed, git, stale) == ("DIRECT_MUTATION", 0.9, 0, 2)
    assert one(read, shell(f"cat {P}"), sed, stale) == ("DIRECT_MUTATION", 0.9, 0, 4)
    assert one(sed, read, stale) == ("EXTERNAL", None, 2, None)
    assert one(read, shell(f"cat {P}"), stale) == ("EXTERNAL", None, 0, None)
    assert one(sed, stale)[:3] == ("EXTERNAL", None, None)
    assert one(read, tool("edit", P, "FS_STALE_VERSION"), sed, stale) == ("DIRECT_MUTATION", 0.9, 2, 4)
    # a touch of another file of the same name bounds nothing
    assert one(tool("read", "/x/App.java"), sed, stale)[:3] == ("EXTERNAL", None, None)
    # a cause at the very seq of either end is outside the open interval
    same = [call("read", P, "r", seq=5), call("bash", cid="b", seq=5, command=f"rm {P}"),
            call("bash", cid="d", seq=9, command=f"rm {P}"), call("edit", P, "e", seq=9),
            result("e", "FS_STALE_VERSION")]
    assert one(same) == ("EXTERNAL", None, 5, None)


def test_edit_miss_rules(spark):
    miss = tool("edit", P, "FS_EDIT_NOT_FOUND")

    def last(*rows):
        r = found(spark, list(rows), detectors.edit_miss)[-1]
        return r.category, r.cause_seq

    assert last(tool("read", P), miss) == ("MISS_AFTER_READ", 0)
    assert last(tool("read", P, arg_partial=True), miss) == ("MISS_AFTER_PARTIAL_READ", 0)
    assert last(tool("read", P), tool("edit", P), miss) == ("MISS_AFTER_EDIT", 2)
    assert last(tool("read", P), tool("edit", P, "FS_EDIT_NOT_FOUND"), miss) == ("REPEATED_MISS", 2)
    assert last(tool("read", P), tool("edit", P, "FS_NOT_FOUND"), miss) == ("MISS_AFTER_READ", 0)
    assert last(tool("read", "/other"), miss) == ("MISS_UNREAD", None)
    assert last(tool("edit", None, "FS_EDIT_NOT_FOUND")) == ("MISS_UNREAD", None)
    assert last([call("write", P, "w")], miss) == ("MISS_AFTER_EDIT", 0)


def test_shell_edit_rules(spark):
    read = tool("read", P)

    def one(*rows):
        out = found(spark, list(rows), detectors.shell_edit)
        assert len(out) <= 1
        return (out[0].confidence, out[0].detail, out[0].stale_seq) if out else None

    assert one(read, shell(f"sed -i s/a/b/ {P}")) == (0.9, "IN_PLACE", 0)
    assert one(read, shell("echo x > src/App.java")) == (0.9, "REDIRECT", 0)
    assert one(read, shell("echo x > ./src/App.java")) == (0.9, "REDIRECT", 0)
    assert one(read, shell("echo x > App.java")) == (0.6, "REDIRECT", 0)
    assert one(read, shell("echo x > ./App.java")) == (0.6, "REDIRECT", 0)
    assert one(read, shell("echo x > /elsewhere/App.java")) is None
    assert one(read, shell("python3 -c \"p='src/App.java'; open(p,'w').write('x')\"")) == (0.6, "SCRIPT", 0)
    assert one(read, shell(f"cp {P} /tmp/x.java")) is None
    assert one(tool("edit", P, "FS_STALE_VERSION"), shell(f"sed -i s/a/b/ {P}")) is None
    assert one(shell(f"sed -i s/a/b/ {P}"), read) is None
    assert one(read, tool("write", P), shell(f"sed -i s/a/b/ {P}")) == (0.9, "IN_PLACE", 2)
    # a full match on a later candidate beats a basename match on an earlier one
    both = shell("sed -i s/a/b/ App.java src/App.java")
    assert one(read, both) == (0.9, "IN_PLACE", 0)
    # each target keeps the form that wrote it
    mixed = shell("python3 - <<'E' > /tmp/run.log\nopen('src/App.java', 'w').write(x)\nE")
    assert one(read, mixed) == (0.9, "SCRIPT", 0)


@pytest.mark.parametrize("bits", [1, 16])
def test_attribution_does_not_depend_on_blocks(spark, bits):
    rng = random.Random(3)
    paths = [f"/w/{d}/App{i}.java" for d in "ab" for i in range(2)]
    rows = []
    for _ in range(120):
        p = rng.choice(paths)
        base = p.rsplit("/", 1)[1]
        rows += rng.choice([
            tool("read", p), tool("edit", p), tool("edit", p, "FS_STALE_VERSION"),
            tool("edit", p, "FS_EDIT_NOT_FOUND"), shell(f"sed -i s/x/y/ {p}"),
            shell(f"echo x > {base}"), shell(f"git checkout -- {base}"), shell(f"cat {p}")])
    held = Facts(log(spark, rows))
    got = {}
    for name, detect in (("guard", detectors.stamp_guard), ("miss", detectors.edit_miss),
                         ("edit", detectors.shell_edit)):
        got[name] = {r.seq: (r.category, r.confidence, r.stale_seq, r.cause_seq)
                     for r in detect(held, bits).collect()}

    errors = {r.seq: r for r in held.errors.collect()}
    touches = sorted(held.touches.collect(), key=lambda t: t.seq)
    cmds = sorted(held.commands.collect(), key=lambda c: c.seq)
    for seq, e in errors.items():
        if e.code != "FS_STALE_VERSION":
            continue
        stale = max((t.seq for t in touches if t.abs_path == e.abs_path and t.seq < seq), default=None)
        cause = next((c for c in cmds if stale is not None and stale < c.seq < seq
                      and c.verb_class in ("MUTATING", "VCS_RESTORE")
                      and any(r.rsplit("/", 1)[-1] == e.abs_path.rsplit("/", 1)[1]
                              for r in c.referenced)), None)
        want = (("EXTERNAL", None, stale, None) if cause is None else
                ("VCS_RESTORE", 0.9, stale, cause.seq) if cause.verb_class == "VCS_RESTORE" else
                ("DIRECT_MUTATION", 0.9 if e.abs_path in cause.referenced else 0.6, stale, cause.seq))
        assert got["guard"][seq] == want
    failed = {s for s in errors}
    for c in cmds:
        if c.verb_class != "MUTATING":
            assert c.seq not in got["edit"]
            continue
        target = c.targets[0].path
        exact = [t.seq for t in touches if t.seq < c.seq and t.seq not in failed and t.abs_path == target]
        loose = [t.seq for t in touches if t.seq < c.seq and t.seq not in failed
                 and not target.startswith("/") and t.abs_path.rsplit("/", 1)[1] == target]
        hit = exact or loose
        assert got["edit"].get(c.seq) == (
            ("DIRECT_MUTATION", 0.9 if exact else 0.6, max(hit), None) if hit else None)


def test_retry_storm_needs_two_in_one_step(spark):
    def retry(turn, step, code):
        return [("llm/retry", {"turn": turn, "step": step, "retry_code": code})]

    rows = [retry(1, 0, "TIMEOUT"), retry(1, 0, "SERVER"), retry(1, 1, "SERVER"), retry(2, 0, "SERVER")]
    storms = found(spark, rows, detectors.retry_storm)
    assert [(s.seq, s.code) for s in storms] == [(1, "SERVER")]


# --- dimensions -------------------------------------------------------------------------------

def test_timeline(spark):
    entries = [("2026-02-01T00:00:00+01:00", "v2"), ("2026-01-01T00:00:00Z", "v1"),
               ("2026-01-01T00:00:00Z", "v1b")]
    since = dict(dimensions.timeline_entries(entries))
    second = 1_769_900_400_000
    assert since[second] == "v2"
    times = spark.createDataFrame([(0,), (second - 1,), (second,), (second + 1,)], "t bigint")
    got = [r[0] for r in times.orderBy("t").select(
        dimensions.version_at(F.col("t"), entries, "v0")).collect()]
    assert got == ["v0", "v1b", "v2", "v2"]
    assert dimensions.timeline_df(spark, entries).count() == 3
    for bad in ([(None, "v")], [("2026-01-01T00:00:00Z", " ")], [("2026-01-01T00:00:00", "v")]):
        with pytest.raises(ValueError):
            dimensions.timeline_entries(bad)
    assert dimensions.code_planes_df(spark).count() == 17
