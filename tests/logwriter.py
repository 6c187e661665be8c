"""Writes small deterministic session logs for the tests."""

from __future__ import annotations

import json
import os

import zstandard

T0 = 1_788_220_800_000  # 2026-09-01T00:00:00Z
DAY = 86_400_000
V0, V3 = "session.jsonl.zstd", "session.v3.jsonl.zstd"


class Log:
    """One stream being written; seq counts up by one per event line."""

    def __init__(self, session: str, start: int, cwd: str, *, version=0, preset="builder", depth=0):
        self.lines, self.seq, self.calls = [], 0, 0
        root = {"type": "session", "id": session, "createdAt": start, "cwd": cwd,
                "version": version, "delegationDepth": depth}
        if preset:
            root["agentPreset"] = preset
        self.cwd, self.start, self.session, self.version = cwd, start, session, version
        self._line(root, start, {})

    def _line(self, root, time, data):
        self.lines.append(json.dumps({**root, "seq": self.seq, "time": time, "data": data}))
        self.seq += 1
        return self.seq - 1

    def event(self, kind, time, **data):
        return self._line({"type": kind}, time, data)

    def context(self, time, provider, model, window=131_072):
        return self.event("request/context", time, provider=provider, model=model,
                          contextWindow=window)

    def call(self, name, turn, step, time, **arguments):
        self.calls += 1
        return self.event("tool/call", time, turn=turn, step=step, callId=f"call-{self.calls}",
                          name=name, arguments=json.dumps(arguments))

    def result(self, time, code=None, call=None, **extra):
        data = {"message": {"source": {"callId": call or f"call-{self.calls}"}}, **extra}
        if code:
            data["error"] = {"name": "ToolError", "code": code}
        return self.event("tool/result", time, **data)

    def tool(self, name, turn, step, time, code=None, **arguments):
        """A call and its result 500 ms later; returns the call's seq."""
        seq = self.call(name, turn, step, time, **arguments)
        self.result(time + 500, code)
        return seq

    def plain_step(self, turn, time, path):
        """A measured step that reads one file: v0 chunk events or a v3 embedded stream."""
        self.event("step/start", time, turn=turn, step=0)
        self.tool("read", turn, 0, time + 1_000, file_path=path)
        stream = None
        if self.version == 3:
            stream = [{"type": "reasoning-chunks"}, {"type": "chunk", "time": time + 900},
                      {"type": "chunk", "time": time + 3_600}]
            tokens = 190
        else:
            self.event("assistant/chunk", time + 3_200, turn=turn, step=0)
            self.event("assistant/chunk", time + 5_400, turn=turn, step=0)
            tokens = 155
        data = {"turn": turn, "step": 0, "usage": {"inputTokens": 800, "outputTokens": tokens}}
        if stream:
            data["stream"] = stream
        self.event("assistant/message", time + 5_600, **data)
        self.event("step/end", time + 5_800, turn=turn, step=0)

    def write(self, root, slug, name=None):
        folder = os.path.join(root, slug, self.session)
        os.makedirs(folder, exist_ok=True)
        name = name or (V3 if self.version == 3 else V0)
        payload = ("\n".join(self.lines) + "\n").encode()
        with open(os.path.join(folder, name), "wb") as out:
            out.write(zstandard.ZstdCompressor().compress(payload))


class Scene:
    """A log with a clock: every action happens ten seconds after the one before."""

    def __init__(self, session, day, cwd, model=None, provider="local", **options):
        self.log = Log(session, T0 + day * DAY + 7 * 3_600_000, cwd, **options)
        self.cwd, self.now, self.turn = cwd, self.log.start, 0
        if model:
            self.log.context(self.now + 10, provider, model)

    def tick(self):
        self.now += 10_000
        return self.now

    def reads_in_a_step(self, name):
        self.log.plain_step(0, self.tick(), f"{self.cwd}/{name}")
        return self

    def does(self, tool, name, code=None):
        self.log.tool(tool, 1, 0, self.tick(), code, file_path=f"{self.cwd}/{name}")
        return self

    def runs(self, command):
        self.log.tool("bash", 1, 0, self.tick(), command=command)
        return self

    def fails(self, tool, code, **arguments):
        self.log.tool(tool, 1, 0, self.tick(), code, **arguments)
        return self

    def retries(self, *codes):
        for code in codes:
            self.log.event("llm/retry", self.tick(), turn=1, step=0, failure={"code": code})
        return self

    def dies(self, code, message):
        self.log.event("turn/end", self.tick(), turn=2, reason={
            "kind": "error", "error": {"code": code, "message": message}})
        return self

    def saved(self, root, project):
        self.log.write(root, project)


def write_corpus(root):
    """Six sessions in seven streams; each mixes several situations. test_corpus.py says which."""
    (Scene("amber", 1, "/data/ops", "m-large")
     .reads_in_a_step("inventory.ini")
     .fails("search", "SEARCH_FAILED", pattern="host", path="/data/ops")
     .does("read", "deploy.sh").runs("printf done >> /data/ops/deploy.sh")
     .does("edit", "deploy.sh", "FS_STALE_VERSION")
     .does("read", "roles.yml").runs("git restore roles.yml")
     .does("write", "roles.yml", "FS_STALE_VERSION")
     .saved(root, "ops"))

    (Scene("birch", 8, "/data/ops", "m-small", "remote", version=3, preset="planner", depth=1)
     .reads_in_a_step("inventory.ini").retries("TIMEOUT", "SERVER")
     .does("write", "vars.json").runs("python3 -c \"open('/data/ops/vars.json','w').write('{}')\"")
     .does("edit", "vars.json", "FS_STALE_VERSION")
     .saved(root, "ops"))

    (Scene("cedar", 3, "/data/site", "m-small", preset=None)
     .reads_in_a_step("index.html")
     .does("read", "app.css").does("edit", "app.css", "FS_EDIT_NOT_FOUND")
     .does("edit", "app.css").does("edit", "app.css", "FS_EDIT_NOT_FOUND")
     .does("edit", "app.css", "FS_EDIT_NOT_FOUND").runs("cp app.css app.css.old")
     .dies("INVALID_REQUEST", '400: {"code":"prompt_too_long"}')
     .saved(root, "site"))

    (Scene("dune", 5, "/data/site", "m-large")
     .reads_in_a_step("robots.txt").does("read", "lost.png", "FS_NOT_FOUND")
     .fails("web", "WEB_PROVIDER_CREDENTIAL_MISSING", query="q")
     .saved(root, "site"))
    untimed = Scene("dune", 5, "/data/site", "m-large", version=3)
    start = untimed.tick()
    untimed.log.event("step/start", start, turn=0, step=0)
    untimed.log.event("assistant/message", start + 900, turn=0, step=0,
                      usage={"inputTokens": 50, "outputTokens": 77}, stream=[{"type": "chunk"}])
    untimed.log.event("step/end", start + 1_000, turn=0, step=0)
    untimed.saved(root, "site")

    (Scene("elm", 9, "/data/lab")
     .reads_in_a_step("data.tsv").does("read", "plot.py").runs("node render.js")
     .does("edit", "plot.py", "FS_STALE_VERSION").retries("SERVER", "SERVER", "TRANSPORT")
     .saved(root, "lab"))

    broken = (Scene("fjord", 10, "/data/lab", "m-large", version=3)
              .reads_in_a_step("data.tsv").does("read", "fit.py").runs("sed -i 1d fit.py")
              .dies("SERVER", '529: {"code":529,"type":"overloaded"}'))
    broken.log.lines[2:2] = ["{not json", "  "]
    broken.saved(root, "lab")
    with open(os.path.join(root, "lab", "fjord", "session.lock"), "w") as out:
        out.write("no log")
