"""Detectors: facts in, findings out, and the registry that runs them.

A detector is a function of ``Facts`` returning rows with ``FINDING_COLUMNS`` and the tool codes it
owns. The error-plane detector reports every error whose code no other detector owns, so each error
is reported once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import shell as sh
from sessionlens.functions import text as tx
from sessionlens.operators import commands as command_job
from sessionlens.operators import facts as facts_of
from sessionlens.operators.ordered import BLOCK_BITS, as_of
from sessionlens.schema import FINDING_COLUMNS, FINDING_TYPES, HIGH, MEDIUM, STREAM
from sessionlens.session import materialise

STALE = "FS_STALE_VERSION"
MISS = "FS_EDIT_NOT_FOUND"
FILE_TOOLS = ("read", "write", "edit")


class Facts:
    """The fact tables of a set of typed events, each planned when first asked for.

    ``calls`` still carries absolute paths and ``rank``; a table may be replaced by a written copy.
    """

    def __init__(self, events: DataFrame, timeline: tuple[tuple[str, str], ...] = (),
                 fallback_version: str = "unknown"):
        self.events = events
        self._timeline, self._fallback = list(timeline), fallback_version

    sessions = cached_property(lambda self: facts_of.attribute_version(
        facts_of.session_header(self.events), self._timeline, self._fallback))
    calls = cached_property(lambda self: facts_of.pair_calls(self.events))
    errors = cached_property(lambda self: facts_of.error_events(self.calls))
    touches = cached_property(lambda self: facts_of.file_touches(self.events))
    commands = cached_property(lambda self: command_job.classify(
        command_job.shell_commands(self.events)))
    retries = cached_property(lambda self: facts_of.retry_events(self.events))
    fatal_turns = cached_property(lambda self: facts_of.fatal_turns(self.events))
    steps = cached_property(lambda self: facts_of.assemble_steps(self.events))


@dataclass(frozen=True)
class Detector:
    id: str
    detect: Callable[[Facts], DataFrame]
    owned_codes: frozenset[str] = field(default_factory=frozenset)


def finding_rows(df: DataFrame, detector: str, **values: Column) -> DataFrame:
    """``df`` projected on the finding columns; what is not given is NULL."""
    given = {"detector": F.lit(detector), **values}
    return df.select(*STREAM, *[
        given.get(c, F.lit(None)).cast(FINDING_TYPES[c]).alias(c)
        for c in FINDING_COLUMNS if c not in STREAM])


def _seq_text(seq: Column) -> Column:
    return seq.cast("string")


# --- single-row detectors ---------------------------------------------------------------------

def error_plane(facts: Facts, owned: frozenset[str]) -> DataFrame:
    code = F.col("code")
    errors = facts.errors.where(~code.isin(*sorted(owned))) if owned else facts.errors
    return finding_rows(
        errors, "error-plane", plane=tx.plane_of(code), code=code, abs_path=F.col("abs_path"),
        seq=F.col("seq"), occurred_at=F.col("occurred_at"),
        summary=F.concat(F.coalesce("tool", F.lit("tool")), F.lit(" returned "), code))


def fatal_turn(facts: Facts) -> DataFrame:
    code, detail = F.col("code"), F.col("detail")
    told = (F.when(code.isNull() & detail.isNull(), "")
            .when(detail.isNull(), F.concat(F.lit(": "), code))
            .otherwise(F.concat(F.lit(": "), F.coalesce(F.concat(code, F.lit(" ")), F.lit("")),
                                F.lit("("), detail, F.lit(")"))))
    return finding_rows(
        facts.fatal_turns, "fatal-turn", plane=F.lit("INFRASTRUCTURE"), code=code, detail=detail,
        occurred_at=F.col("occurred_at"),
        summary=F.concat(F.lit("turn "), F.col("turn").cast("string"),
                         F.lit(" ended in error"), told))


def retry_storm(facts: Facts, threshold: int = 2) -> DataFrame:
    storms = (
        facts.retries.groupBy(*STREAM, "turn", "step")
        .agg(F.count(F.lit(1)).alias("n"),
             F.max_by(F.struct("seq", "code", "occurred_at"), "pos").alias("last"))
        .where(F.col("n") >= threshold)
    )
    code = F.col("last.code")
    return finding_rows(
        storms, "retry-storm", plane=F.lit("INFRASTRUCTURE"), code=code, seq=F.col("last.seq"),
        occurred_at=F.col("last.occurred_at"),
        summary=F.concat(F.lit("step exhausted its retry budget ("), F.col("n").cast("string"),
                         F.lit(" retries, last "), F.coalesce(code, F.lit("null")), F.lit(")")))


# --- attribution detectors --------------------------------------------------------------------

def edit_miss(facts: Facts, bits: int = BLOCK_BITS) -> DataFrame:
    """T5: what the stream last did to the file before an edit found no match in it."""
    misses = facts.errors.where(F.col("code") == MISS)
    # other failures are looked past; an unanswered call has no code and counts as done
    earlier = facts.calls.where(
        F.col("name").isin(*FILE_TOOLS) & F.col("abs_path").isNotNull()
        & (F.col("error_code").isNull() | (F.col("error_code") == MISS)))
    ranged = (facts.touches.where(F.col("partial")).select(*STREAM, "seq").distinct()
              .withColumn("ranged", F.lit(True)))
    # the scan carries a number of fixed width, the call's place in the order observed
    place = F.shiftleft(F.col("rank.late").cast("bigint"), 62) + F.col("rank.at")
    found = as_of(misses, earlier, [*STREAM, "abs_path"], at="seq", order="seq",
                  payloads={"prev_place": place}, bits=bits)
    there = earlier.select(*STREAM, place.alias("prev_place"),
                           F.struct("seq", "name", "error_code").alias("prev"))
    found = (found.join(there, [*STREAM, "prev_place"], "left").withColumn("prev_seq", F.col("prev.seq"))
             .join(ranged.withColumnRenamed("seq", "prev_seq"), [*STREAM, "prev_seq"], "left"))
    prev = F.col("prev")
    category = (
        F.when(prev.isNull(), "MISS_UNREAD")
        .when(prev["error_code"] == MISS, "REPEATED_MISS")
        .when((prev["name"] == "read") & F.col("ranged"), "MISS_AFTER_PARTIAL_READ")
        .when(prev["name"] == "read", "MISS_AFTER_READ")
        .otherwise("MISS_AFTER_EDIT"))
    file = F.coalesce(tx.base_name(F.col("abs_path")), F.lit("(no path)"))
    seq = _seq_text(prev["seq"])
    summary = F.concat(file, F.lit(": edit found no match"), F.when(
        category == "REPEATED_MISS",
        F.concat(F.lit(" again; the previous miss at seq "), seq,
                 F.lit(" was retried without a read"))
    ).when(
        category == "MISS_AFTER_EDIT",
        F.concat(F.lit("; the model's own "), prev["name"], F.lit(" at seq "), seq,
                 F.lit(" had already changed the file"))
    ).when(
        category == "MISS_AFTER_READ",
        F.concat(F.lit(" although the file was read at seq "), seq)
    ).when(
        category == "MISS_AFTER_PARTIAL_READ",
        F.concat(F.lit("; the read at seq "), seq, F.lit(" covered only part of the file"))
    ).otherwise(F.lit("; nothing in this stream had read the file")))
    return finding_rows(
        found, "edit-miss", plane=F.lit("MODEL_MISUSE"), category=category, code=F.col("code"),
        confidence=F.lit(HIGH), abs_path=F.col("abs_path"), seq=F.col("seq"),
        cause_seq=prev["seq"], occurred_at=F.col("occurred_at"), summary=summary)


def _evidence(command: Column, path: Column) -> Column:
    return F.array(F.struct(
        command["seq"].alias("seq"), command["verb_class"].alias("verb_class"),
        sh.evidence_path(path, command["referenced"]).alias("path"),
        command["excerpt"].alias("excerpt")))


def stamp_guard(facts: Facts, bits: int = BLOCK_BITS) -> DataFrame:
    """What moved a file's stamp between the stale touch and the refused write.

    The earliest causal command inside the open interval (stale, refused) is the earliest one after
    the stale touch, provided it precedes the refusal: two as-of lookups, never a pair per command.
    The first lookup's few rows are written before the second reads them more than once.
    A command that names the path absolutely names its basename too, so basename is the lookup key.
    """
    refused = facts.errors.where(F.col("code") == STALE)
    stale = as_of(refused, facts.touches, [*STREAM, "abs_path"], at="seq", order="seq",
                  payloads={"stale": F.struct("seq", "op")}, bits=bits)
    stale = (stale.withColumn("base", tx.base_name(F.col("abs_path")))
             .withColumn("stale_seq", F.col("stale.seq")))
    named = facts.commands.select(
        *STREAM, "seq", "pos", "verb_class", "referenced", "excerpt",
        F.explode(F.array_distinct(F.transform("referenced", tx.base_name))).alias("base"))
    causal = F.col("verb_class").isin("MUTATING", "VCS_RESTORE")
    # one lookup finds both: the earliest causal command and the earliest of any verb
    placed = as_of(
        materialise(stale, "stale_touches"), named, [*STREAM, "base"], at="stale_seq", order="seq",
        payloads={"cause": F.when(causal, F.struct("seq", "pos", "verb_class", "referenced",
                                                   "excerpt")),
                  "mention": F.struct("seq", "pos")},
        forward=True, bits=bits)

    inside = F.col("cause.seq") < F.col("seq")
    path, base = F.col("abs_path"), F.coalesce(tx.base_name(F.col("abs_path")), F.lit(""))
    cause = F.when(inside, F.col("cause"))
    restored = inside & (F.col("cause.verb_class") == "VCS_RESTORE")
    absolute = F.array_contains(F.col("cause.referenced"), path)
    mentioned = F.col("mention.seq") < F.col("seq")
    stale_at, cause_at = _seq_text(F.col("stale_seq")), _seq_text(F.col("cause.seq"))
    summary = F.concat(base, F.lit(" refused: stamp stale"), F.when(
        restored,
        F.concat(F.lit(" since seq "), stale_at,
                 F.lit("; a version-control restore at seq "), cause_at,
                 F.lit(" is legitimate work the stamp cannot know about"))
    ).when(
        inside,
        F.concat(F.lit(" since seq "), stale_at, F.lit(" ("), F.col("stale.op"),
                 F.lit("); consistent with a mutating command at seq "), cause_at, F.lit(" ("),
                 F.when(absolute, "absolute").otherwise("basename"), F.lit(" path match)"))
    ).when(
        F.col("stale_seq").isNull(),
        F.lit(" (stale touch not derivable); no prior file-tool operation on this path")
    ).otherwise(F.concat(
        F.lit(" since seq "), stale_at, F.when(
            mentioned,
            F.concat(F.lit("; in-window mention at seq "), _seq_text(F.col("mention.seq")),
                     F.lit(" is not a mutation"))
        ).otherwise(F.lit("; no shell command in the window referenced this path")))))
    return finding_rows(
        placed, "stamp-guard", plane=F.lit("GUARD"),
        category=F.when(restored, "VCS_RESTORE").when(inside, "DIRECT_MUTATION")
        .otherwise("EXTERNAL"),
        code=F.col("code"),
        confidence=F.when(restored, HIGH).when(inside & absolute, HIGH).when(inside, MEDIUM),
        abs_path=path, seq=F.col("seq"), stale_seq=F.col("stale_seq"), cause_seq=cause["seq"],
        occurred_at=F.col("occurred_at"), summary=summary,
        evidence=F.when(inside, _evidence(F.col("cause"), path)))


def _touch_names(path: Column) -> Column:
    """Every name a command can give a tracked file: itself, its suffixes, its last segment.

    A suffix of two or more segments is a full match. The list is as long as the path is deep.
    """
    parts = F.split(path, "/")
    depth = F.size(parts)
    suffixes = F.transform(
        F.when(depth > 2, F.sequence(F.lit(2), depth - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, depth), "/")))
    return F.concat(F.array(F.concat(F.lit("="), path), F.concat(F.lit("*"), tx.base_name(path))),
                    suffixes)


def _candidate_names(candidate: Column) -> Column:
    relative = F.when(F.startswith(candidate, F.lit("./")), F.substr(candidate, F.lit(3))) \
        .otherwise(candidate)
    named = F.array(
        F.concat(F.lit("="), candidate),
        F.when(F.contains(relative, F.lit("/")), F.concat(F.lit("/"), relative)),
        F.when(~F.startswith(candidate, F.lit("/")),
               F.concat(F.lit("*"), tx.base_name(candidate))))
    return F.filter(named, lambda n: n.isNotNull())


def shell_edit(facts: Facts, bits: int = BLOCK_BITS) -> DataFrame:
    """A command that rewrote a file the file tools had tracked.

    A touch is filed under each name a command can give it, so suffix matching is an equi-key as-of
    lookup. Per command a full match beats a basename match, then the first candidate wins.
    """
    failed = (facts.calls.where(F.col("error_code").isNotNull())
              .select(*STREAM, "seq").distinct())
    tracked = (
        facts.touches.join(failed, [*STREAM, "seq"], "left_anti")
        .select(*STREAM, "seq", "abs_path", F.explode(_touch_names(F.col("abs_path"))).alias("named"))
    )
    names_targets = F.size("targets") > 0
    asked = (
        facts.commands.where((F.col("verb_class") == "MUTATING")
                             & F.col("write_kind").isin(*sh.CONTENT_KINDS))
        .withColumn("says", names_targets)
        .withColumn("t", F.explode(F.when(names_targets, F.col("targets")).otherwise(
            F.transform("referenced", lambda p: F.struct(
                p.alias("path"), F.col("write_kind").alias("kind"))))))
        .select(*STREAM, "pos", "seq", "verb_class", "referenced", "excerpt", "says",
                F.col("t.path").alias("candidate"), F.col("t.kind").alias("kind"))
        .withColumn("named", F.explode(_candidate_names(F.col("candidate"))))
    )
    hits = as_of(asked, tracked, [*STREAM, "named"], at="seq", order="seq",
                 payloads={"touch": F.struct("seq", "abs_path")}, bits=bits) \
        .where(F.col("touch").isNotNull())
    loose = F.startswith("named", F.lit("*"))
    best = (
        hits.groupBy(*STREAM, "pos")
        .agg(F.min_by(
            F.struct("seq", "verb_class", "referenced", "excerpt", "says", "kind", "touch",
                     loose.alias("loose")),
            F.struct(loose, "candidate", -F.col("touch.seq"))).alias("b"))
        .select(*STREAM, "pos", "b.*")
    )
    # the finding's time is its call's start; the first call observed at a seq speaks for it
    started = (facts.calls.where(F.col("started_at").isNotNull())
               .groupBy(*STREAM, "seq").agg(F.min_by("started_at", "rank").alias("call_at")))
    session_at = facts.sessions.select(*STREAM, F.col("started_at").alias("session_at"))
    timed = best.join(started, [*STREAM, "seq"], "left").join(session_at, STREAM, "left")
    path = F.col("touch.abs_path")
    return finding_rows(
        timed, "shell-edit", plane=F.lit("MODEL_MISUSE"), category=F.lit("DIRECT_MUTATION"),
        detail=F.col("kind"),
        confidence=F.when(~F.col("loose") & F.col("says"), HIGH).otherwise(MEDIUM),
        abs_path=path, seq=F.col("seq"), stale_seq=F.col("touch.seq"),
        occurred_at=F.coalesce("call_at", "session_at"),
        summary=F.concat(
            tx.base_name(path), F.lit(" rewritten from the shell ("), F.lower("kind"),
            F.lit(") at seq "), _seq_text(F.col("seq")),
            F.lit("; the file tools had tracked it since seq "), _seq_text(F.col("touch.seq")),
            F.lit(" ("), F.when(F.col("loose"), "basename").otherwise("full"),
            F.lit(" path match)")),
        evidence=_evidence(
            F.struct("seq", "verb_class", "referenced", "excerpt"), path))


# --- registry and union -----------------------------------------------------------------------

def default_detectors() -> list[Detector]:
    return [
        Detector("edit-miss", edit_miss, frozenset({MISS})),
        Detector("fatal-turn", fatal_turn),
        Detector("retry-storm", retry_storm),
        Detector("shell-edit", shell_edit),
        Detector("stamp-guard", stamp_guard, frozenset({STALE})),
    ]


def register(detectors: list[Detector], added: Detector) -> list[Detector]:
    """The list with one more detector. A code has one owner, an id one detector."""
    if any(d.id == added.id for d in detectors) or added.id == "error-plane":
        raise ValueError(f"detector id already registered: {added.id}")
    taken = owned_codes(detectors) & added.owned_codes
    if taken:
        raise ValueError(f"codes already owned: {sorted(taken)}")
    return [*detectors, added]


def owned_codes(detectors: list[Detector]) -> frozenset[str]:
    return frozenset().union(*[d.owned_codes for d in detectors])


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All detectors' rows with an id that a re-run reproduces.

    Hashing what identifies the source event needs no global ordering, unlike a counter.
    """
    return reduce(DataFrame.unionByName, parts).withColumn("id", finding_id())


def finding_id() -> Column:
    return F.xxhash64(
        *STREAM, "detector", F.coalesce("seq", F.lit(-1)), "occurred_at",
        F.coalesce("code", F.lit("")), F.coalesce("detail", F.lit("")), "summary")


def detect_all(facts: Facts, detectors: list[Detector] | None = None) -> DataFrame:
    detectors = default_detectors() if detectors is None else detectors
    parts = [error_plane(facts, owned_codes(detectors))]
    parts += [d.detect(facts) for d in detectors]
    return union_findings(parts)


def finding_tables(findings: DataFrame, sessions: DataFrame,
                   store_evidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stored finding and evidence rows: paths reduced to hints, evidence only if asked for."""
    rooted = findings.join(sessions.select(*STREAM, "cwd"), STREAM, "left")
    hint = tx.path_hint(F.col("abs_path"), F.col("cwd"))
    stored = rooted.select(
        "id", *STREAM, "detector", "plane", "category", "code", "detail", "confidence",
        hint.alias("path_hint"), "seq", "stale_seq", "cause_seq", "occurred_at",
        tx.utc_day(F.col("occurred_at")).alias("day"), "summary")
    source = rooted if store_evidence else rooted.where(F.lit(False))
    evidence = (
        source.select("id", *STREAM, "cwd", F.explode("evidence").alias("e"))
        .select(F.col("id").alias("finding_id"), *STREAM, "e.seq", "e.verb_class",
                tx.path_hint(F.col("e.path"), F.col("cwd")).alias("path_hint"),
                F.col("e.excerpt").alias("excerpt_redacted"))
    )
    return stored, evidence
