"""Personal data by bootstrapped contextual extraction.

Seeds are what the base patterns find. The words around a seed make lexical patterns: the word
before, the two words before, the word before with the word after. A pattern also extracts other
identifier-like words, and through them the seeds' confidence spreads over a graph of patterns and
instances, round by round: a pattern is as good as the share of what stands in its place that is
known to be an identifier, an instance as good as the patterns that agree on it. Instances that reach
the threshold are found wherever they stand; base spans always stay.

What stands in a pattern's place is counted over every word of every document, so a pattern of common
words has a precision near nothing however many seeds it meets. The graph itself holds only words with
a digit or an @. Patterns to count are taken in blocks of bounded size, which go to every task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import WordHash, cut, mix

# The kinds, in order, and the base patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ROUNDS = 3
MIN_SUPPORT = 3.0
MIN_PRECISION = 0.5
MIN_CONFIDENCE = 0.5
BLOCK_PATTERNS = 500_000
FILTER_BITS = 22

_KEPT = {*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "@._%+-/#"), *range(128, 256)}
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
WORD = re.compile(r"[A-Za-z0-9@._%+\-/#\u0080-\U0010ffff]+")
TRIMMED = "._-/#%+"
EDGE = 1  # stands for the text's edge, which no word hashes to in practice

HASHES = WordHash()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the local characters, an @ and a domain, in linear time."""
    done = at = 0
    while found := AT_DOMAIN.search(text, at):
        start = found.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            done = at = found.end()
        else:
            at = found.start() + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return spans
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text)
                  if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def context_hashes(before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """The three patterns of each place between words."""
    with np.errstate(over="ignore"):
        return [mix(before, 11), mix(mix(before2, 12) + before, 12), mix(mix(before, 13) + after, 13)]


def looks_like_identifier(word: str) -> bool:
    digits = sum(c in "0123456789" for c in word)
    return len(word) >= 5 and (digits >= 3 or ("@" in word and digits + len(word) >= 6))


def graph_rows(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like words, each with its place, its instance and its patterns."""
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    plain = [text[a:b].encode().translate(PLAIN) for a, b in found]
    hashes = HASHES.all(plain)
    padded = np.concatenate([np.full(2, EDGE, np.uint64), hashes, np.full(1, EDGE, np.uint64)])
    starts = np.array([a for a, _ in found] or [0])
    ends = np.array([b for _, b in found] or [0])
    places, taken = [], np.zeros(len(found), bool)
    for kind, a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b) - 1)
        if first <= last:
            taken[first:last + 1] = True
            places.append((kind, a, b, text[a:b], first, last))
    for k, (a, b) in enumerate(found):
        if not taken[k]:
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(TRIMMED)), b - len(word) + len(word.rstrip(TRIMMED))
            if a < b and looks_like_identifier(text[a:b]):
                places.append((None, a, b, text[a:b], k, k))
    if not places:
        return []
    first = np.array([p[4] for p in places]) + 2
    last = np.array([p[5] for p in places]) + 2
    patterns = np.stack(context_hashes(padded[first - 2], padded[first - 1], padded[last + 1]), 1)
    instances = HASHES.all([p[3].lower().encode() for p in places]).view(np.int64)
    return [{"kind": p[0], "start": p[1], "end": p[2], "instance": int(i),
             "patterns": row.view(np.int64).tolist()}
            for p, i, row in zip(places, instances, patterns, strict=True)]


PLACE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                   ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
SCAN = {"key": pa.int64(), "text_hash": pa.int64(), "counts": pa.list_(pa.int64()),
        "base": pa.string(), "base_sha256": pa.string(), "places": pa.list_(PLACE)}
SCAN_SQL = ("key long, text_hash long, counts array<long>, base string, base_sha256 string, "
            "places array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>")


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: its base spans and the places of its graph rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, base, sums, places = [], [], [], []
            for body in batch.column(2):
                text = body.as_py() or ""
                if "@" not in text and not any(d in text for d in "0123456789"):
                    counts.append([0] * len(KINDS))
                    base.append("")
                    sums.append(nothing)
                    places.append([])
                    continue
                spans = base_spans(text)
                counts.append([sum(s[0] == k for s in spans) for k in range(len(KINDS))])
                base.append(listed(spans))
                sums.append(hashlib.sha256(base[-1].encode()).hexdigest())
                places.append(graph_rows(text, spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array(c, SCAN[n]) for c, n in
                   zip((counts, base, sums, places), list(SCAN)[2:], strict=True)], list(SCAN))

    return docs.mapInArrow(run, SCAN_SQL)


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how many words of all documents stand in each pattern's place."""
    spark, parts = docs.sparkSession, None

    def counted(block: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, mask = shared.value, np.uint64((1 << FILTER_BITS) - 1)
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[(wanted & mask).astype(np.int64)] = True
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for body in batch.column(2).cast(pa.binary()):
                    own = HASHES.all((body.as_py() or b"").translate(PLAIN).split())
                    if not len(own):
                        continue
                    edge = np.full(2, EDGE, np.uint64)
                    padded = np.concatenate([edge, own, edge[:1]])
                    for found in context_hashes(padded[:-3], padded[1:-2], padded[3:]):
                        found = found[maybe[(found & mask).astype(np.int64)]]
                        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                        np.add.at(total, at[wanted[at] == found], 1)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[used].view(np.int64), pa.int64()), pa.array(total[used], pa.int64())],
                ["pattern", "n"])

        return docs.mapInArrow(run, "pattern long, n long")

    block: list[int] = []
    for row in patterns.toLocalIterator():
        block.append(row.pattern)
        if len(block) == BLOCK_PATTERNS:
            part = counted(np.sort(np.array(block, np.int64).view(np.uint64)))
            parts, block = part if parts is None else parts.unionAll(part), []
    if block or parts is None:
        part = counted(np.sort(np.array(block or [0], np.int64).view(np.uint64)))
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("pattern").agg(F.sum("n").alias("total"))


def bootstrap(scanned: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, kind: identifiers outside the base that the patterns vouch for."""
    rows = scanned.select(F.explode("places").alias("p")).select("p.kind", "p.instance", "p.patterns")
    edges = cut(rows.select("kind", "instance", F.explode("patterns").alias("pattern"))
                .groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    seeds = edges.where("kind is not null")
    worth = (seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
             .where(F.col("seeds") >= MIN_SUPPORT).select("pattern").distinct())
    totals = cut(pattern_totals(docs, worth))
    # places with other words than graph rows, each a miss
    useful = cut(edges.join(totals, "pattern").select("pattern", "instance", "kind", "n", "total"))
    size = cut(useful.groupBy("pattern").agg(
        F.count("*").alias("distinct"),
        F.greatest(F.max("total") - F.sum("n"), F.lit(0)).alias("misses")))
    known = useful.where("kind is not null").select("pattern", "kind", "instance",
                                                    F.lit(1.0).alias("confidence"))
    unknown = useful.where("kind is null").select("pattern", "instance")
    guessed = None
    for _ in range(rounds):
        facts = known
        if guessed is not None:
            facts = known.unionByName(unknown.join(guessed, "instance"))
        scores = (facts.groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
                  .join(size, "pattern")
                  .withColumn("precision", F.col("support") / (F.col("distinct") + F.col("misses")))
                  .where((F.col("support") >= MIN_SUPPORT) & (F.col("precision") >= MIN_PRECISION)))
        doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.col("precision")))
        guessed = cut(unknown.join(scores, "pattern").groupBy("instance", "kind")
                      .agg((1 - F.exp(F.sum(doubt))).alias("confidence")))
    best = guessed.groupBy("instance").agg(
        F.max(F.struct("confidence", (-F.col("kind")).alias("k")))["confidence"].alias("confidence"),
        F.max(F.struct("confidence", (-F.col("kind")).alias("k")))["k"].alias("k"))
    return best.where(F.col("confidence") >= MIN_CONFIDENCE).select(
        "instance", (-F.col("k")).cast("int").alias("kind"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per document: key, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans. ``spans`` lists base and discovered spans as
    kind:start:end, by kind in the order email, ip, card, phone, then by start; positions are code
    points, ends exclusive. A discovered span has the kind of the seeds whose patterns found it and
    overlaps no base span.

    An absent text counts as empty; without spans the list is an empty string. Rows repeated with
    the same key and text give rows alike; an absent key is carried. An empty table gives no rows.
    Other columns are not carried.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    scanned = cut(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    accepted = cut(bootstrap(scanned, docs, rounds))
    place = scanned.select("row", F.explode("places").alias("p")).where("p.kind is null").select(
        "row", "p.start", "p.end", "p.instance")
    added = (place.join(accepted, "instance").groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            (F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]) - 1).cast("int")
            .alias("kind"),
            F.split(s, ":")[1].cast("long").alias("start"),
            F.split(s, ":")[2].cast("long").alias("end")))
    every = F.sort_array(F.concat(base, F.col("added")))
    name = lambda s: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])
    return scanned.join(added, "row", "left").select(
        F.col("key").alias(key), "text_hash",
        *[F.get("counts", F.lit(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        "base_sha256", F.when(F.col("added").isNull(), F.col("base")).otherwise(
            F.array_join(F.transform(every, name), ",")).alias("spans"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Every row and column stays. Where spans of different kinds overlap, the first to start goes and
    the others with it.
    """
    found = (personal_data(docs, key, text).where("spans != ''")
             .select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"),
                     F.col("spans").alias("_spans")).distinct())
    found = cut(found)
    joined = docs.join(found, docs[key].cast("long").eqNullSafe(found["_key"])
                       & (F.xxhash64(docs[text]) == found["_hash"]), "left")
    names = docs.columns
    column = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, spans in zip(batch.column(column).to_pylist(),
                                   batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                texts.append(mask(body, spans) if spans else body)
            columns = list(batch.columns)[:-1]
            columns[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*[docs[c] for c in names], found["_spans"]).mapInArrow(run, docs.schema)


def mask(text: str, spans: str) -> str:
    parts, done = [], 0
    found = [s.split(":") for s in spans.split(",")]
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in found):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])
