"""Spelling variants: near words found in a frequency-vector trie, and the form each word goes to.

A word is arranged by how often it holds each of ``GROUPS`` of letters, one trie level a group. Two
words that differ by one inserted, deleted or replaced code point differ by at most one letter too
many (a surplus) in one level and one too few (a deficit) in one level, so a depth-first search
with a budget of one each passes every near word. What stands in the leaves it reaches is compared letter by
letter.

The first ``LEVELS`` levels cut the trie into subtrees; a word is sent to its own one and, as a
query, to every one it can reach with its budget. Each pair is asked for once: by the longer
word, or by the word with more of the earlier group. A task holds one subtree at a time, at most
``MOST_WORDS`` words of it (a larger one is split and its queries go to every part), and searches
it for the queries as they stream past, many at once: a node of the trie is entered once per batch
with all queries that still have budget there.

Defined results: a null or empty text has no words; a null doc_id reads as an empty one; repeated
rows count again; an empty table has no words. Columns other than doc_id and text are not read. No
length of a word or number of near words is too much; long words only make batches smaller.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import LOWER, stored

MIN_LETTERS, MIN_COUNT = 5, 3
CUT_ONE_IN = 97
RATIO = 2  # a form is at least this many times as frequent

#: letter groups in the order of trie levels; the frequent letters stand alone, and first
GROUPS = ("e", "n", "t", "a", "h", "i", "r", "o", "s", "u", "c", "l", "d", "gj", "bp", "fv", "mw", "kxy", "qz",
          "àáâãäå", "èéêë", "ìíîïòóôõöø", "ùúûüýÿ", "çñßæðþ×÷")  # capitals with accents: one more level
LEVELS = 5
MOST_WORDS = 1 << 16
LEAF = 8  # words; a node with fewer is compared whole
CELLS = 1 << 22  # of a block of numbers in a task
HELD_WORDS = 300_000  # distinct words counted in a task before they are handed on

_RUN = re.compile("[a-zÀ-ÿ]+")
_LEVEL = np.full(256, len(GROUPS), np.int64)
for _k, _letters in enumerate(GROUPS):
    _LEVEL[list(_letters.encode("latin-1"))] = _k
_DEPTH = len(GROUPS) + 1
_BITS = 10  # of a level's count in a subtree's key; larger counts share a key


def cut(word: str, doc: str) -> str:
    """The word as a document shows it: one code point less where the hash says so."""
    value = zlib.crc32(f"{doc}:{word}".encode())
    if value % CUT_ONE_IN:
        return word
    at = value % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all documents with their number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                if not raw:
                    continue
                name = doc.as_py()
                start = zlib.crc32(b":" if name is None else b"%d:" % name)
                for word, n in Counter(_RUN.findall(raw.translate(LOWER).decode("utf-8", "replace"))).items():
                    value = zlib.crc32(word.encode(), start)
                    if value % CUT_ONE_IN == 0:
                        at = value % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= MIN_LETTERS:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return (docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
            .mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


class Words:
    """Words side by side: their letters, counts by level and number of occurrences."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        self.raw = [w.encode("latin-1") for w in words]
        self.length = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.raw) + b"\0", np.uint8)
        row = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(row * _DEPTH + _LEVEL[self.flat[:-1]], minlength=len(words) * _DEPTH) \
            .reshape(-1, _DEPTH).astype(np.int32)

    def letters(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The letters of some words as rows of ``width``, zeros behind them."""
        place = np.arange(width)
        inside = place < self.length[rows, None]
        return self.flat[np.where(inside, self.start[rows, None] + place, len(self.flat) - 1)]

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.raw), np.uint64, len(self.raw))

    def rank(self) -> np.ndarray:
        """Each word's place in code-point order."""
        out = np.empty(len(self.raw), np.int64)
        out[sorted(range(len(self.raw)), key=self.raw.__getitem__)] = np.arange(len(self.raw))
        return out


def _key(counts: np.ndarray) -> np.ndarray:
    """The subtree of words, from their counts in the first levels."""
    out = np.zeros(len(counts), np.int64)
    for column in counts.T:
        out = (out << _BITS) | np.minimum(column, (1 << _BITS) - 1)
    return out


def subtree_rows(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, query, word, n): each word in its own subtree, and as a query in all it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Words(batch.column(0).to_pylist(), np.empty(0)).counts[:, :levels]
            every = np.arange(len(counts))
            own = _key(counts)
            shared = counts.max(initial=0) >= 1 << _BITS
            keys, rows = [own, own], [every, every]
            for i in range(levels):
                some = every[counts[:, i] > 0]
                less = counts[some]
                less[:, i] -= 1
                keys.append(_key(less))
                rows.append(some)
                for j in range(i + 1, levels):
                    moved = less.copy()
                    moved[:, j] += 1
                    keys.append(_key(moved))
                    rows.append(some)
            key, row = np.concatenate(keys), np.concatenate(rows)
            query = np.arange(len(row)) >= len(every)
            if shared:  # a query that keeps its key by being cut off asks there once
                once = np.unique(np.stack([query, row, key]), axis=1, return_index=True)[1]
                key, row, query = key[once], row[once], query[once]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(query), batch.column(0).take(of), batch.column(1).take(of)],
                ["key", "query", "word", "n"])

    if not 1 <= levels <= 63 // _BITS:
        raise ValueError(f"1 to {63 // _BITS} levels make a key")
    return words.mapInArrow(run, "key bigint, query boolean, word string, n bigint")


def in_parts(rows: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Adds ``part``: subtrees of more than ``most`` words are split by word, their queries repeated."""
    large = stored(rows.where(~F.col("query")).groupBy("key").agg(F.count(F.lit(1)).alias("size"))
                   .where(F.col("size") > most)
                   .select("key", F.ceil(F.col("size") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    part = F.when(F.col("query"), F.sequence(F.lit(0), parts - 1)) \
        .otherwise(F.array(F.pmod(F.xxhash64("word"), parts).cast("int")))
    return rows.join(large, "key", "left").select("key", F.explode(part).alias("part"), "query", "word", "n")


class Subtree:
    """Words of one subtree in the order of their counts, searched for many queries at once."""

    def __init__(self, words: list[str], n: np.ndarray, levels: int) -> None:
        held = Words(words, n)
        order = np.lexsort(held.counts[:, ::-1].T)
        self.held = Words([words[k] for k in order], n[order])
        self.counts, self.levels = self.held.counts, levels
        self.ranks, self.hashes = self.held.rank(), self.held.hashes()

    def reached(self, asked: Words) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that the search reaches."""
        none = np.zeros(len(asked.raw), np.int64)
        stack = [(0, len(self.counts), 0, np.arange(len(none)), none, none)]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while stack:
            low, high, level, rows, lacking, extra = stack.pop()
            if not len(rows):
                continue
            if high - low <= LEAF or level == _DEPTH:
                found.extend(self._leaf(low, high, level, asked, rows, lacking, extra))
                continue
            column = self.counts[low:high, level]
            edges = np.flatnonzero(np.diff(column)) + 1
            mine = asked.counts[rows, level]
            for a, b in zip([0, *edges], [*edges, high - low], strict=True):
                apart = mine - column[a]
                now_lacking, now_extra = lacking + (apart > 0), extra + (apart < 0)
                ok = (np.abs(apart) <= 1) & (now_lacking <= 1) & (now_extra <= 1)
                stack.append((low + a, low + b, level + 1, rows[ok], now_lacking[ok], now_extra[ok]))
        rows, words = map(np.concatenate, zip(*found, strict=True))
        return rows, words

    def _leaf(self, low: int, high: int, level: int, asked: Words, rows: np.ndarray, lacking: np.ndarray,
              extra: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wide = max(1, CELLS // max(1, (high - low) * (_DEPTH - level or 1)))
        for at in range(0, len(rows), wide):
            part = slice(at, at + wide)
            apart = asked.counts[rows[part], None, level:] - self.counts[None, low:high, level:]
            more = np.maximum(apart, 0).sum(2)
            lacks = lacking[part, None] + more
            extras = extra[part, None] + more - apart.sum(2)
            ok = (lacks <= 1) & (extras <= lacks)  # a longer word asks for the shorter one
            q, w = np.nonzero(ok)
            yield rows[part][q], low + w

    def near(self, asked: Words) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that differ by exactly one code point, each pair once."""
        rows, words = self.reached(asked)
        top = asked.counts[rows, :self.levels] - self.counts[words, :self.levels]
        inside = ~top.any(1)
        keep = np.take_along_axis(top, (top != 0).argmax(1)[:, None], 1)[:, 0] > 0
        keep |= asked.length[rows] != self.held.length[words]
        mine, other = asked.hashes()[rows], self.hashes[words]
        keep |= inside & (mine < other)
        for k in np.flatnonzero(inside & (mine == other)):
            keep[k] |= asked.raw[rows[k]] < self.held.raw[words[k]]
        rows, words = rows[keep], words[keep]  # of two words of one length, one asks
        order = np.argsort(asked.length[rows], kind="stable")
        rows, words = rows[order], words[order]
        ok, at = np.zeros(len(rows), bool), 0
        while at < len(rows):
            stop = len(rows)
            while stop - at > 1 and (stop - at) * int(asked.length[rows[stop - 1]] + 1) > CELLS:
                stop = at + (stop - at) // 2
            width = int(asked.length[rows[stop - 1]]) + 1
            part = slice(at, stop)
            ok[part] = _one_apart(asked.letters(rows[part], width), self.held.letters(words[part], width),
                                  asked.length[rows[part]] == self.held.length[words[part]])
            at = stop
        return rows[ok], words[ok]


def _one_apart(a: np.ndarray, b: np.ndarray, same_length: np.ndarray) -> np.ndarray:
    """Whether ``a`` is ``b`` with one letter replaced, or, where it is longer, with one put in."""
    unlike = a != b
    replaced = unlike.sum(1) == 1
    first = unlike.argmax(1)
    shifted = a[:, 1:] != b[:, :-1]
    last = shifted.shape[1] - 1 - shifted[:, ::-1].argmax(1)
    put_in = ~shifted.any(1) | (last < first)
    return np.where(same_length, replaced, put_in)


def _best(group: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group: its id, its size, and the row with the largest n, of equal ones the least rank."""
    order = np.lexsort((rank, -n, group))
    group = group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[:len(group)]
    return group[first], np.diff(np.r_[first, len(group)]), order[first]


NEAR = "word string, n_near bigint, near_n bigint, near string"


def near_rows(parts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, n_near, near_n, near): near words found, their number and the most frequent; to be summed."""

    def rows(words: list[str], sizes: np.ndarray, n: np.ndarray, near: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
             pa.array(near, pa.string())], ["word", "n_near", "near_n", "near"])

    def answers(tree: Subtree, asked: Words) -> Iterator[pa.RecordBatch]:
        a, b = tree.near(asked)
        if not len(a):
            return
        held = tree.held
        who, sizes, at = _best(a, held.n[b], tree.ranks[b])
        yield rows([asked.words[k] for k in who], sizes, held.n[b[at]], [held.words[k] for k in b[at]])
        who, sizes, at = _best(b, asked.n[a], asked.rank()[a])
        yield rows([held.words[k] for k in who], sizes, asked.n[a[at]], [asked.words[k] for k in a[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, n, tree = None, [], [], None
        for batch in batches:
            key, part, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "query"))
            starts = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(part) != 0)
                                          | (query[1:] != query[:-1])])[:len(key)]
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if here != (key[a], part[a]):
                    here, words, n, tree = (key[a], part[a]), [], [], None
                if not query[a]:
                    words += batch.column("word")[a:b].to_pylist()
                    n.append(batch.column("n")[a:b].to_numpy())
                elif words:
                    tree = tree or Subtree(words, np.concatenate(n), levels)
                    yield from answers(tree, Words(batch.column("word")[a:b].to_pylist(),
                                                   batch.column("n")[a:b].to_numpy()))

    return (parts.repartition("key", "part").sortWithinPartitions("key", "part", "query")
            .mapInArrow(run, NEAR))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the last word on the way from form to form.

    Frequency at least doubles on each step, so the way has at most log2 of the largest count steps,
    and each round doubles the steps taken.
    """
    most = forms.agg(F.max("form_n")).head()[0]
    out = stored(forms.select("word", F.col("form").alias("root")))
    steps = 1
    while most is not None and steps < int(most).bit_length():
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = stored(out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return out


def variants(docs: DataFrame, levels: int = LEVELS, most_words: int = MOST_WORDS) -> DataFrame:
    """Every word with its near words counted, its form and its root."""
    words = stored(word_counts(docs))
    found = near_rows(in_parts(subtree_rows(words, levels), most_words), levels)
    near = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    is_form = near_n >= RATIO * F.col("n")
    rows = stored(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, near_n).alias("form_n")))
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
