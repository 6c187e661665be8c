"""Benchmark decontamination: seeds, then local alignment.

Every short word run of a test item is a seed; none is ruled out for being frequent or for what its
neighbours are, since an edit can break any of them. A passage that contains a seed and enough of the
item's words is aligned with the item by Smith-Waterman over words, which tolerates replaced, added and
missing words, and the score decides.

The items are a stated query set. They are taken in blocks of bounded size; a block goes to every
task, and documents are read once a block, where they lie, so nothing about them is shuffled. Memory
is one block and one batch of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import WordHash, cut, grams

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SIMILARITY = 0.5
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22

#: Letters, digits and bytes of other scripts stay, A-Z in lower case; the rest separates words.
_KEPT = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))

HASHES = WordHash()


def word_hashes(text: bytes | None) -> np.ndarray:
    return HASHES.all((text or b"").translate(PLAIN).split())


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    return grams(hashes, size) ^ np.uint64(size)


class Items:
    """A block of test items and the table of their runs."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        run, owner, place = [], [], []
        self.sizes = sorted({min(SEED_WORDS, len(w)) for w in self.words} - {0})
        for k, w in enumerate(self.words):
            found = runs(w, min(SEED_WORDS, len(w))) if len(w) else np.empty(0, np.uint64)
            run.append(found)
            owner.append(np.full(len(found), k))
            place.append(np.arange(len(found)))
        flat, owner, place = (np.concatenate(x) if x else np.empty(0) for x in (run, owner, place))
        order = np.argsort(flat, kind="stable")
        self.run, self.owner, self.place = (x[order] for x in (flat, owner, place))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.run)] = True

    @staticmethod
    def _slot(run: np.ndarray) -> np.ndarray:
        return (run & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document, and the run there, of runs in the table."""
        at, what = [], []
        for size in self.sizes:
            own = runs(hashes, size)
            maybe = np.flatnonzero(self.filter[self._slot(own)])
            if len(maybe):
                found = np.searchsorted(self.run, own[maybe])
                real = (found < len(self.run)) & (
                    self.run[np.minimum(found, len(self.run) - 1)] == own[maybe])
                at.append(maybe[real])
                what.append(own[maybe[real]])
        return (np.concatenate(at), np.concatenate(what)) if at else (np.empty(0, int), self.run[:0])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, start and end in the item, start and end in the passage."""
    width = len(passage)
    table = np.zeros((len(item) + 1, width + 1), np.int32)
    slope = -GAP * np.arange(width + 1)
    for i, word in enumerate(item, 1):
        above = table[i - 1]
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH))
        table[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end = int(table[i, j]), (int(i), int(j))
    while i and j and table[i, j] > 0:
        step = MATCH if item[i - 1] == passage[j - 1] else MISMATCH
        if table[i, j] == table[i - 1, j - 1] + step:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(i), end[0], int(j), end[1]


def matches(items: Items, hashes: np.ndarray, least: float) -> Iterator[tuple]:
    """Item, similarity, score, seeds, word span in the document, word span in the item."""
    at, what = items.hits(hashes)
    if not len(at):
        return
    first, last = (np.searchsorted(items.run, what, side) for side in ("left", "right"))
    rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
    owner = items.owner[rows]
    shift = np.repeat(at, last - first) - items.place[rows]
    order = np.lexsort((shift, owner))
    owner, shift = owner[order], shift[order]
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1), len(owner)]
    for a, b in pairwise(cuts):
        k = int(owner[a])
        item, own = items.words[k], np.unique(shift[a:b])
        size, best = len(item), None
        reach = math.ceil(MATCH * size * (1 - least))  # most gaps of an alignment that counts
        starts = [0, *(np.flatnonzero(np.diff(own) > size) + 1), len(own)]
        for s, e in pairwise(starts):
            low = max(0, int(own[s]) - reach)
            high = min(len(hashes), int(own[e - 1]) + size + reach)
            passage = hashes[low:high]
            if np.isin(item, passage).sum() < least * size:
                continue  # an alignment gains from words in common alone
            score, i, i_end, j, j_end = align(item, passage)
            if best is None or score > best[1]:
                best = (score / (MATCH * size), score, b - a, low + j, low + j_end, i, i_end)
        if best and best[0] >= least:
            yield (items.ids[k], *best)


def blocks_of(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded length; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(key).cast("long"), F.encode(F.col(text), "UTF-8"))
    for item, body in rows.where(F.col(text).isNotNull()).toLocalIterator():
        block.append((item, bytes(body)))
        size += len(block[-1][1].split()) + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = [("text_hash", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("score", pa.int64()),
         ("n_seeds", pa.int64()), ("word_start", pa.int64()), ("word_end", pa.int64()),
         ("item_start", pa.int64()), ("item_end", pa.int64())]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text",
                 least: float = MIN_SIMILARITY) -> DataFrame:
    """One row per (document, test item) whose best alignment reaches ``least``; clean documents give none.

    key, text_hash, item_id, similarity (score over the item's highest possible score), score, n_seeds, and the
    aligned words: word_start to word_end in the document, item_start to item_end in the item, ends
    exclusive.

    An absent or empty text, and an item without words, match nothing. An item of fewer words than a
    seed is its own seed. Among equal alignments the first one counts. Rows repeated in ``docs`` or
    in ``benchmark`` give repeated rows; absent keys are carried. Other columns are not carried.
    """
    docs = docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(F.col(text)))
    names = [key] + [n for n, _ in FOUND]
    schema = f"`{key}` long, " + ", ".join(
        f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in FOUND)
    found = []
    for block in blocks_of(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows = []
                for doc, body, own in zip(batch.column(0), batch.column(1).cast(pa.binary()),
                                          batch.column(2), strict=True):
                    rows.extend((doc.as_py(), own.as_py(), *m)
                                for m in matches(items, word_hashes(body.as_py()), least))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                kinds = [pa.int64()] + [t for _, t in FOUND]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        found.append(docs.mapInArrow(run, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                         text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain a test item; every column and other row stays."""
    leaks = cut(contaminated(docs, benchmark, key, text, **options)
                .select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(leaks, docs[key].cast("long").eqNullSafe(leaks["_key"])
                     & (F.xxhash64(docs[text]) == leaks["_hash"]), "left_anti")
