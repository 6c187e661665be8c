"""Packing by concatenate and cut.

Two passes. The first tokenises every document once, keeps the ids, and numbers a document's first id
within its partition; the partition totals go through prefix sums, which give each partition its
global offset. The second adds that offset and cuts the run of all ids into windows of equal length.
Nothing but the last window is padded, and no document is moved: a document that crosses a window's
edge gives a boundary record on each side.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import cut, prefix_sums

END_ID = 2
CACHE_CHUNKS = 600_000
TOGETHER = 1 << 20
MAX_BROADCAST_PARTS = 1_000_000

# The splitting pattern and normalisers for which pieces can be looked up alone, and the same
# pattern for lower-case text of characters before U+0250, of which the normalisers change none.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
_LETTERS, _NUMBERS = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9²³¹¼½¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
BEYOND = re.compile("[\u0250-\U0010ffff\u0130\u023a\u023e]")  # or others in lower case that are not letters here


def _byte_letters() -> dict[int, str]:
    """The visible letter a byte-level vocabulary writes for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Numbers(dict):
    """chunk -> its number, given when it is first asked for."""

    def __init__(self, number):
        self.number = number

    def __missing__(self, raw: bytes) -> int:
        found = self[raw] = self.number(raw)
        return found


class ChunkEncoder:
    """Ids of texts, chunk by chunk between ASCII white space, each distinct chunk encoded once.

    A chunk's number says where its ids stand in one array, so the ids of many texts are gathered at once.
    Right for tokenizers that drop white space and never look across it. Where the tokenizer splits as
    ``LETTER_RUNS`` says, a text of Latin letters and signs goes to the model piece by piece; the chunks of
    every other text go through the whole tokenizer unless they are such texts themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_piece = (steps == NORMALISERS
                         and split.get("pattern", {}).get("Regex") == LETTER_RUNS)
        self.letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.start()

    def start(self) -> None:
        self.chunks, self.pieces = Numbers(self.chunk), Numbers(self.piece)
        self.ids, self.ends = array("I", [END_ID]), array("q", [0, 1])  # number 0 closes a text

    def added(self, ids: Iterable[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def run(self, number: int) -> array:
        return self.ids[self.ends[number]:self.ends[number + 1]]

    def piece(self, text: str) -> int:
        shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.letters)
        return self.added([t.id for t in self.tokenizer.model.tokenize(shown)])

    def split(self, text: str) -> list[str] | None:
        """The pieces of a text that the model takes one by one; None if it is not such a text."""
        if not self.by_piece or BEYOND.search(text):
            return None
        low = text.lower()
        return None if any(t in text or t in low for t in self.special) else PIECES.findall(low)

    def chunk(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        pieces = self.split(text)
        if pieces is None:
            return self.added(self.tokenizer.encode(text, add_special_tokens=False).ids)
        runs = [self.pieces[p] for p in pieces]
        return runs[0] if len(runs) == 1 else self.added(chain.from_iterable(map(self.run, runs)))

    def numbers(self, text: bytes | None) -> Iterable[int]:
        pieces = self.split((text or b"").decode("utf-8", "replace"))
        if pieces is None:
            return map(self.chunks.__getitem__, text.split())
        return map(self.pieces.__getitem__, pieces)

    def closed(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``END_ID``, and how many each has."""
        if len(self.chunks) + len(self.pieces) >= CACHE_CHUNKS:
            self.start()
        found = [[*self.numbers(text), 0] for text in texts]
        numbers = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        ends = np.frombuffer(self.ends, np.int64)
        first, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        before = np.cumsum(size) - size
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(first - before, size) + np.arange(size.sum())]
        return ids.astype("<u4"), np.add.reduceat(size, np.cumsum([0, *map(len, found[:-1])]))

    def encode(self, text: bytes | None) -> list[int]:
        return self.closed([text])[0][:-1].tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder; it keeps what it knows from task to task."""
    return ChunkEncoder(path)


def together(texts: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts in order, as many at a time as hold ``TOGETHER`` bytes, one at least."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= TOGETHER or len(held) >= TOGETHER >> 12:
            yield held
            held, size = [], 0
    if held:
        yield held


IDS_SCHEMA = "_part long, _start long, _key long, _ids binary"


def tokenised(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """A row per document: its partition, the ids before it there, and its ids as little-endian u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, starts, ids = batch.column(0), [], []
            for texts in together(batch.column(1).cast(pa.binary())):
                found, sizes = own.closed(texts)
                raw, at = found.tobytes(), 0
                for size in sizes.tolist():
                    starts.append(start)
                    start += size
                    ids.append(raw[4 * at:4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(starts), pa.int64()), pa.array(starts, pa.int64()),
                 keys, pa.array(ids, pa.binary())], ["_part", "_start", "_key", "_ids"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, IDS_SCHEMA)


PIECE_SCHEMA = ("{key} long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, `offset` long, starts_document boolean, ends_document boolean")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, key: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of a document in a window of ``length`` ids.

    key, start (the document's ids before the piece), length, ids_crc32, doc_tokens (with the closing
    id 2), sequence_id, offset (in the window), starts_document and ends_document; with ``with_ids``
    also the ids. A piece that does not end its document is a boundary record: the next one is in the
    next window at offset 0. Every window but the last is full.

    An absent or empty text is a document of the closing id alone. Repeated rows and absent keys are
    documents like any other. An empty table gives no rows. Other columns are not carried.
    """
    if length < 1:
        raise ValueError("a window holds at least one id")
    ids = cut(tokenised(docs, tokenizer, key, text))
    totals = ids.groupBy("_part").agg(
        F.sum(F.octet_length("_ids") / F.lit(4)).cast("long").alias("_n"))
    offsets = cut(prefix_sums(totals, "_part", "_n", "_base").select("_part", "_base"))
    if offsets.count() <= MAX_BROADCAST_PARTS:  # a row per scan partition, 16 bytes each
        offsets = F.broadcast(offsets)
    placed = ids.join(offsets, "_part").select(
        "_key", (F.col("_base") + F.col("_start")).alias("_start"), "_ids")
    schema = PIECE_SCHEMA.format(key=f"`{key}`") + (", ids binary" if with_ids else "")
    return placed.mapInArrow(_cutter(key, length, with_ids), schema)


def _cutter(key: str, length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, done = len(raw) // 4, 0
                while done < total:
                    window, offset = divmod(start + done, length)
                    size = min(length - offset, total - done)
                    own = raw[4 * done:4 * (done + size)]
                    rows.append((doc, done, size, zlib.crc32(own), total, window, offset,
                                 done == 0, done + size == total, *([own] if with_ids else [])))
                    done += size
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                     "starts_document", "ends_document"] + ["ids"] * with_ids
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()] * with_ids
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run
