"""Jaccard self-join of shingle sets with several global token orders.

Two sets this similar share tokens among the first few of each, under every order of all tokens, and
how many they must share follows from their sizes (``needed``). A candidate must reach that under
several orders; only then are the sets compared.

* All orders put common tokens last, those that several documents have among the first of a plain
  random order. A Bloom filter of fixed size holds them; whom it names too many only moves in the
  orders, which never costs a link. The pairs come from an equi-join on the first tokens of the
  first order. Tokens that one document alone has there cannot join; a second Bloom filter keeps
  nearly all of them out of the shuffle.
* Two sets need to meet only in the first token, in the first order, that both have. A common token makes no
  row when one of the two tokens before it is common too, or when it leaves too few tokens behind it, nor do
  sets whose parities over 512 slots show that they differ too much. A token that all its sets have after the
  same other one makes no row at all.
* The other orders are checked on sketches, before any set is moved: a sketch holds the first tokens
  under each of them, cut to 16 bits, and how many tokens the set has in each share of the hash space.
  Either can only make two sets look more alike than they are.

No pairs within a group of copies. Equal sets are one node. Near copies are first tied to a hub: the
most central node with the same least token, under each of several random orders; a node is central
when its parities are near those that most of the nodes have. Links found so are merged to components;
then, within one token, each node outside the most frequent component is tied to the most central node
of that one. The join pairs what is left: within one token, the nodes outside the most frequent
component with those of all other components.

Nodes are 128-bit set fingerprints. Components are found by contraction: each node joins its least
neighbour, edges between what is left go on to the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.shared import batch_words, cut, grams, mix, stored

SHINGLE = 4
PERCENT = 85
ORDERS = 3
HUBS = 4
COMMON = 8
MIN_SHARES, MAX_SHARES = 64, 4096
BLOOM_BITS = 27
BLOOM_SEGMENTS = 256
BLOOM_SALTS = (101, 102, 103)
MAX_BROADCAST_KEYS = 1_000_000
BATCH_TOKENS = 1 << 21
PARITY = 4  # longs, for a group's middle
WORDS = [f"parity_{k}" for k in range(PARITY)]
FINE = 2 * PARITY  # longs, for a pair
FINE_WORDS = [f"fine_{k}" for k in range(FINE)]
RECENT = ["prev", "prev2"]
PLACE = ["token", "node", "n", "aside", *RECENT, "behind", *FINE_WORDS]
CROWD = 8192  # nodes counted at once for a middle


def distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``n`` are one shingle."""
    for at in range(0, len(texts), 256):
        hashes, bounds = batch_words(texts.slice(at, 256))
        runs = grams(hashes, n)
        for a, b in pairwise(bounds.tolist()):
            if 0 < b - a < n:
                yield grams(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield distinct(runs[a:max(a, b - n + 1)] ^ np.uint64(n))


def fingerprint(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_size(size: int, percent: int) -> int:
    """How many first tokens two sets of this similarity cannot both lack a common one in."""
    return size - -(-percent * size // 100) + 1


def needed(x: int, y: int, percent: int) -> tuple[int, int]:
    """How many tokens two similar sets of these sizes share, and how many among their first ones.

    A set of x tokens has at most x - shared that the other lacks. Of the two sets, the one whose first
    tokens end earlier in the order finds all that it shares of them among the first of the other.
    """
    shared = -(-percent * (x + y) // (100 + percent))
    return shared, shared - -(-percent * max(x, y) // 100) + 1


def last_bits(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What an order adds to a token's place: tokens of the Bloom filter ``common`` come after all others."""
    return in_bloom(common, tokens).astype(np.uint64) << np.uint64(63)


def sets_and_last(texts: pa.Array, n: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set with its ``last_bits``, looked up for 256 texts at a time."""
    for at in range(0, len(texts), 256):
        sets = list(shingle_sets(texts.slice(at, 256), n))
        last = last_bits(np.concatenate(sets), common)
        yield from zip(sets, np.split(last, np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)), strict=True)


def prefix(tokens: np.ndarray, last: np.ndarray | None, order: int, percent: int,
           times: int = 1) -> np.ndarray:
    """Places of the first tokens under an order, in that order: as many as decide, or that many ``times``."""
    size = min(times * prefix_size(len(tokens), percent), len(tokens))
    key = mix(tokens, order) >> np.uint64(1)
    if last is not None:
        key |= last
    first = np.argpartition(key, size - 1)[:size]
    return first[np.argsort(key[first])]


def shares(size: int) -> int:
    """Into how many equal shares the hash space is cut for a set: about one token falls to each."""
    return min(MAX_SHARES, max(MIN_SHARES, 1 << size.bit_length() - 1))


def sketch(tokens: np.ndarray, last: np.ndarray, percent: int) -> bytes:
    """The set's size, its tokens in each share, and its first tokens under the orders after the first.

    A count is one byte; 255 stands for any larger one. First tokens are cut to 16 bits and sorted.
    """
    parts = shares(len(tokens))
    counts = np.bincount((tokens >> np.uint64(65 - parts.bit_length())).astype(np.int64), minlength=parts)
    orders = [np.sort((tokens[prefix(tokens, last, k, percent)] & np.uint64(0xFFFF)).astype("<u2"))
              for k in range(2, ORDERS + 1)]
    return b"".join([np.uint32(len(tokens)).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(),
                     *[o.tobytes() for o in orders]])


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share, repeated ones as often as both have them."""
    both = np.sort(np.concatenate([numbered(x), numbered(y)]))
    return int((both[1:] == both[:-1]).sum())


def numbered(x: np.ndarray) -> np.ndarray:
    """Sorted values made distinct by how many equal ones stand before."""
    return (x.astype(np.int64) << 32) + np.arange(len(x)) - np.searchsorted(x, x)


def alike(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sketches leave it possible that their sets are similar enough."""
    (n, m), (a, b) = (int.from_bytes(s[:4], "little") for s in (x, y)), (
        np.frombuffer(s, np.uint8, offset=4) for s in (x, y))
    shared, first = needed(n, m, percent)
    if shared > min(n, m):
        return False
    p, q = shares(n), shares(m)
    fold = min(p, q)
    u, v = (s[:k].reshape(fold, -1).astype(np.int64) for s, k in ((a, p), (b, q)))
    if u.max() < 255 and v.max() < 255 and np.minimum(u.sum(1), v.sum(1)).sum() < shared:
        return False
    orders = zip(a[p:].view("<u2").reshape(ORDERS - 1, -1), b[q:].view("<u2").reshape(ORDERS - 1, -1),
                 strict=True)
    return all(in_common(s, t) >= first for s, t in orders)


def signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64), pa.int64())


def batch_of(schema: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t)
              for c, t in zip(columns, schema.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(schema))


SURVEY = {"key": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "node": pa.binary(),
          "least": pa.list_(pa.int64()), "sketch": pa.binary(),
          "first": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "parity": pa.list_(pa.int64())}
SURVEY_SQL = ("key long, text_hash long, n long, node binary, least array<long>, sketch binary, "
              "first array<long>, at array<int>, parity array<long>")


def parity(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls to each of 512 slots, as eight longs.

    Each token that only one of two sets has changes one slot: no more slots can differ than tokens do.
    """
    slots = np.bincount((tokens & np.uint64(64 * FINE - 1)).astype(np.int64), minlength=64 * FINE)
    return np.packbits((slots & 1).astype(np.uint8)).view(np.int64)


def survey(docs: DataFrame, common, bloom, n: int, percent: int) -> DataFrame:
    """A row per document: its set's size and node, and what the join needs to know of the set.

    ``least``: its least token per order; ``first``: the first tokens that another set may have among its
    own, ``at`` their places among all first ones; ``sketch`` and ``parity``. A task says all this for the first document of a node and leaves it null for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for tokens, last in sets_and_last(batch.column(1), n, common.value):
                node = fingerprint(tokens) if len(tokens) else None
                if node is None or node in seen:
                    rows.append((len(tokens), node, *[None] * (len(SURVEY) - 4)))
                    continue
                if len(seen) < 1 << 18:
                    seen.add(node)
                first = tokens[prefix(tokens, last, 1, percent)]
                at = np.flatnonzero(in_bloom(bloom.value, first))
                rows.append((len(tokens), node,
                             [int(mix(tokens, k).min().view(np.int64)) for k in range(1, HUBS + 1)],
                             sketch(tokens, last, percent),
                             first[at].view(np.int64), at.astype(np.int32), parity(tokens)))
            others = zip(*rows, strict=True) if rows else ((),) * (len(SURVEY) - 2)
            yield batch_of(SURVEY, [batch.column(0), batch.column(2), *others])

    return docs.mapInArrow(run, SURVEY_SQL)


def token_counts(docs: DataFrame, common, n: int, percent: int, times: int) -> DataFrame:
    """token, n: tokens that more than one row has among its first ones under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"token": pa.int64(), "n": pa.int64()}
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return batch_of(schema, [signed(tokens), counts])

        for batch in batches:
            sets = (sets_and_last(batch.column(1), n, common.value) if common
                    else ((tokens, None) for tokens in shingle_sets(batch.column(1), n)))
            for tokens, last in sets:
                node = fingerprint(tokens)
                if not len(tokens) or node in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(node)
                held.append(tokens[prefix(tokens, last, 1, percent, times)])
                size += len(held[-1])
                if size > BATCH_TOKENS:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    return (docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
            .where("n > 1"))


def bloom_slots(tokens: np.ndarray, salt: int) -> np.ndarray:
    return (mix(tokens, salt) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def in_bloom(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens the filter may hold; later slots are looked up only for what the earlier ones leave."""
    left = np.arange(len(tokens))
    for salt in BLOOM_SALTS:
        s = bloom_slots(tokens[left], salt)
        left = left[bits[s >> 3] & (np.uint8(128) >> (s & 7).astype(np.uint8)) > 0]
    found = np.zeros(len(tokens), bool)
    found[left] = True
    return found


def bloom_of(tokens: DataFrame) -> np.ndarray:
    """A Bloom filter of the tokens, packed bits of a fixed size, built in segments."""
    width = (1 << BLOOM_BITS) // BLOOM_SEGMENTS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0).to_numpy().view(np.uint64)
            own = np.unique(np.concatenate([bloom_slots(tokens, salt) for salt in BLOOM_SALTS]))
            cuts = np.searchsorted(own, np.arange(BLOOM_SEGMENTS + 1) * width)
            rows = [(k, (own[a:b] - k * width).astype("<u4").tobytes())
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            yield batch_of({"segment": pa.int32(), "slots": pa.binary()},
                           [[r[0] for r in rows], [r[1] for r in rows]])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, raw in zip(*batch.columns, strict=True):
                bits.setdefault(segment.as_py(), np.zeros(width, bool))[
                    np.frombuffer(raw.as_buffer(), "<u4")] = True
        yield batch_of({"segment": pa.int32(), "bits": pa.binary()},
                       [list(bits), [np.packbits(b).tobytes() for b in bits.values()]])

    out = np.zeros((BLOOM_SEGMENTS, width // 8), np.uint8)
    for row in (tokens.mapInArrow(slots, "segment int, slots binary")
                .repartition(BLOOM_SEGMENTS // 8, "segment")
                .mapInArrow(fill, "segment int, bits binary").collect()):  # a fixed number of bytes
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def prefix_rows(classes: DataFrame) -> DataFrame:
    """The columns PLACE and comp: a row per node and first token that another set may have among its own.

    ``prev`` and ``prev2``: the two of these before it; ``behind``: how many tokens of the whole set come
    after it.
    """
    none = F.lit(None).cast("long")
    return (classes.withColumns({"prev": F.concat(F.array(none), "first"),
                                 "prev2": F.concat(F.array(none, none), "first")})
            .select("node", "n", "aside", *[F.col("parity")[k].alias(w) for k, w in enumerate(FINE_WORDS)], "comp",
                    F.explode(F.arrays_zip("first", "at", *RECENT)).alias("_first"))
            .where("_first.first is not null")
            .withColumns({"token": F.col("_first.first"), "behind": F.col("n") - 1 - F.col("_first.at"),
                          **{c: F.col(f"_first.{c}") for c in RECENT}})
            .select(*PLACE, "comp"))


def sets_of(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """node, tokens: the sets of the documents with these keys, tokens as packed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"node": pa.binary(), "tokens": pa.binary()}
        for batch in batches:
            nodes, sets, held = [], [], 0
            for tokens in shingle_sets(batch.column(1), n):
                nodes.append(fingerprint(tokens))
                sets.append(tokens.tobytes())
                held += len(sets[-1])
                if held > 16 << 20:
                    yield batch_of(schema, [nodes, sets])
                    nodes, sets, held = [], [], 0
            yield batch_of(schema, [nodes, sets])

    if keys.count() <= MAX_BROADCAST_KEYS:  # 8 bytes each
        keys = F.broadcast(keys)
    return (docs.join(keys, docs.key.eqNullSafe(keys.key), "left_semi")
            .mapInArrow(run, "node binary, tokens binary"))


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave it possible that the sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"a": pa.binary(), "b": pa.binary()}
        for batch in batches:
            keep = pa.array([alike(x.as_py(), y.as_py(), percent)
                             for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch_of(schema, [batch.column(0).filter(keep), batch.column(1).filter(keep)])

    asked = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    left = asked.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = asked.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
               .mapInArrow(run, "a binary, b binary"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough first tokens under the other orders and are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"a": pa.binary(), "b": pa.binary()}
        for batch in batches:
            linked = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    linked.append((a.as_py(), b.as_py()))
            yield batch_of(schema, [[p[0] for p in linked], [p[1] for p in linked]])

    pairs = possible(cut(pairs), classes, percent)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = cut(classes.join(wanted, "node").select("key").distinct())
    sets = stored(sets_of(docs, keys, n).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
               .mapInArrow(run, "a binary, b binary").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the same label where edges connect."""
    maps = []
    edges = edges.select("a", "b")
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("_b"))
                      .select(F.col("a").alias("node"), F.least("a", "_b").alias("label")))
        if parents.isEmpty():
            break
        maps.append(parents)
        a = parents.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        b = parents.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        edges = cut(edges.join(a, "a").join(b, "b").where("_a != _b")
                    .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
                    .distinct())
        if edges.isEmpty():
            break
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        return found.join(step, "label", "left").select(
            "node", F.coalesce("_next", "label").alias("label"))

    return cut(reduce(follow, maps[1:], maps[0]))


def parity_words() -> list[Column]:
    """The parities over 256 slots: two of the 512 fall together."""
    return [F.col("parity")[k].bitwiseXOR(F.col("parity")[k + PARITY]).alias(word) for k, word in enumerate(WORDS)]


def middles(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and WORDS: for each slot, what more than half of a group's rows have there.

    A long counts four slots, so a group may have 16,383 rows.
    """
    each, top = 0x0001000100010001, 0x4000
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("_n"),
        *[F.sum(F.shiftrightunsigned(F.col(word), j).bitwiseAND(F.lit(each))).alias(f"_{word}_{j}")
          for word in WORDS for j in range(16)])
    carry = (F.lit(top - 1) - F.floor(F.col("_n") / 2)) * F.lit(each)

    def most(word: str) -> Column:
        return reduce(Column.bitwiseOR, [
            F.shiftleft(F.shiftrightunsigned((F.col(f"_{word}_{j}") + carry).bitwiseAND(F.lit(top * each)), 14), j)
            for j in range(16)])

    return counts.select(*by, *[most(word).alias(word) for word in WORDS])


def differing(x: str, y: str, words: list[str]) -> Column:
    """In how many slots the parities of two rows differ, whose columns are named after ``words``."""
    return reduce(Column.__add__, [F.bit_count(F.col(x.format(word)).bitwiseXOR(F.col(y.format(word))))
                                   for word in words])


def seats(classes: DataFrame) -> DataFrame:
    """order, token, node, n, aside: a row per node and order in which others have its least token too.

    ``aside``: in how many slots the node's parity differs from the middle of all these nodes. The middle of
    a large group is that of the middles of its parts.
    """
    group = ["order", "token"]
    rows = classes.select("node", "n", *parity_words(), F.posexplode("least").alias("order", "token"))
    many = rows.groupBy(*group).agg(F.count("*").alias("_many")).where("_many > 1")
    rows = stored(rows.join(many, group).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.ceil(F.col("_many") / CROWD))).drop("_many"))
    middle = middles(middles(rows, [*group, "part"]), group)
    middle = middle.select(*group, *[F.col(word).alias(f"middle_{word}") for word in WORDS])
    return stored(rows.join(middle, group).select(
        *group, "node", "n", differing("{}", "middle_{}", WORDS).alias("aside")))


def hub_pairs(seated: DataFrame, percent: int) -> DataFrame:
    """Each node with the most central one that has the same least token, under each order."""
    hubs = seated.groupBy("order", "token").agg(F.min(F.struct("aside", "node", "n")).alias("_hub")).select(
        "order", "token", F.col("_hub.node").alias("hub"), F.col("_hub.n").alias("hub_n"))
    return (seated.join(hubs, ["order", "token"])
            .where((F.col("node") != F.col("hub"))
                   & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
            .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())


def with_components(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with comp: the component of the node, the node itself where nothing is linked to it."""
    return rows.join(merged, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def mixed_rows(placed: DataFrame) -> DataFrame:
    """The rows of tokens that nodes of several components have, with comp, most and leader.

    ``most`` is the component with the most rows of the token, ``leader`` its most central node there. A token
    that all nodes have after the same other one is no pair's first common one and is left out.
    """
    groups = placed.groupBy("token", "comp").agg(
        F.count("*").alias("m"), F.min(F.struct("aside", "node", "n")).alias("leader"),
        F.count("prev").alias("after"), F.min("prev").alias("low"), F.max("prev").alias("high"))
    most = groups.groupBy("token").agg(
        F.max(F.struct("m", "comp", "leader")).alias("_most"), F.count("*").alias("comps"),
        F.sum("m").alias("rows"), F.sum("after").alias("after"), F.min("low").alias("low"),
        F.max("high").alias("high")).where("comps > 1 and (after < rows or low < high)").select("token", F.col("_most.comp").alias("most"),
                            F.col("_most.leader.node").alias("leader"), F.col("_most.leader.n").alias("leader_n"))
    return stored(placed.join(most, "token"))


def leader_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Each node outside a token's most frequent component with that component's leader there."""
    return (mixed.where((F.col("comp") != F.col("most"))
                        & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")))
            .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())


def meetings(mixed: DataFrame, percent: int) -> DataFrame:
    """a, b, in order: nodes of different components that may link, once or more for each pair.

    A pair that links meets in the first token that both have: nothing before that is common, and all else that
    they share comes behind it in both sets. Other common tokens make a row only where neither of the two tokens
    before is common. Sets whose parities differ in more slots than similar sets of their sizes can differ in
    tokens make no row.
    """
    other = mixed.where("comp != most").select(
        "token", F.col("comp").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in PLACE[1:]])
    every = mixed.select("token", F.col("comp").alias("cb"), (F.col("comp") == F.col("most")).alias("main"),
                         *[F.col(c).alias(f"{c}_b") for c in PLACE[1:]])
    shared = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    later = reduce(Column.__or__, [F.coalesce(F.col(f"{x}_a") == F.col(f"{y}_b"), F.lit(False))
                                   for x in RECENT for y in RECENT])
    return (other.join(every, "token")
            .where((F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("node_a") < F.col("node_b")))
                   & (F.least("n_a", "n_b") >= shared) & (F.least("behind_a", "behind_b") >= shared - 1) & ~later
                   & (differing("{}_a", "{}_b", FINE_WORDS) <= F.col("n_a") + F.col("n_b") - 2 * shared))
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that may link."""
    return meetings(mixed, percent).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key reachable by links),
    text_hash, and component, the same binary label within a component.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``n``-word
    shingles; a text of fewer words is one shingle. A document without words, or without text, has an
    empty set, links with nothing and is its own component. Rows repeated with the same key and text
    are in one component. An absent key counts as larger than any: a component whose rows all lack
    one has no id. An empty table gives no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    share = spark.sparkContext.broadcast
    often = token_counts(docs, None, n, percent, 2).where(F.col("n") >= COMMON).select("token")
    common = share(bloom_of(often))
    bloom = share(bloom_of(token_counts(docs, common, n, percent, 1).select("token")))
    rows = stored(survey(docs, common, bloom, n, percent))
    classes = stored(rows.where("n > 0").groupBy("node").agg(
        F.min("key").alias("key"), F.min("n").alias("n"),
        *[F.first(c, True).alias(c) for c in ("least", "sketch", "first", "at", "parity")]))
    seated = seats(classes)
    near = verified(hub_pairs(seated, percent), docs, classes, n, percent)
    merged = components(near)
    tied = (classes.select("node", "n", "first", "at", "parity")
            .join(seated.groupBy("node").agg(F.min("aside").alias("aside")), "node", "left"))
    mixed = mixed_rows(prefix_rows(stored(with_components(tied, merged))))
    near = near.union(verified(leader_pairs(mixed, percent), docs, classes, n, percent))
    merged = components(near)
    mixed = mixed_rows(stored(with_components(mixed.select(PLACE), merged)))
    links = near.union(verified(cross_pairs(mixed, percent), docs, classes, n, percent))
    found = components(links)
    labelled = classes.join(found, "node", "left").select(
        "node", "key", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("key").alias("component_id"))
    ids = labelled.join(least, "label").select("node", "component_id", "label")
    return (rows.join(ids, "node", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
                    .alias("component_id"), "text_hash",
                    F.when(F.col("n") > 0, F.col("label")).alias("component")))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with the least key; all columns stay.

    Rows that have this key and text too are repeats, one of them stays. A document without words is
    no component's and stays. Among different texts with the least key, or without any key, the one
    with the least text hash stays.
    """
    found = cut(near_duplicates(docs, key, text, **options)
                .where("component is not null")
                .groupBy("component", F.col(key).alias("_key"), F.col("text_hash").alias("_hash"))
                .agg(F.count("*").alias("_n")))
    first = F.struct(F.col("_key").isNull(), "_key", "_hash")
    best = found.groupBy("component").agg(F.min(first).alias("_best"))
    marked = found.join(best, "component").withColumn("_stays", F.col("_best") == first)
    gone = cut(marked.where("not _stays").select("_key", "_hash"))
    repeated = cut(marked.where("_stays and _n > 1").select("_key", "_hash"))
    own = F.xxhash64(docs[text])

    def among(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        return rows.join(listed, docs[key].cast("long").eqNullSafe(listed["_key"])
                         & (own == listed["_hash"]), how)

    kept = among(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    once = among(kept, repeated, "left_semi").groupBy(docs[key], docs[text]).agg(
        *[F.first(docs[c]).alias(c) for c in docs.columns if c not in (key, text)])
    return among(kept, repeated, "left_anti").unionByName(once)
