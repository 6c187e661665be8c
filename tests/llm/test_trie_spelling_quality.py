"""Prefix trie, spelling variants and quality scores against brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import prefix_trie, pu_quality, spelling

TURNS = "conv_id long, turn long, role string, text string, depth int, `conv` string, one string"


# --- prefix trie ------------------------------------------------------------------------------------

def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_trie(rows):
    """The contract read literally: sequences, their prefixes, walks over all subtrees."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), md5(md5(role) + md5(text)), (role, text)))
    turns = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for prefix, convs in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == prefix)))
        out.add((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs),
                 children[prefix], sum(children[p] == 0 for p in below),
                 sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS)
    return [tuple(r) for r in prefix_trie.trie(df).collect()]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-12, 60), 45):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 12])):
            text = rng.choice(["a", "b", "bé", "", None]) if turn > 2 else "hello"
            rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(["user", None]) if turn else "user", text))
    for turn in range(70):  # far longer than all others, twice
        rows += [(100, turn, "user", f"t{turn}"), (101, turn, "user", f"t{turn if turn < 60 else -turn}")]
    rows += [(None, 1, "user", "no conversation"), (7, 0, "user", "hello"), (7, 0, "user", "hello")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(spark, seed):
    rows = conversations(seed)
    got = trie_rows(spark, rows)
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_copies_and_of_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)  # one end node over many blocks of ids
    rows = [(c, t, "user", "same") for c in range(0, 400, 5) for t in range(3)]
    rows += [(c, 0, "user", "own") for c in range(1, 400, 40)]  # fewer turns than are shared
    got = trie_rows(spark, rows)
    assert set(got) == plain_trie(rows) and len(got) == len(set(got))


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "a", "b")]) == []
    # its one turn is replaced by a base that is not there: the root is all there is
    lone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert set(trie_rows(spark, [(lone, 1, "a", "b")])) == plain_trie([(lone, 1, "a", "b")])


# --- spelling variants ------------------------------------------------------------------------------

def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(docs):
    """The contract read literally, every word against every other."""
    import re
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            seen[spelling.cut(word, "" if doc is None else str(doc))] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def word_documents(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("etanhirxzéÉ÷ß") for _ in range(rng.randint(4, 8))) for _ in range(14)]
    docs = []
    for doc in range(90):
        words = []
        for _ in range(60):
            word = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.choice([0, 0, len(word), rng.randrange(len(word) + 1)])
                word = word[:at] + rng.choice("eéx") + word[at + rng.choice([0, 1]):]
            words.append(word.upper() if rng.random() < 0.1 else word)
        docs.append((doc, " ".join(words) + ". "))
    return docs + [(3, docs[3][1]), (None, docs[4][1]), (500, None), (501, ""), (502, "漢字 12 _")]


def variant_rows(spark, docs, **options):
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    rows = spelling.variants(df, **options).collect()
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows]


@pytest.mark.parametrize("options", [{}, {"levels": 1}, {"levels": 3, "most_words": 4}, {"levels": 6}])
def test_variants_equal_all_pairs(spark, options):
    docs = word_documents(5)
    got, want = variant_rows(spark, docs, **options), plain_variants(docs)
    assert len(want) > 60 and any(r[2] != r[1] and r[1] for r in want)
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_very_long_words_and_of_nothing(spark):
    long = "e" * 1500 + "t" * 30
    docs = [(k, f"{long} {long}n {long[1:]} {long[:-1]} e{long} {'n' + long[1:]} short shorts") for k in range(8)]
    assert set(variant_rows(spark, docs)) == plain_variants(docs)
    assert variant_rows(spark, []) == [] and variant_rows(spark, [(1, None)]) == []


def test_near_pairs_are_found_once_whatever_the_batches(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 64)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("enxé") for _ in range(rng.randint(5, 7))) for _ in range(300)})
    held = spelling.Words(words, np.ones(len(words), np.int64))
    tree = spelling.Subtree(words, np.ones(len(words), np.int64), 1)
    a, b = tree.near(held)
    got = [frozenset((held.words[i], tree.held.words[j])) for i, j in zip(a, b, strict=True)]
    want = {frozenset((v, w)) for v in words for w in words if one_apart(v, w)}
    assert len(got) == len(set(got)) and set(got) == want


# --- quality scores ---------------------------------------------------------------------------------

def quality_tables(spark, n=1200):
    rng = random.Random(11)
    texts, labels = [], []
    for doc in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        if good:
            text = ". ".join(" ".join(words[k:k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        else:
            text = rng.choice([" | ".join(words[:30]), (words[0] + " ") * 50, " ".join(w + "###" for w in words)])
        texts.append((doc, text, 7.0, "x"))
        if doc % 3:
            labels.append((doc, int(good), 1))
    texts += [(None, None, 1.0, "y"), (n, "", 1.0, "y"), (0, texts[0][1], 1.0, "y")]
    labels += [(None, 1, 1), (n + 5, 1, 0), (1, None, 0)]
    return (spark.createDataFrame(texts, "doc_id long, text string, x double, trusted string"),
            spark.createDataFrame(labels, "doc_id long, quality int, half int"))


def held(df):
    return F.crc32(df["doc_id"].cast("string")) % 4 == 2


def test_scores_of_held_out_documents(spark):
    docs, labels = quality_tables(spark)
    rows = pu_quality.score(docs, labels, held(docs)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None}
    hidden = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in hidden) and len(hidden) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in hidden) >= 0.95 * len(hidden)
    assert not any(r.held_out for r in rows if r.doc_id is None)


def test_only_positives_outside_the_held_out_part_count(spark):
    docs, labels = quality_tables(spark, 400)
    other = labels.withColumn("quality", F.when(held(labels), 1 - F.col("quality")).otherwise(F.col("quality"))) \
        .where(held(labels) | (F.col("quality") == 1) | F.col("quality").isNull())
    a = pu_quality.score(docs, labels, held(docs)).collect()
    b = pu_quality.score(docs, other, held(docs)).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in a) == sorted((r.doc_id or -1, round(r.score, 9)) for r in b)


def test_prior_and_risk_against_plain_sums(spark):
    docs, labels = quality_tables(spark)
    rows = pu_quality.described_rows(docs, labels, held(docs)).where(~F.col("held_out")).cache()
    model = pu_quality.Model(pu_quality.quantile_edges(rows))
    assert abs(pu_quality.class_prior(rows, model.edges) - 0.7) < 0.1
    table = rows.select("trusted", "x").toArrow().combine_chunks()
    x = model.exceeded(pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], table.column_names))
    trusted = np.array(table.column("trusted").to_pylist())
    tried = np.random.default_rng(0).normal(size=(3, pu_quality.WEIGHTS)) / 9
    model.weights = tried[0]
    f = x @ tried.T
    want = [np.log1p(np.exp(-f[trusted])).mean(0), np.log1p(np.exp(f[trusted])).mean(0), np.log1p(np.exp(f)).mean(0)]
    assert np.allclose(pu_quality._losses(rows, model, tried), want)
    n, mean, hit, curve, n_all, mean_all, hit_all, curve_all = pu_quality._slopes(rows, model)
    s = 1 / (1 + np.exp(-f[:, 0]))
    assert (n, n_all) == (trusted.sum(), len(trusted)) and np.allclose(mean, x[trusted].mean(0))
    assert np.allclose(hit, s[trusted] @ x[trusted] / n) and np.allclose(hit_all, s @ x / n_all)
    assert np.allclose(curve_all, (x.T * (s * (1 - s))) @ x / n_all)


def test_quality_without_positives_or_rows(spark):
    docs, labels = quality_tables(spark, 40)
    rows = pu_quality.score(docs, labels.where("false"), held(docs)).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == docs.count()
    assert pu_quality.score(docs.where("false"), labels, held(docs)).collect() == []
