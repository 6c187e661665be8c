"""Blocked scans against direct loops: tiny blocks, one key with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators.median import exact_medians
from sessionlens.operators.ordered import as_of, with_position, with_previous, with_sums

KEYS = ["k"]


def skewed_rows(seed, n=300, unique=True):
    rng = random.Random(seed)
    orders = rng.sample(range(-200, 2_000), n) if unique else [rng.randrange(-20, 120) for _ in range(n)]
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(12)}", o,
             rng.randrange(100) if rng.random() < 0.4 else None) for o in orders]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_previous(spark, bits):
    rows = skewed_rows(1)
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = {(r.k, r.o): r.prev for r in with_previous(df, KEYS, "o", {"prev": F.col("v")}, bits).collect()}
    want = {}
    for k, o, _ in rows:
        earlier = [(o2, v) for k2, o2, v in rows if k2 == k and o2 < o and v is not None]
        want[(k, o)] = max(earlier)[1] if earlier else None
    assert got == want


@pytest.mark.parametrize("bits", [1, 4])
def test_position(spark, bits):
    rows = skewed_rows(2)
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = {(r.k, r.o): r.n for r in with_position(df, KEYS, "o", "n", bits).collect()}
    assert got == {(k, o): sum(k2 == k and o2 <= o for k2, o2, _ in rows) for k, o, _ in rows}


@pytest.mark.parametrize("bits", [1, 4])
def test_sums(spark, bits):
    rows = skewed_rows(5)
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    sums = with_sums(df, KEYS, "o", {"a": F.col("v"), "b": F.lit(2)}, bits)
    got = {(r.k, r.o): (r.a or 0, r.b) for r in sums.collect()}
    assert sums.columns == ["k", "o", "v", "a", "b"]
    assert got == {(k, o): (sum(v or 0 for k2, o2, v in rows if k2 == k and o2 <= o),
                            2 * sum(k2 == k and o2 <= o for k2, o2, _ in rows)) for k, o, _ in rows}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("mode", ["back", "forward", "greatest"])
def test_as_of(spark, inclusive, mode):
    values, asks = skewed_rows(3, unique=False), skewed_rows(4, unique=False)
    vdf = spark.createDataFrame(values, "k string, o bigint, v int")
    adf = spark.createDataFrame([(i, k, o) for i, (k, o, _) in enumerate(asks)] + [
        (998, None, 5), (999, "hot", None)], "i int, k string, t bigint")
    got = {r.i: (r.a, r.b) for r in as_of(
        adf, vdf, KEYS, at="t", order="o",
        payloads={"a": F.col("v") if mode == "greatest" else F.struct("o", "v")["v"],
                  "b": F.when(F.col("v") % 2 == 0, F.col("v"))},
        inclusive=inclusive, forward=mode == "forward", greatest=mode == "greatest", bits=2).collect()}

    def find(k, t, keep):
        hits = [(o, v) for k2, o, v in values if k2 == k and v is not None and keep(v)
                and ((o > t or inclusive and o == t) if mode == "forward"
                     else (o < t or inclusive and o == t))]
        if not hits:
            return None
        if mode == "greatest":
            return max(v for _, v in hits)
        near = (min if mode == "forward" else max)(o for o, _ in hits)
        return (min if mode == "forward" else max)(v for o, v in hits if o == near)

    for i, (k, o, _) in enumerate(asks):
        assert got[i] == (find(k, o, lambda v: True), find(k, o, lambda v: v % 2 == 0)), (k, o)
    assert got[998] == (None, None) and got[999] == (None, None)
    assert len(got) == len(asks) + 2


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_exact_medians(spark, accuracy):
    import statistics

    rng = random.Random(5)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000), ("e", 3)):
        rows += [(g, rng.choice([rng.random() * 50, 7.0]), rng.randrange(40)) for _ in range(n)]
    rows += [("e", None, 4), ("f", None, None)]
    got = {r.g: r for r in exact_medians(
        spark.createDataFrame(rows, "g string, x double, y int"), ["g"], ["x", "y"], accuracy).collect()}
    for g in "abcdef":
        for m, i in (("median_x", 1), ("median_y", 2)):
            vals = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert got[g][m] == (statistics.median(vals) if vals else None)
        assert got[g].rows == sum(r[0] == g for r in rows)
