"""Dominance counting, positions and what rests on them against plain versions; nulls in recursions along an entity."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dominance, windows


@pytest.mark.parametrize("seed", range(3))
def test_merge_counting(seed):
    rng = np.random.default_rng(seed)
    group, value, weight = np.sort(rng.integers(0, 4, 90)), rng.integers(0, 12, 90), rng.integers(0, 5, 90)
    want = [sum(weight[j] for j in range(i) if group[j] == group[i] and value[j] < value[i]) for i in range(90)]
    assert dominance.smaller_before(group, value, weight).tolist() == want
    assert dominance.smaller_before(group[:0], value[:0], weight[:0]).tolist() == []


def points(seed, n=300):
    r = random.Random(seed)
    return sorted({(r.choice("aaab") + r.choice(["", "z"]) * (i % 9 == 0), float(r.randrange(25)), float(r.randrange(25))): r.randrange(1, 4) for i in range(n)}.items())


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_dominated_equals_all_pairs(spark, bits):
    data = points(1)
    df = spark.createDataFrame([(*k, w) for k, w in data], "_g string, x double, y double, w bigint").repartition(3)
    got = {(r._g, r.x, r.y): r.below for r in dominance.dominated(df, ["x"], "y", "w", bits).collect()}
    assert got == {(g, x, y): sum(w for (h, a, b), w in data if h == g and a < x and b < y) for (g, x, y), _ in data}


@pytest.mark.parametrize("bits", [2, 16])
def test_positions(spark, bits):
    data = [(g, i) for g, n in (("a", 50), (None, 3), ("b", 1)) for i in range(n)]
    got = dominance.positions(spark.createDataFrame(data, "g string, i int").repartition(4), ["g"], ["i"], "n", bits).collect()
    assert sorted((r.g or "", r.i, r.n) for r in got) == sorted((g or "", i, i + 1) for g, i in data)


def ranked(rows, exclude):
    out = {}
    for e, i, v in rows:
        seen = [w for f, j, w in rows if f == e and w is not None and w == w and (j < i if exclude else j <= i)]
        ok = v is not None and v == v and seen
        out[e, i] = (sum(w < v for w in seen) + (sum(w == v for w in seen) + 1) / 2) / len(seen) if ok else None
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_causal_rank_with_nulls_and_ties(spark, monkeypatch, exclude):
    monkeypatch.setattr(dominance, "BLOCK_BITS", 3)
    r = random.Random(2)
    rows = [(r.choice(["p", "p", "q", None]), i, r.choice([None, float("nan"), 1.0, 2.0, 2.5, 3.0, -1.0])) for i in range(90)]
    df = spark.createDataFrame(rows, "e string, i int, v double").withColumn("extra", F.lit("x")).repartition(3)
    got = windows.causal_rank(df, "e", ["i"], "v", exclude)
    assert got.columns == ["e", "i", "v", "extra", "causal_rank"]
    want = ranked(rows, exclude)
    assert {(r.e, r.i): r.causal_rank and round(r.causal_rank, 9) for r in got.collect()} == {k: v and round(v, 9) for k, v in want.items()}
    assert windows.causal_rank(df.limit(0), "e", ["i"], "v").collect() == []


def plain_concordance(rows):
    s = c = ny = npairs = 0
    for (y1, p1), (y2, p2) in itertools.combinations(rows, 2):
        dy, dp = np.sign(y1 - y2), np.sign(p1 - p2)
        s, ny, npairs = s + dy * dp, ny + abs(dy), npairs + abs(dp)
        c += abs(dy) * (1.0 if dy == dp else 0.5 if dp == 0 else 0.0)
    return (s / np.sqrt(ny * npairs) if ny * npairs else None, c / ny if ny else None)


def test_pair_concordance_with_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dominance, "BLOCK_BITS", 3)
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b"]), r.choice([0.0, 1.0, 2.0, None, 5.5]), r.choice([0.1, 0.2, 0.3, 0.7, None])) for _ in range(120)] + [("one", 1.0, 1.0), ("flat", 1.0, 0.5), ("flat", 1.0, 0.6), (None, 1.0, 2.0)]
    got = {x.g: x for x in dominance.pair_concordance(spark.createDataFrame(rows, "g string, y double, p double"), "g", "y", "p").collect()}
    assert set(got) == {"a", "b", "one", "flat"}
    for g, x in got.items():
        tau, index = plain_concordance([(y, p) for h, y, p in rows if h == g and y is not None and p is not None])
        assert (x.tau_b is None) == (tau is None) and (tau is None or abs(x.tau_b - tau) < 1e-9)
        assert (x.c_index is None) == (index is None) and (index is None or abs(x.c_index - index) < 1e-9)


def test_change_points_pass_over_nulls(spark):
    values = [0.0] * 10 + [10.0] * 10
    for gap in (0, 4, 9, 15, 19):
        rows = [("a", i, None if i == gap else v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "e string, i int, v double")
        assert [r["at"] for r in windows.change_points(df, "e", ["i"], "v", 5.0).collect()] == [10]
    none = spark.createDataFrame([("a", i, None) for i in range(4)], "e string, i int, v double")
    assert windows.change_points(none, "e", ["i"], "v", 5.0).collect() == []


def plain_cuts(v, penalty, least):
    """The cheapest of all ways to cut, by trying them."""
    cost = lambda a, b: ((np.array(v[a:b]) - np.mean(v[a:b])) ** 2).sum()
    best = (np.inf, ())
    for n in range(len(v) // least):
        for cuts in itertools.combinations(range(least, len(v) - least + 1), n):
            edges = [0, *cuts, len(v)]
            if all(b - a >= least for a, b in itertools.pairwise(edges)):
                best = min(best, (sum(cost(a, b) for a, b in itertools.pairwise(edges)) + penalty * n, cuts))
    return list(best[1])


@pytest.mark.parametrize("seed", range(3))
def test_change_points_against_all_cuts(spark, seed):
    r = random.Random(seed)
    v = [r.gauss(r.choice([0, 3]) if i % 4 == 0 else 0, 1) for i in range(12)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "e string, i int, v double")
    assert [x["at"] for x in windows.change_points(df, "e", ["i"], "v", 1.5).collect()] == plain_cuts(v, 1.5, 2)


def test_small_steps_are_no_effect(spark):
    v = [0.0] * 10 + [1.0] * 10 + [9.0] * 10
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "e string, i int, v double")
    at = lambda effect: [x["at"] for x in windows.change_points(df, "e", ["i"], "v", 0.5, effect=effect).collect()]
    assert at(0.0) == [10, 20] and at(1.0) == [20] and at(5.0) == []


def test_best_positions_pass_over_nulls(spark):
    rows = [("a", i, None if i == 7 else 0.0 if i < 10 else 10.0) for i in range(20)] + [("b", 0, None), ("c", 0, 1.0), ("d", 0, None), ("d", 1, None)]
    got = windows.best_positions(spark.createDataFrame(rows, "e string, i int, p double"), "e", ["i"], "p").collect()
    assert sum(r.profit or 0 for r in got) == 10.0
    assert [(r.e, r.step) for r in got if r.position is None] == [("a", 7), ("d", 0)]
    assert sorted(r.step for r in got if r.e == "a") == list(range(19))
