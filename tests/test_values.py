"""Values of the operators that SQL can't express, against plain versions."""

import itertools
import random

import numpy as np
import pytest

from plumbline.operators import aggregates as A
from plumbline.operators import blends as B
from plumbline.operators import frames as P
from plumbline.operators import graphs as G
from plumbline.operators import windows as W


def test_best_positions_against_all_paths(spark):
    r = random.Random(2)
    prices = {e: [round(10 + r.gauss(0, 2), 2) for _ in range(7)] for e in "ab"}
    df = spark.createDataFrame([(e, i, p) for e, ps in prices.items() for i, p in enumerate(ps)], "e string, i int, p double").repartition(3)
    got = {}
    for x in W.best_positions(df, "e", ["i"], "p", 0.05).collect():
        got.setdefault(x.e, {})[x.step] = (x.position, x.profit)
    for e, ps in prices.items():
        moves = np.diff(ps)

        def total(path, ps=ps, moves=moves):
            return sum(s * m for s, m in zip(path, moves)) - sum(0.05 * ps[i] * abs(s - o) for i, (o, s) in enumerate(zip((0, *path), path)))

        path = tuple(got[e][i][0] for i in range(6))
        assert total(path) == pytest.approx(max(map(total, itertools.product((-1, 0, 1), repeat=6))))
        assert [got[e][i][1] for i in range(6)] == pytest.approx(list(np.array(path) * moves))


def test_merge_short_states(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate("aaabccaabbbd")], "e int, i int, s string")
    got = "".join(r.s for r in W.merge_short_states(df, "e", ["i"], "s", "i", 2).orderBy("i").collect())
    assert got == "aaaaccaabbbb"


def test_density_mode(spark):
    v = [1.0, 1.1, 0.9, 5.0, 5.1, 4.9, 5.05]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, 3.0), ("b", 1, 3.0), ("c", 0, None)], "e string, i int, v double")
    got = {r.e: r for r in W.density_mode(df, "e", ["i"], "v", half_life=3.0, grid=200).collect()}
    w = [0.5 ** ((len(v) - 1 - i) / 3.0) for i in range(len(v))]
    width = 1.06 * np.std(v) * len(v) ** -0.2
    dense = lambda x: sum(a * np.exp(-0.5 * ((x - b) / width) ** 2) for a, b in zip(w, v)) / (sum(w) * width * np.sqrt(2 * np.pi))
    xs = np.linspace(min(v), max(v), 200)
    assert got["a"].mode == pytest.approx(max(xs, key=dense)) and got["a"].peak == pytest.approx(max(map(dense, xs)))
    assert (got["b"].mode, got["b"].peak) == (3.0, 1.0) and got["c"].mode is None


def test_adaptive_ewma(spark):
    r = random.Random(5)
    v = [r.gauss(0, 1) + i * (i % 7 == 0) for i in range(40)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "e string, i int, v double")
    got = W.adaptive_ewma(df, "e", ["i"], "v", (0.1, 0.5, 0.9), tail=15).first()
    errors = {}
    for a in (0.1, 0.5, 0.9):
        at, es = v[0], []
        for x in v[1:]:
            es.append((x - at) ** 2)
            at = a * x + (1 - a) * at
        errors[a] = sum(es[-15:])
    best = min(errors, key=errors.get)
    assert got.alpha == best and got.sse == pytest.approx(errors[best])


def test_huber_screen_and_permutations(spark):
    r = random.Random(9)
    v = [r.gauss(10, 2) for _ in range(200)] + [900.0, 1000.0]
    df = spark.createDataFrame(list(enumerate(v)), "k int, v double").repartition(3)
    med = np.median(v)
    scale = 1.4826 * np.median(np.abs(np.array(v) - med))
    at = A.m_estimate(df, "v", rounds=100)
    assert abs(np.clip((np.array(v) - at) / scale, -1.345, 1.345).sum()) < 1e-4
    rows = [(i, i % 4, i % 4, r.randrange(3), (i % 4) // 2) for i in range(400)]
    codes = spark.createDataFrame(rows, "k int, a int, b int, c int, y int")
    got = A.screen(codes, ["a", "b", "c"], "y", 2)
    assert got[0][0] in "ab" and got[0][1] == pytest.approx(np.log(2)) and got[1][0] == "c"  # the twin is wholly redundant
    strata = spark.createDataFrame([(i, i % 2, float(i), float(i) + r.gauss(0, 5)) for i in range(60)], "k int, s int, x double, y double")
    test = A.permutation_test(strata, "s", "x", "y", "k", 40).first()
    d = strata.toPandas()
    assert test.observed == pytest.approx(abs(np.corrcoef(d.x, d.y)[0, 1])) and test.p_value == pytest.approx(1 / 41)
    noise = spark.createDataFrame([(i, 0, r.random(), r.random()) for i in range(60)], "k int, s int, x double, y double")
    assert A.permutation_test(noise, "s", "x", "y", "k", 40).first().p_value > 0.02


def test_blends_and_baldwin(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=300)
    preds = np.stack([y + rng.normal(size=300), y + rng.normal(size=300) * 2, rng.normal(size=300)], axis=1)
    df = spark.createDataFrame([(float(t), *map(float, p)) for t, p in zip(y, preds)], "y double, a double, b double, c double").repartition(3)
    loss = lambda w: ((preds @ np.array(w) - y) ** 2).mean()
    w = B.simplex_weights(df, ["a", "b", "c"], "y")
    grid = [(i / 40, j / 40, 1 - (i + j) / 40) for i in range(41) for j in range(41 - i)]
    assert sum(w.values()) == pytest.approx(1) and loss([w[c] for c in "abc"]) <= min(map(loss, grid)) + 1e-4
    h = B.hill_climb(df, ["a", "b", "c"], "y", steps=12)
    counts, best = np.zeros(3), np.inf
    for _ in range(12):
        tries = [((counts + np.eye(3)[i]) / (counts.sum() + 1), i) for i in range(3)]
        value, i = min((loss(x), i) for x, i in tries)
        if value >= best - 1e-12:
            break
        best, counts[i] = value, counts[i] + 1
    assert [h[c] for c in "abc"] == pytest.approx(list(counts / counts.sum()))
    s = spark.createDataFrame([(t, m, float(v)) for m, vs in {"a": [3, 3, 1], "b": [2, 2, 3], "c": [1, 1, 2]}.items() for t, v in enumerate(vs)], "task int, model string, score double")
    assert P.baldwin(s) == ["a"]


def test_out_of_fold_neighbours(spark):
    r = random.Random(4)
    rows = [(i, [r.random(), r.random()], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>, y int").repartition(3)
    got = {x.k: (x.fold, x.guess) for x in G.out_of_fold_neighbours(df, "k", "v", "y", folds=3, k=4).collect()}
    assert set(got) == {k for k, *_ in rows}
    for k, v, _ in rows:
        near = sorted((np.hypot(v[0] - w[0], v[1] - w[1]), j) for j, w, _ in rows if got[j][0] != got[k][0])[:4]
        assert got[k][1] == pytest.approx(np.mean([j % 2 for _, j in near]))


def test_embedding_spans_the_leading_directions(spark):
    rng = np.random.default_rng(6)
    m = rng.random((12, 5)) + np.outer(np.arange(12) % 2, [5, 0, 5, 0, 5])
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(5)], "e int, i int, w double")
    got = np.array([r.vector for r in G.embed(df, "e", "i", rank=2, rounds=12).orderBy("e").collect()])
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    left = np.linalg.norm(u[:, :2] - got @ np.linalg.lstsq(got, u[:, :2], rcond=None)[0])
    assert left < 1e-3 and np.sort(np.linalg.svd(got, compute_uv=False)) == pytest.approx(np.sort(s[:2]), rel=1e-3)


def test_spectral_gap(spark):
    ring = [(1, i, (i + 1) % 6) for i in range(6)] + [(2, 10, 11)]
    got = {r.g: (r.n, r.gap) for r in G.spectral(spark.createDataFrame(ring, "g int, src int, dst int"), "g").collect()}
    assert got[1] == (6, pytest.approx(1.0)) and got[2] == (2, pytest.approx(2.0))


def test_asof_without_keys(spark):
    from plumbline.operators import aggregates, asof

    r = random.Random(11)
    left = [(i, r.choice([None, r.randrange(100)])) for i in range(200)]
    right = [(r.randrange(10, 90), j, None if j % 7 == 0 else float(j)) for j in range(60)] + [(None, 99, 5.0)]
    old, aggregates.RANGE_ROWS = aggregates.RANGE_ROWS, 20
    l_df, r_df = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "t int, j int, v double")
    got = {x.k: x.v for x in asof.asof_join(l_df.repartition(3), r_df.repartition(2), "t", [], ["v"], tiebreak="j").collect()}
    aggregates.RANGE_ROWS = old
    for k, t in left:
        before = [(u, j, v) for u, j, v in right if t is not None and u is not None and u <= t]
        assert got[k] == (max(before, key=lambda x: x[:2])[2] if before else None)
