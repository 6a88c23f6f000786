"""Neighbour searches against all pairs, with nulls, ties, copies, unlike lengths and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graphs, neighbours

SCHEMA = "k bigint, v array<double>, g int, t double"


def rows(seed, n=150, width=4):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.integers(-2, 3, width)], int(rng.integers(3)), float(rng.integers(20))) for i in range(n)]
    return out + [(900, None, 0, 1.0), (901, [1.0, None, 0.0, 0.0], 0, 1.0), (902, [float("nan")] * 4, 0, 1.0), (903, [1.0, 2.0], 0, 1.0), (904, [1.0, 2.5], 0, 2.0), (None, [0.0] * 4, 0, 1.0), (905, [0.0] * 4, 1, None), (906, [], 1, 1.0), (5, out[5][1], out[5][2], out[5][3])]


def distance(a, b, metric):
    a, b = np.array(a), np.array(b)
    if metric == "cosine":
        return None if not a.any() or not b.any() else 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.abs(a - b).sum() if metric == "manhattan" else np.sqrt(((a - b) ** 2).sum()))


def plain(queries, data, k, metric="euclidean", allowed=lambda q, r: True):
    ok = lambda r: r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])
    out = {}
    for q in filter(ok, queries):
        near = {(round(d, 9), r[0]) for r in filter(ok, data) if r[0] != q[0] and len(r[1]) == len(q[1]) and allowed(q, r) and (d := distance(q[1], r[1], metric)) is not None}
        out[q[0]] = [d for d, _ in sorted(near)[:k]]
    return {q: d for q, d in out.items() if d}


def lists(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query"], [])) + 1
        out[r["query"]].append(round(r["distance"], 9))
    return out


def close(a, b):
    assert a.keys() == b.keys() and all(np.allclose(a[q], b[q], atol=1e-7) and len(a[q]) == len(b[q]) for q in a)


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_exact_search_equals_all_pairs(spark, monkeypatch, metric):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    monkeypatch.setattr(neighbours, "ROWS", 40)  # several blocks
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    got = neighbours.nearest_rows(df.where("k % 2 = 0 or k is null"), df, "v", "k", 7, metric)
    close(lists(got), plain([r for r in data if r[0] is None or r[0] % 2 == 0], data, 7, metric))
    within = neighbours.nearest_rows(df, df, "v", "k", 4, metric, F.col("g"))
    close(lists(within), plain(data, data, 4, metric, lambda q, r: q[2] == r[2]))


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(i, [float(i % 2)], 0, 0.0) for i in range(12)], SCHEMA)
    got = neighbours.nearest_rows(df.where("k = 6"), df, "v", "k", 3).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [0, 2, 4] and [r["weight"] for r in got] == [1.0] * 3


@pytest.mark.parametrize("levels", [1, 4])
def test_earlier_rows_only(spark, levels):
    data = rows(2)
    got = neighbours.nearest_earlier(spark.createDataFrame(data, SCHEMA), "v", "k", "t", 5, "manhattan", levels)
    timed = [r for r in data if r[3] is not None]
    close(lists(got), plain(timed, timed, 5, "manhattan", lambda q, r: r[3] < q[3]))


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (40, 16))
    points = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 1, (6000, 16))
    data = [(i, p.tolist(), 0, 0.0) for i, p in enumerate(points)] + [(7000 + i, points[0].tolist(), 0, 0.0) for i in range(500)] + [(9000, [1.0], 0, 0.0), (9001, [2.0], 0, 0.0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3).cache()
    queries = df.where("k % 20 = 0 or k > 8999")
    exact, about = lists(neighbours.nearest_rows(queries, df, "v", "k", 10)), lists(neighbours.approximate_neighbours(queries, df, "v", "k", 10))
    found = sum(sum(d <= exact[q][-1] + 1e-9 for d in about.get(q, [])) for q in exact)
    assert found / sum(map(len, exact.values())) >= 0.9
    assert about[9000] == [1.0]
    index = neighbours.fit_index(points, len(points), 10)
    assert index.bits >= 3 and index.probes * 2 <= len(index.masks)  # it does skip buckets here


def test_empty_tables_and_odd_metrics(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0], 0, 0.0)], SCHEMA)
    for f in (lambda a, b: neighbours.nearest_rows(a, b, "v", "k", 3), lambda a, b: neighbours.approximate_neighbours(a, b, "v", "k", 3)):
        assert f(one, none).collect() == f(none, one).collect() == f(one, one).collect() == []
    assert neighbours.nearest_earlier(none, "v", "k", "t", 3).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest_rows(one, one, "v", "k", 3, "chebyshev")


def test_out_of_fold_guesses(spark):
    data = [(i, [float(i % 7), float(i % 3)], i % 2, 0.0) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    fold = {r.k: r.f for r in df.select("k", F.pmod(F.xxhash64("k"), F.lit(5)).alias("f")).collect()}
    for r in graphs.out_of_fold_neighbours(df, "k", "v", "g").collect():
        near = sorted((distance(data[r.k][1], x[1], "euclidean"), x[0]) for x in data if fold[x[0]] != fold[r.k])[:5]
        assert abs(r.guess - np.mean([data[i][2] for _, i in near])) < 1e-9 and r.fold == fold[r.k]


def test_snapshots(spark):
    data = [("a", 1.0, 1.0), ("a", 3.0, None), ("b", 2.0, 2.0), ("c", 9.0, 9.0), (None, 1.0, 1.0), ("d", None, 4.0), ("e", 2.0, 2.0)]
    got = {r.s: r for r in neighbours.snapshot_neighbours(spark.createDataFrame(data, "s string, x double, y double"), "s", ["x", "y"], 2).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"].x_mean == 2.0 and got["a"].distance_ratio == 1.0 and got["b"].distance_ratio == 0.0
