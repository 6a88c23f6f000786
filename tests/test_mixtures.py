"""Shrunk covariances, mixtures and table functions against plain versions, with nulls, constants and empty tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mixtures, tables

SCHEMA = "k int, a double, b double"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + list(extra), SCHEMA).repartition(3)


def plain_shrunk(x):
    """Ledoit and Wolf's estimate from its definition: distances of single rows' products from their mean."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    scale = np.trace(s) / p
    spread = ((s - scale * np.eye(p)) ** 2).sum() / p
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (p * n * n), spread)
    k = noise / spread
    return k, (1 - k) * s + k * scale * np.eye(p)


@pytest.mark.parametrize("n", [8, 200])
def test_mahalanobis_equals_the_definition(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 2)) @ np.array([[2.0, 1.0], [0.0, 0.5]]) + 100
    df = frame(spark, x, [(900, None, 1.0), (901, 1.0, None)])
    fit = mixtures.fit_mahalanobis(df, ["a", "b"])
    k, s = plain_shrunk(x)
    assert fit.shrinkage == pytest.approx(k) and fit.covariance == pytest.approx(s)
    got = {r.k: r.d for r in df.select("k", fit.distance().alias("d")).collect()}
    for i, r in enumerate(x):
        assert got[i] == pytest.approx(math.sqrt((r - x.mean(axis=0)) @ np.linalg.inv(s) @ (r - x.mean(axis=0))))
    assert got[900] is None and got[901] is None


def test_mahalanobis_of_constants_and_nothing(spark):
    flat = frame(spark, [[1.0, 2.0]] * 4)
    assert [r.d for r in flat.select(mixtures.fit_mahalanobis(flat, ["a", "b"]).distance().alias("d")).collect()] == [0.0] * 4
    none = mixtures.fit_mahalanobis(flat.limit(0), ["a", "b"])
    assert flat.select(none.distance().alias("d")).first().d is None


def test_mixture_finds_the_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([0, 1000], [1, 30], (600, 2)), rng.normal([9, 1300], [1, 20], (300, 2)), rng.normal([0, 2000], [2, 10], (100, 2))])
    df = frame(spark, x, [(5000, None, 3.0)])
    fit = mixtures.fit_mixture(df, ["a", "b"], range(1, 5))
    assert len(fit.weights) == 3 and [k for k, *_ in fit.scores] == [1, 2, 3, 4]
    assert fit.weights == pytest.approx([0.6, 0.3, 0.1], abs=0.01)
    assert fit.means[:, 0] == pytest.approx([0, 9, 0], abs=0.5) and fit.means[:, 1] == pytest.approx([1000, 1300, 2000], abs=5)
    got = {r.k: r.m for r in df.select("k", fit.memberships().alias("m")).collect()}
    share, log = mixtures._responsibilities(x, fit.weights, fit.means, fit.covariances)
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(share, abs=1e-6) and got[5000] is None
    k, total, bic = min(fit.scores, key=lambda s: s[2])
    assert total == pytest.approx(log.sum(), rel=1e-4) and bic == pytest.approx((2 + 6 + 9) * math.log(len(x)) - 2 * total)
    again = mixtures.fit_mixture(df.repartition(7), ["a", "b"], range(3, 4))
    assert again.means == pytest.approx(fit.means, rel=1e-3)


def test_one_component_is_the_moments(spark):
    x = np.random.default_rng(5).normal(size=(50, 2)) * [1, 3] + [4, -2]
    fit = mixtures.fit_mixture(frame(spark, x), ["a", "b"], range(1, 2))
    assert fit.means[0] == pytest.approx(x.mean(axis=0)) and fit.covariances[0] == pytest.approx(np.cov(x.T, bias=True), rel=1e-4)


def test_mixture_of_copies_and_nothing(spark):
    flat = frame(spark, [[1.0, 2.0]] * 30)
    fit = mixtures.fit_mixture(flat, ["a", "b"], range(1, 3))
    assert len(fit.weights) == 1 and flat.select(fit.memberships().alias("m")).first().m == [1.0]
    assert mixtures.fit_mixture(flat.limit(0), ["a", "b"]).scores == ()


def test_table_functions(spark):
    tables.register(spark)
    data = [("p", i, None if i == 3 else 10 * i, "xxyyx"[i % 5]) for i in range(7)] + [("q", 0, 7, None), ("q", 1, 8, None)]
    df = spark.createDataFrame(data, "e string, i bigint, node bigint, s string").repartition(3)
    edges = spark.sql("SELECT * FROM recent_edges(TABLE(SELECT * FROM {df}) PARTITION BY e ORDER BY (i), 'node', 2)", df=df)
    nodes = {e: [n for f, _, n, _ in data if f == e and n is not None] for e in "pq"}
    want = {(own[j], own[j - b], b) for own in nodes.values() for j in range(len(own)) for b in (1, 2) if j >= b}
    assert {tuple(r) for r in edges.collect()} == want
    runs = spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM {df}) PARTITION BY e ORDER BY (i), 's', 'i')", df=df)
    want = []
    for e in "pq":
        for s, own in itertools.groupby([d for d in data if d[0] == e], key=lambda d: d[3]):
            own = list(own)
            want.append((s, own[0][1], own[-1][1], len(own)))
    assert sorted(map(tuple, runs.collect()), key=repr) == sorted(want, key=repr)
    none = df.limit(0)
    assert spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM {df}) PARTITION BY e ORDER BY (i), 's', 'i')", df=none).where(F.col("n") > 0).collect() == []
