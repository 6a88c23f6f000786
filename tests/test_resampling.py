"""Intervals and null distributions against plain versions on the same draws, and on nulls, copies and empty tables."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import resampling as R

SCHEMA = "k bigint, g string, y double, a double, b double, c double"


def rows(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, g = r.gauss(0, 1), r.choice("pq")
        out.append((i, g, a + r.gauss(0, 1) + 5 * (g == "q"), a if r.random() > 0.1 else None, r.gauss(0, 1), 7.0))
    return out + [(None, "p", 1.0, 1.0, 1.0, 7.0), (n, "p", None, 1.0, 1.0, 7.0), (n + 1, None, 1.0, 1.0, 1.0, 7.0)]


def plain_bca(h, w, v, f, replicates, level):
    draws = R.poisson_weights(h, replicates) * w[:, None]
    values = np.sort(f((draws * v[:, None]).sum(axis=0) / draws.sum(axis=0)))
    metric = f((w * v).sum() / w.sum())
    left = np.array([f((np.delete(w, i) * np.delete(v, i)).sum() / np.delete(w, i).sum()) for i in range(len(v))])
    d = left.mean() - left
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    n = NormalDist()
    z0 = n.inv_cdf(((values < metric).sum() + (values == metric).sum() / 2) / len(values))
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + n.inv_cdf(p)
        ends.append(np.quantile(values, n.cdf(z0 + z / (1 - a * z))))
    return metric, *ends, z0, a


@pytest.mark.parametrize("weighted", [False, True])
def test_bca_equals_the_plain_jackknife(spark, weighted):
    data = [(i, random.Random(i).expovariate(1.0), float(i % 3)) for i in range(150)]
    df = spark.createDataFrame([*data, (500, None, 1.0)], "k bigint, v double, w double").repartition(3)
    got = R.bootstrap_bca(df, F.col("v") ** 2, "k", F.col("w") if weighted else None, F.sqrt, 300, 0.9, seed=4).first()
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64(F.lit(4), "k").alias("h")).collect()}
    own = [(k, v, w if weighted else 1.0) for k, v, w in data if w or not weighted]
    h = np.array([hashes[k] for k, *_ in own], np.int64).view(np.uint64)
    want = plain_bca(h, np.array([w for *_, w in own]), np.array([v * v for _, v, _ in own]), np.sqrt, 300, 0.9)
    assert tuple(got) == pytest.approx(want, rel=1e-6)
    assert got.low < got.metric < got.high
    again = R.bootstrap_bca(df.repartition(7), F.col("v") ** 2, "k", F.col("w") if weighted else None, F.sqrt, 300, 0.9, seed=4).first()
    assert tuple(again) == pytest.approx(tuple(got))


def test_bca_covers_the_mean(spark):
    """Of intervals of 80 % for a mean, about so many hold it."""
    rng, hit = np.random.default_rng(1), 0
    for s in range(20):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.exponential(2.0, 60))], "k bigint, v double")
        got = R.bootstrap_bca(df, F.col("v"), "k", replicates=200, level=0.8, seed=s).first()
        hit += got.low <= 2.0 <= got.high
    assert hit >= 10


def test_bca_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([(1, None)], "k bigint, v double")
    assert tuple(R.bootstrap_bca(none, F.col("v"), "k").first()) == (None,) * 5
    flat = spark.createDataFrame([(i, 2.0) for i in range(9)], "k bigint, v double")
    assert tuple(R.bootstrap_bca(flat, F.col("v"), "k").first())[:3] == (2.0, 2.0, 2.0)


def plain_null(spark, data, features, stratum, permutations, seed):
    data = [r for r in data if r[0] is not None and r[2] is not None and (not stratum or r[1] is not None)]
    col = {"y": 2, "a": 3, "b": 4, "c": 5}
    centred = {c: np.array([np.nan if r[i] is None else r[i] for r in data], float) for c, i in col.items()}
    for c, v in centred.items():
        centred[c] = np.where(np.isnan(v), 0.0, v - np.nanmean(v))
    keys = spark.createDataFrame([(i, r[0], r[1] if stratum else "") for i, r in enumerate(data)], "i int, k bigint, s string")
    size = {g: sum((r[1] if stratum else "") == g for r in data) for g in {r[1] if stratum else "" for r in data}}
    block = {}
    for r in keys.select("i", "s", "k", F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 40)).alias("_"), F.xxhash64(F.lit(seed), "k").alias("h")).collect():
        block.setdefault((r.s, r.h % math.ceil(size[r.s] / R.BLOCK)), []).append((r.k, r.i))
    name = lambda g, b: spark.range(1).select(F.xxhash64(F.lit(g) if stratum else F.lit(0), F.lit(b).cast("long"))).first()[0]
    total = np.zeros((permutations, len(features)))
    for (g, b), own in block.items():
        at = [i for _, i in sorted(own)]
        order = R.exchanges(len(at), name(g, b), permutations, seed)
        for n in range(permutations):
            for j, f in enumerate(features):
                total[n, j] += centred["y"][at][order[n]] @ centred[f][at]
    scale = [1 / math.sqrt(s) if (s := (centred[f] ** 2).sum() * (centred["y"] ** 2).sum()) > 1e-300 else 0.0 for f in features]
    observed = np.abs([centred["y"] @ centred[f] for f in features]) * scale
    return observed, np.abs(total) * scale


@pytest.mark.parametrize("stratum", [None, "g"])
def test_max_statistic_equals_plain_exchanges(spark, monkeypatch, stratum):
    monkeypatch.setattr(R, "BLOCK", 40)
    data, features = rows(1), ["a", "b", "c"]
    df = spark.createDataFrame(data, SCHEMA)
    observed, null = plain_null(spark, data, features, stratum, 30, 5)
    got = {r.feature: r for r in R.max_statistic_test(df.repartition(3), features, "y", "k", stratum, 30, seed=5).collect()}
    top = null.max(axis=1)
    for j, f in enumerate(features):
        assert got[f].corr == pytest.approx(observed[j])
        assert got[f].p_value == pytest.approx((1 + (null[:, j] >= observed[j] - 1e-12).sum()) / 31)
        assert got[f].adjusted == pytest.approx((1 + (top >= observed[j] - 1e-12).sum()) / 31)
        assert got[f].floor == pytest.approx(np.quantile(top, 0.95))
    assert got["a"].adjusted < 0.1 < got["c"].adjusted and got["c"].corr == 0.0


def test_no_rows_no_gain(spark):
    got = R.max_statistic_test(spark.createDataFrame([], SCHEMA), ["a", "b"], "y", "k", permutations=5).collect()
    assert all(r.corr == 0.0 for r in got)


def test_noise_is_below_the_floor(spark):
    rng = np.random.default_rng(3)
    data = [(i, "p", *map(float, rng.normal(size=4))) for i in range(400)]
    got = R.max_statistic_test(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"], "y", "k", permutations=100).collect()
    assert all(r.corr < 1.3 * r.floor and r.adjusted >= r.p_value for r in got)
