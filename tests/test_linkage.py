"""Fuzzy pairs, decayed interactions and embeddings against plain versions."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graphs, joins


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_fuzzy_pairs_equal_all_pairs(spark, distance):
    r = random.Random(distance)
    keys = {"", "a", "ab", "aé", "日本語", "a b"} | {"".join(r.choice("abé") for _ in range(r.randrange(1, 12))) for _ in range(120)}
    for prefix in (0, 2):
        got = {(x.a, x.b) for x in joins.fuzzy_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), "k", prefix, distance).collect()}
        assert got == {(a, b) for a, b in itertools.combinations(sorted(keys, key=str.encode), 2) if a[:prefix] == b[:prefix] and edits(a, b) <= distance}


def test_decayed_weights(spark):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    df = spark.createDataFrame([("a", "x", day(0)), ("a", "x", day(10)), ("b", "x", day(20)), ("b", None, day(1)), (None, "x", day(1)), ("b", "y", None)], "e string, i string, t timestamp_ntz")
    got = {(r.e, r.i): r.w for r in graphs.decayed_weights(df, "e", "i", "t", 10.0).collect()}
    assert got == pytest.approx({("a", "x"): 0.75, ("b", "x"): 1.0})
    then = graphs.decayed_weights(df, "e", "i", "t", 10.0, F.lit(day(10))).collect()
    assert {(r.e, r.i): r.w for r in then} == pytest.approx({("a", "x"): 1.5})
    assert graphs.decayed_weights(df.limit(0), "e", "i", "t", 1.0).collect() == []


def test_embedding_converges_to_the_leading_directions(spark):
    rng = np.random.default_rng(4)
    m = rng.random((12, 7)) * (rng.random((12, 7)) < 0.7)
    w = spark.createDataFrame([(e, i, float(m[e, i])) for e in range(12) for i in range(7) if m[e, i]], "e int, i int, w double")
    got = np.array([r.vector for r in graphs.embed(w, "e", "i", 2, tol=1e-9).orderBy("e").collect()])
    u, s, _ = np.linalg.svd(m)
    assert np.sort(np.linalg.svd(got, compute_uv=False)) == pytest.approx(np.sort(s[:2]), rel=1e-4)
    assert np.abs(got - u[:, :2] @ u[:, :2].T @ got).max() < 1e-3
    with pytest.raises(RuntimeError):
        graphs.embed(w, "e", "i", 2, tol=0.0, most=2)
