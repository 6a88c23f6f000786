"""Shapley values of a nearest-neighbour classifier against lists of all pairs: ties, copies, nulls, other lengths, shared keys, many tasks."""

import random

import numpy as np
import pytest

from plumbline.operators import graphs


def plain(train, test, k):
    """As the query's SQL: components lacking in either are passed over, unknown distances stand last, an unknown next hit ends a list."""
    got = {}
    for t in {t for t, _, _ in test}:
        pairs = []
        for _, q, ty in [x for x in test if x[0] == t]:
            for key, v, y in train:
                both = [(a, b) for a, b in zip(q or [], v or [], strict=False) if a is not None and b is not None]
                d = 0.0
                for a, b in both:
                    d += (float(np.float32(a)) - float(np.float32(b))) ** 2
                pairs.append(((not both, d, key), None if y is None or ty is None else float(y == ty)))
        pairs.sort(key=lambda x: x[0])
        s = None
        for i in range(len(pairs), 0, -1):
            (*_, key), hit = pairs[i - 1]
            after = pairs[i][1] if i < len(pairs) else None
            step = (None if hit is None else hit / len(train)) if after is None else None if hit is None else (hit - after) / k * min(k, i) / i
            s = s if step is None else step if s is None else s + step
            got.setdefault(key, []).append(s)
    return {key: np.mean(known) if (known := [x for x in v if x is not None]) else None for key, v in got.items()}


def held(spark, train, test, k=3):
    a, b = (spark.createDataFrame(x, "k long, v array<float>, y int").repartition(3) for x in (train, test))
    got = {r.k: r.value for r in graphs.knn_shapley(a, b, "k", "v", "y", k).collect()}
    want = plain(train, test, k)
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert (got[key] is None) == (v is None) and (v is None or abs(got[key] - v) < 1e-12)


def rows(seed, n, first=0, of=lambda r: r.random()):
    r = random.Random(seed)
    return [(first + i, [of(r) for _ in range(5)], r.randrange(3)) for i in range(n)]


def test_f11_no_pair_is_a_row_of_a_shuffle(spark):
    a, b = (spark.createDataFrame(x, "k long, v array<float>, y int") for x in (rows(1, 40), rows(2, 9, 100)))
    plan = graphs.knn_shapley(a, b, "k", "v", "y")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Window" not in plan


@pytest.mark.parametrize("pieces", [(1 << 24, 1 << 28, 1 << 23, 512), (100, 60, 30, 7)])
def test_f11_values(spark, monkeypatch, pieces):
    for name, v in zip(("HELD", "PAIRS", "SMALL", "SLAB"), pieces, strict=True):
        monkeypatch.setattr(graphs, name, v)
    held(spark, rows(3, 50), rows(4, 12, 100))
    held(spark, rows(5, 43, of=lambda r: float(r.randrange(2))), rows(6, 10, 100, lambda r: float(r.randrange(2))))  # ties


def test_f11_odd_rows(spark):
    train, test = rows(7, 30), rows(8, 8, 100)
    train[3], train[4], train[5], train[6] = (3, None, 1), (4, [], 0), (5, [0.1, None, 0.3, 0.4, 0.5], 1), (6, [0.1, 0.2], None)
    test[1], test[2], test[3] = (101, [None, 0.5, 0.5, 0.5, 0.5], 1), (102, [0.2, 0.1, 0.7, 0.3, 0.9], None), (103, None, 2)
    held(spark, train, test)
    held(spark, rows(9, 20), [*rows(10, 5, 100), (100, [0.9] * 5, 1)])  # test rows of one key share a list


def test_f11_differences_are_of_doubles(spark):
    """In floats, both rows are as far."""
    train = [(1, [1.0], 0), (2, [1.0 - 2**-24], 1)]
    held(spark, train, [(100, [-(2.0**-10)], 1)], 1)


def test_f11_near_ties_are_ordered_by_their_distances():
    r = np.random.default_rng(0)
    v = r.standard_normal((4000, 8))
    v[7], v[9] = v[2500] + 1e-15, v[1300]
    slabs = graphs._Slabs(8)
    slabs.add(v)
    q, by_key = r.standard_normal((6, 8)), r.permutation(4000)
    d = graphs._distances(slabs, slabs, q, None, 4000)
    orders, unclear = graphs._rough_orders(slabs, q, by_key)
    assert unclear == 0
    for own, order in zip(d, orders, strict=True):
        assert (order == np.argsort(own[by_key], kind="stable")).all()


def test_f11_none(spark):
    some, none = (spark.createDataFrame(x, "k long, v array<float>, y int") for x in (rows(1, 3), []))
    assert graphs.knn_shapley(some, none, "k", "v", "y").collect() == [] == graphs.knn_shapley(none, some, "k", "v", "y").collect()
