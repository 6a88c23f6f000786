"""Radius linkage and density clusters against all pairs, in cells of many points, with ties, copies, nulls and empty tables."""

import math
import random

import pytest

from plumbline.operators import joins

SCHEMA = "k bigint, x double, y double"


def linked(points, near):
    """Least key of each point's group."""
    at = {k: k for k in points}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in points:
        for b in points:
            if a < b and near(points[a], points[b]):
                p, q = sorted((root(a), root(b)))
                at[q] = p
    return {k: root(k) for k in points}


def plain_clusters(rows, radius, least):
    known = {k: (x, y) for k, x, y in rows if None not in (x, y) and math.isfinite(x) and math.isfinite(y)}
    square = lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])
    near = lambda a, b: square(a, b) <= radius * radius
    core = {k: p for k, p in known.items() if sum(near(p, q) for q in known.values()) >= least}
    of = linked(core, near)
    out = {k: (None, False) for k, *_ in rows} | {k: (of[k], True) for k in core}
    for k, p in known.items():
        if k not in core and (best := min(((square(p, q), of[j]) for j, q in core.items() if near(p, q)), default=None)):
            out[k] = (best[1], False)
    return out


def rows(seed, n=160):
    r = random.Random(seed)
    out = [(i, *(r.gauss(c, 0.6) for c in r.choice([(0, 0), (4, 1), (4.5, -2)]))) for i in range(n)] + [(n + i, r.uniform(-6, 10), r.uniform(-6, 6)) for i in range(40)]
    out += [(500 + i, float(i // 4), 20.0) for i in range(24)]  # copies at whole distances, which are ties with a radius of 1
    return out + [(900, None, 1.0), (901, 1.0, float("nan")), (902, float("inf"), 0.0)]


@pytest.mark.parametrize(("radius", "least", "few"), [(0.5, 4, 10**6), (1.0, 6, 0), (1.0, 1, 10**6), (3.0, 20, 300)])
def test_density_clusters_equal_all_pairs(spark, monkeypatch, radius, least, few):
    monkeypatch.setattr(joins, "FEW_PAIRS", few)  # with few, boxes are cut again and again
    monkeypatch.setattr(joins, "PAIRS", 0)
    data = rows(least)
    got = joins.density_clusters(spark.createDataFrame(data, SCHEMA).repartition(3), "k", ["x", "y"], radius, least).collect()
    assert {r.k: (r.cluster, r.core) for r in got} == plain_clusters(data, radius, least) and len(got) == len(data)


@pytest.mark.parametrize(("radius", "few"), [(0.3, 10**6), (1.0, 0), (4.0, 10**6)])
def test_radius_groups_equal_all_pairs(spark, monkeypatch, radius, few):
    monkeypatch.setattr(joins, "FEW_PAIRS", few)
    monkeypatch.setattr(joins, "PAIRS", 0)
    data = rows(9)
    got = {r.k: r.group for r in joins.radius_groups(spark.createDataFrame(data, SCHEMA), "k", ["x", "y"], radius).collect()}
    known = {k: (x, y) for k, x, y in data if k < 900}
    assert got == linked(known, lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= radius * radius)


def test_full_cells_that_nearly_meet(spark):
    """Thousands of points in two cells: boxes settle it without comparing each with each."""
    r = random.Random(1)
    for gap, groups in ((1.0001, 2), (0.9999, 1)):
        left = [(i, -r.random() * 0.01, r.random() * 0.01) for i in range(3000)] + [(3000, 0.0, 0.005)]
        right = [(4000 + i, gap + r.random() * 0.01, r.random() * 0.01) for i in range(3000)] + [(7001, gap, 0.005)]
        got = joins.radius_groups(spark.createDataFrame(left + right, SCHEMA), "k", ["x", "y"], 1.0)
        assert got.select("group").distinct().count() == groups


def test_no_rows_no_clusters(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert joins.density_clusters(none, "k", ["x", "y"], 1.0, 2).collect() == joins.radius_groups(none, "k", ["x", "y"], 1.0).collect() == []
