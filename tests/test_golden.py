"""Hand-computed values and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import aggregates as A
from plumbline.operators import asof, encodings, frames, graphs, joins, metrics, windows


def test_strict_aggregate(spark):
    h = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 20.0), ("a", 9, 30.0), ("b", 2, 100.0), ("b", 8, 200.0)], "e string, t int, x double")
    q = spark.createDataFrame([("a", 6), ("b", 9), ("a", 1), ("c", 5)], "e string, t int")
    got = {(r.e, r.t): (r.x_mean, r.x_count) for r in asof.strict_aggregate(h, q, "e", "t", "x").collect()}
    assert got == {("a", 6): (15.0, 2), ("b", 9): (150.0, 2), ("a", 1): (None, None), ("c", 5): (None, None)}


def test_future_rows_change_nothing(spark):
    h = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 20.0)], "e string, t int, x double")
    q = spark.createDataFrame([("a", 6)], "e string, t int")
    more = h.unionByName(spark.createDataFrame([("a", 6, 1e9), ("a", 99, 1e9)], "e string, t int, x double"))
    assert asof.strict_aggregate(h, q, "e", "t", "x").collect() == asof.strict_aggregate(more, q, "e", "t", "x").collect()


def test_asof_matches_the_row(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (None, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 7.0), (1, 5, None), (None, 1, 9.0)], "k int, t int, v double")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {(1, 5): None, (1, 0): None, (None, 5): None}


def test_ordered_target_encoding(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 0)], "c string, i int, y int")
    got = [r.te for r in encodings.ordered_target_encode(df, "c", ["i"], "y", 0.5).orderBy("i").collect()]
    assert got == pytest.approx([0.5, 0.75, 2.5 / 3])


def test_causal_rank(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.0), (2, 0, 3.0)], "g int, i int, v double")
    assert [r.causal_rank for r in windows.causal_rank(df, "g", ["i"], "v").orderBy("g", "i").collect()] == [1.0, 0.75, 1.0]
    first = windows.causal_rank(df, "g", ["i"], "v", exclude_self=True).orderBy("g", "i").first()
    assert first.causal_rank is None


def test_ndcg_and_map(spark):
    df = spark.createDataFrame([(1, 0.1, 2, 0), (1, 0.9, 1, 1)], "q int, s double, r int, k int")
    assert metrics.ranking_scores(df, "q", "s", "r", "k", 10).first().ndcg == pytest.approx(0.79671, abs=1e-5)
    df = spark.createDataFrame([(1, 4 - i, v, i) for i, v in enumerate([1, 0, 1, 1])], "q int, s int, r int, k int")
    assert metrics.ranking_scores(df, "q", "s", "r", "k", 10).first().map == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    with pytest.raises(ValueError):
        metrics.ranking_scores(df, "q", "s", "r", "k", 0)


def test_ewma_and_states(spark):
    df = spark.createDataFrame([(i, g, float(v)) for i, (g, v) in enumerate([(0, 1), (0, 0), (0, 1), (1, 5)])], "i int, g int, v double")
    got = [r[1] for r in windows.ewma(df, "g", ["i"], "v", (0.5,), "i").orderBy("i").collect()]
    assert got == [1.0, 0.5, 0.75, 5.0]
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate("0001122223")], "g int, i int, s string")
    last = windows.state_history(s, "g", ["i"], "s").orderBy("i").collect()[-1]
    assert (last.state_1, last.length_1, last.state_2, last.length_2) == ("2", 4, "1", 2)


def test_change_points_of_a_step(spark):
    df = spark.createDataFrame([(0, i, 0.0 if i < 20 else 10.0) for i in range(40)], "g int, i int, v double")
    assert [r.at for r in windows.change_points(df, "g", ["i"], "v", 5.0).collect()] == [20]


def test_drift_of_equal_frames(spark):
    df = spark.range(100).select((F.col("id") % 13).cast("double").alias("v"))
    d = metrics.distribution_drift(df, df, "v").first()
    assert d.psi == d.kl == d.js == 0
    assert metrics.wasserstein(df, df, "v").first().wasserstein == 0
    assert A.two_sample_ks(df, df, "v").first().ks == 0


def test_graph_triangle_and_star(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (10, 12)], "src int, dst int")
    got = {r.node: (r.degree, r.triangles, r.clustering) for r in graphs.structure(e).collect()}
    assert got[1] == (2, 1, 1.0) and got[10] == (2, 0, 0.0)


def test_expressions(spark):
    one = spark.range(1).select(F.lit(12).alias("a"), F.lit(18).alias("b"), F.lit(None).cast("double").alias("n"))
    assert one.select(S.gcd(F.col("a"), F.col("b")).alias("g")).first().g == 6
    assert one.select(*(c.alias(n) for n, c in S.row_stats(["n"]).items())).first().mean is None
    z = one.select(frames.normal_score(F.lit(0.975)).alias("z")).first().z
    assert z == pytest.approx(1.959964, abs=1e-5)
    sims = S.set_similarities(F.array().cast("array<int>"), F.array().cast("array<int>"))
    assert set(one.select(*(c.alias(n) for n, c in sims.items())).first()) == {1.0}
    p = one.select(S.sticky_floor(F.array(F.lit(0.1), F.lit(0.6), F.lit(0.3)), F.lit(0), 0.4).alias("p")).first().p
    assert sum(p) == pytest.approx(1) and p[0] == 0.4


def test_sibling_fill_and_groups(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 0), (1, 1, None, 1), (2, 0, None, 2)], "g int, t int, v double, k int")
    assert [r.filled for r in joins.sibling_fill(df, "g", "t", "v", "k").orderBy("k").collect()] == [5.0, 5.0, 5.0]
    names = spark.createDataFrame([("abcd",), ("abce",), ("abff",), ("xbcd",)], "n string")
    assert {r.n: r.group for r in joins.fuzzy_groups(names, "n", 2, 1).collect()} == {"abcd": "abcd", "abce": "abcd", "abff": "abff", "xbcd": "xbcd"}


def test_pacf_of_a_first_order_process():
    import numpy as np

    p = windows.partial_autocorrelation(np.array([0.5, 0.25, 0.125]))
    assert p[0] == pytest.approx(0.5) and abs(p[1]) < 1e-12 and abs(p[2]) < 1e-12


def test_shapley_values_sum_to_the_gain(spark):
    tr = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(6)], "k int, v array<double>, y int")
    te = spark.createDataFrame([(100, [0.2], 0)], "k int, v array<double>, y int")
    total = sum(r.value for r in graphs.knn_shapley(tr, te, "k", "v", "y", k=1).collect())
    assert math.isclose(total, 1.0)
