"""Steps that once held a whole column, group or table in one task, or failed on larger ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates as A
from plumbline.operators import encodings as C
from plumbline.operators import frames as P
from plumbline.operators import joins as J
from plumbline.operators import metrics as M
from plumbline.operators import online as O
from plumbline.operators import resampling as R
from plumbline.operators import transforms as T
from plumbline.operators import windows as W


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_whole_percentile(monkeypatch):
    def refuse(*_):
        raise AssertionError("a percentile whose values meet in one task")

    monkeypatch.setattr(F, "percentile", refuse)
    monkeypatch.setattr(F, "median", refuse)


def lines(spark, n=400):
    return spark.range(n).select((F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 37 % 101 * 2.0 + F.when(F.col("id") % 50 == 0, 500.0).otherwise(F.col("id") % 3)).alias("y"))


def test_f4_f7_volatility_is_a_stream_of_rows(spark):
    df = spark.createDataFrame([(e, i, None if i == 3 else float((i * 7 + e) % 11)) for e in range(3) for i in range(9)], "e int, i int, b double").withColumn("k", F.col("e") * 100 + F.col("i"))
    traces = T.volatility_traces(df, "e", ["i"], "b", "k", 3, 5.0, 2.0)
    assert "InPandas" not in plan_of(traces)
    got = traces.orderBy("k").toPandas()
    for e in range(3):
        b = got[got.e == e].b
        level = pd.concat([pd.Series([5.0]), b.dropna()]).ewm(alpha=0.5, adjust=False).mean().iloc[1:].reindex(b.index).ffill()
        away = pd.concat([pd.Series([2.0]), (b - level).abs().dropna()]).ewm(alpha=0.5, adjust=False).mean().iloc[1:].reindex(b.index).ffill()
        np.testing.assert_allclose(got[got.e == e].level, level)
        np.testing.assert_allclose(got[got.e == e].volatility, away)


def test_f8_f9_robust_plane(spark, no_whole_percentile):
    beta = T.fit_robust_plane(lines(spark), "y", ["x"])
    assert abs(beta[0] - 2) < 0.01


def test_f12_bounds(spark, no_whole_percentile):
    df = lines(spark)
    q1, q3 = np.percentile(df.toPandas().x, [25, 75])
    assert C.fit_bounds(df, "x", "iqr") == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    v = df.toPandas().x
    d = 3 * 1.4826 * (v - v.median()).abs().median()
    assert C.fit_bounds(df, "x", "mad") == pytest.approx((v.median() - d, v.median() + d))


def test_f14_anchor(spark, no_whole_percentile):
    df = lines(spark).withColumn("x", F.col("x") * 4)
    assert T.fit_anchor(df, "y", "x") == pytest.approx((400 * 0.5 + 20 * 0.5) / 420, abs=0.01)


def test_f6_xi_of_many_rows(spark):
    """Sums of products of ranks pass 64 bits: ascending pairs have xi 1 - 3 n / (n * n - 1) / ... near 1."""
    n = 4_000_000
    df = spark.range(n).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert A.xi_correlation(df, "x", "y", "id").first()[0] == pytest.approx(1 - 3 / (n + 1), abs=1e-9)


def test_f3_median_on_a_point_and_between(spark):
    corner = [(0.0, 0.0)] * 3 + [(1.0, 0.0), (0.0, 1.0), (-1.0, -1.0)]
    assert A.geometric_median(spark.createDataFrame(corner, "a double, b double"), ["a", "b"]) == (0.0, 0.0)
    start = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (-4.0, -4.0), (3.0, 3.0), (1.0, 2.0), (-4.0, -5.0)]  # their mean is a point
    at = A.geometric_median(spark.createDataFrame(start, "a double, b double"), ["a", "b"])
    total = lambda p: sum(np.hypot(a - p[0], b - p[1]) for a, b in start)
    assert all(total(at) <= total((at[0] + s, at[1] + t)) + 1e-12 for s in (-1e-3, 0, 1e-3) for t in (-1e-3, 0, 1e-3))
    skewed = spark.range(6000).select((F.col("id") % 50 + 1).cast("double").alias("a"), (F.col("id") % 11 / 100).alias("b"), "id").where("id % 7 != 3")
    A.geometric_median(skewed, ["a", "b"])
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "a double, b double")
    assert A.geometric_median(line, ["a", "b"]) == pytest.approx((4.0, 8.0), abs=1e-6)


@pytest.mark.parametrize("keys", [["g"], []])
def test_f19_auc_by_ranges(spark, keys, monkeypatch):
    monkeypatch.setattr(A, "parts_of", lambda df: 9)
    rng = np.random.default_rng(3)
    data = [(None if i % 3 == 0 else i % 3, int(rng.random() < 0.4), None if i % 40 == 0 else float(rng.integers(0, 60))) for i in range(900)]
    got = M.auc(spark.createDataFrame(data, "g int, y int, s double"), "y", "s", keys)
    assert "_part" in plan_of(got)
    for r in got.collect():
        own = [(-1.0 if s is None else s, y) for g, y, s in data if not keys or g == r["g"]]
        a, b = (np.array([s for s, y in own if y == c]) for c in (1, 0))
        assert r["roc_auc"] == pytest.approx(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / len(a) / len(b))
        ap = sum((a == s).sum() * (a >= s).sum() / ((a >= s).sum() + (b >= s).sum()) for s in set(a)) / len(a)
        assert r["pr_auc"] == pytest.approx(ap)


def test_f15_f16_f17_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_ROWS", 50)
    monkeypatch.setattr(R, "TASK_ROWS", 50)
    df = spark.range(1000).select("id", (F.col("id") % 90).alias("k"), (F.col("id") * 7 % 31).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    for out in (W.group_rank(df, "k", "x", ["id"]), M.correlations(df, "x", "y", ["k"]), R.permutation_null(df, ["x"], "y", "id", "k", 3)[1]):
        assert ", 20), REPARTITION_BY_NUM" in plan_of(out)


def test_f10_ties_of_two_features():
    mean, _ = O.predict(np.array([[1.0, 0.5]]), np.array([[[3.0, 1.5], [1.5, 2.25]]]), np.array([[7.0, 3.1]]), 1.0)
    a, b, d, u, v, x = 3.0, 1.5, 2.25, 7.0, 3.1, 0.5
    assert mean[0] == ((d * u - b * v) + x * (a * v - b * u)) / (a * d - b * b)


def test_f2_groups_on_a_line_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(J, "connected", None)
    monkeypatch.setattr(A, "parts_of", lambda df: 7)
    rng = np.random.default_rng(5)
    for width, n in ((40.0, 300), (3.0, 200), (4000.0, 100)):
        v = [float(np.round(x, 2)) for x in rng.random(n) * width] + [float("nan"), float("inf")]
        got = {r[0]: r[1] for r in J.radius_groups(spark.createDataFrame(list(enumerate(v)) + [(9999, None)], "k int, x double"), "k", ["x"], 0.25).collect()}
        want, group, last = {}, None, None
        for x, k in sorted((x, k) for k, x in enumerate(v) if abs(x) < float("inf")):
            group = [] if last is None or x - last > 0.25 else group
            group.append(k)
            want[k], last = group, x
        assert got == {k: min(g) for k, g in want.items()}


def test_f13_offsets_are_solved_for(spark):
    """Groupings that barely mix took sweeps without number; nulls are a group, null values count nowhere."""
    rows = [(i % 2 if i else 1, i // 2 % 50 if i % 9 else None, float(i * i % 17) if i % 11 else None) for i in range(400)] + [(2, 777, 5.0), (2, 778, None)]
    df = spark.createDataFrame(rows, "a int, b int, p double")
    got = A.zero_sums(df, ["a", "b"], "p", rounds=0).cache()
    for k in ("a", "b"):
        assert got.groupBy(k).agg(F.sum("p_adjusted").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-5
    frame = got.where("p is not null").toPandas()
    shift = (frame.p - frame.p_adjusted).to_numpy()
    one = pd.get_dummies(frame[["a", "b"]].astype(str), columns=["a", "b"]).to_numpy(float)
    np.testing.assert_allclose(shift, one @ np.linalg.lstsq(one, frame.p.to_numpy(), rcond=None)[0], atol=1e-6)


def test_f18_copula_is_fitted_on_distinct_pairs(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("y"))
    c = T.fit_copula(df, "y", "b")
    inside = lambda of, v: P.normal_score(F.least(F.greatest(of.share(F.col(v)), F.lit(0.5 / len(of.knots))), F.lit(1 - 0.5 / len(of.knots)))).alias(v)
    z = df.select(inside(c.of_y, "y"), inside(c.of_base, "b"))
    want = z.agg(F.regr_slope("y", "b"), F.regr_intercept("y", "b")).first()
    assert (c.slope, c.intercept) == pytest.approx(tuple(want), abs=1e-9)
    assert plan_of(df.select(c.of_y.score(F.col("y")))).count("CASE WHEN") == 0


def test_f5_guessed_sizes_do_not_multiply_in_loops(spark):
    """A chain's rounds multiplied the guessed size of labels until planning took the driver's memory."""
    nodes = spark.range(3000)
    got = J.connected(nodes.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), nodes, "id")
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert got.where("group = 0").count() == 3000
