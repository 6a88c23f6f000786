"""Target transforms, rank rules and linkage against plain Python, nulls included."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import aggregates as A
from plumbline.operators import frames as P
from plumbline.operators import joins, metrics
from plumbline.operators import transforms as T


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    got = [(i, f"e{i % 3}", float(r.randint(1, 12)), r.gauss(3, 1), r.gauss(0, 2)) for i in range(240)]
    got = [(i, e, y, None if i % 17 == 5 else round(b, 3), round(c, 3)) for i, e, y, b, c in got]
    got = [(i, e, None if i % 29 == 7 else y + (b or 0) * 2 + (500 if i % 40 == 3 else 0), b, c) for i, e, y, b, c in got]
    return got, spark.createDataFrame(got, "i int, e string, y double, b double, c double").repartition(4)


def shares(values):
    known = sorted(v for v in values if v is not None)
    return sorted({v: (k + 0.5) / len(known) for k, v in enumerate(known)}.items())


def test_ecdf_and_copula(spark, rows):
    data, df = rows
    ky, kb = shares(r[2] for r in data), shares(r[3] for r in data)
    fit = T.fit_ecdf(df, "y")
    assert fit.knots == tuple(k for k, _ in ky) and fit.shares == pytest.approx([s for _, s in ky])
    of_base = T.fit_ecdf(df, "b")
    t = df.withColumn("t", T.share_forward(F.col("y"), F.col("b"), fit, of_base)).withColumn("back", T.share_inverse(F.col("t"), F.col("b"), fit, of_base))
    uy, ub = dict(ky), dict(kb)
    for r in t.collect():
        known = r.y is not None and r.b is not None
        assert (r.t is None) == (not known) and (not known or (r.t == pytest.approx(uy[r.y] - ub[r.b]) and r.back == pytest.approx(r.y)))
    c = T.fit_copula(df, "y", "b")
    score = lambda u, n: NormalDist().inv_cdf(min(max(u, 1 / (2 * n)), 1 - 1 / (2 * n)))
    z = {r[0]: (score(uy[r[2]], len(ky)), score(ub[r[3]], len(kb))) for r in data if r[2] is not None and r[3] is not None}
    slope, intercept = np.polyfit([b for _, b in z.values()], [y for y, _ in z.values()], 1)
    assert (c.slope, c.intercept) == pytest.approx((slope, intercept), abs=1e-6)
    for r in df.withColumn("t", c.forward(F.col("y"), F.col("b"))).withColumn("back", c.inverse(F.col("t"), F.col("b"))).collect():
        if r.i in z:
            assert r.t == pytest.approx(z[r.i][0] - slope * z[r.i][1] - intercept, abs=1e-6)
            assert abs(r.back - r.y) < 1e-4 or not 1 / (2 * len(ky)) <= uy[r.y] <= 1 - 1 / (2 * len(ky))
        else:
            assert r.t is None and r.back is None
    few = T.fit_ecdf(df, "c", most=20)
    assert len(few.knots) <= 20 and list(few.knots) == sorted(few.knots)
    assert T.fit_ecdf(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").knots == (1.0, 2.0)


def test_robust_plane_and_anchor(rows):
    data, df = rows
    full = [(r[2], r[3], r[4]) for r in data if None not in r[2:5]]
    y, x = np.array([r[0] for r in full]), np.array([[*r[1:], 1.0] for r in full])
    first = np.linalg.lstsq(x, y, rcond=None)[0]
    d = y - x @ first
    inner = abs(d - np.median(d)) <= 3 * 1.4826 * np.median(abs(d - np.median(d)))
    assert 0 < (~inner).sum() < len(y) / 2
    beta = T.fit_robust_plane(df, "y", ["b", "c"])
    assert beta == pytest.approx(np.linalg.lstsq(x[inner], y[inner], rcond=None)[0], abs=1e-8)
    assert T.fit_plane(df, "y", ["b", "c"]) == pytest.approx(first, abs=1e-8)
    back = df.withColumn("t", T.plane_forward(F.col("y"), ["b", "c"], beta)).withColumn("back", T.plane_inverse(F.col("t"), ["b", "c"], beta)).collect()
    assert all(r.back == pytest.approx(r.y) for r in back if None not in (r.y, r.b, r.c))
    share = T.fit_anchor(df, "y", "b")
    assert 0 <= share <= 1 and T.fit_anchor(df.where("i < 3"), "y", "b") == 0.5


def test_volatility_and_group_means(rows):
    data, df = rows
    fit = T.fit_volatility(df, "e", ["i"], "b", "i", span=3)
    known = [r[3] for r in data if r[3] is not None]
    assert fit.level == pytest.approx(np.mean(known))

    def traces(start, vol):
        out = {}
        for e in {r[1] for r in data}:
            at, v = start, vol
            for i, b in sorted((r[0], r[3]) for r in data if r[1] == e):
                if b is not None:
                    at = 0.5 * b + 0.5 * at
                    v = 0.5 * abs(b - at) + 0.5 * v
                out[i] = at, v
        return out

    away = np.mean([abs(r[3] - traces(fit.level, 0.0)[r[0]][0]) for r in data if r[3] is not None])
    want = traces(fit.level, away)
    assert fit.volatility == pytest.approx(away) and fit.floor == pytest.approx(1e-3 * np.median([v for _, v in want.values()]))
    t = T.with_volatility(df, "e", ["i"], "b", "i", fit).withColumn("t", T.volatility_forward(F.col("y"))).withColumn("back", T.volatility_inverse(F.col("t")))
    for r in t.collect():
        assert (r.level, r.volatility) == pytest.approx((want[r.i][0], max(fit.floor, want[r.i][1])))
        assert r.y is None or r.back == pytest.approx(r.y)
    means = T.fit_group_means(df.where("e != 'e2'"), "e", "y", 10.0)
    use = [r[2] for r in data if r[1] != "e2" and r[2] is not None]
    own = [r[2] for r in data if r[1] == "e0" and r[2] is not None]
    got = {r.e: r.group_mean for r in T.with_group_mean(df, "e", means).collect()}
    assert got["e2"] == pytest.approx(np.mean(use)) and got["e0"] == pytest.approx((sum(own) + 10 * np.mean(use)) / (len(own) + 10))


def test_rank_rules(spark):
    table = {"a": [5, 1, 3, None], "b": [4, 2, 3, 7], "c": [3, 3, 1, 9], "d": [1, 1, 2, 8]}
    s = spark.createDataFrame([(t, m, float(v)) for m, vs in table.items() for t, v in enumerate(vs) if v is not None], "task int, model string, score double")
    whole = {(r.task, r.model): r.score for r in P.median_filled(s).collect()}
    assert len(whole) == 16 and whole[3, "a"] == 8.0
    full = spark.createDataFrame([(t, m, v) for (t, m), v in whole.items()], "task int, model string, score double")
    won = {(m, o): sum(whole[t, m] > whole[t, o] for t in range(4)) for m in table for o in table if m != o}
    for r in P.copeland(full).collect():
        up = [won[r.model, o] - won[o, r.model] for o in table if o != r.model]
        wins, losses, ties = sum(x > 0 for x in up), sum(x < 0 for x in up), sum(x == 0 for x in up)
        assert (r.lower, r.upper, r.difference, r.lower_with_ties) == (wins, -losses, wins - losses, wins + ties / 2)
    for r in P.minimax(full).collect():
        lost = [(won[o, r.model], won[r.model, o]) for o in table if o != r.model]
        assert (r.winning_votes, r.margins, r.pairwise_opposition) == (-max(x if x > y else 0 for x, y in lost), -max(x - y for x, y in lost), -max(x for x, _ in lost))
    one = full.where("model = 'a'")
    assert P.copeland(one).first()[1:] == (0, 0, 0, 0.0) and P.minimax(one).first()[1:] == (0, 0, 0)
    left = set(table)
    for place in range(4, 1, -1):
        times = {m: sum(sum(whole[t, o] >= whole[t, m] for o in table) == place for t in range(4)) for m in left}
        left = {m for m in left if times[m] == min(times.values())}
    assert {r.model for r in P.threshold_winners(full).collect()} == left
    gaps = {r.model: r.optimality_gap for r in P.optimality_gap(full, 4.0).collect()}
    assert gaps["d"] == pytest.approx(np.mean([-3, -3, -2, 0]))


def test_zero_sums_and_geometric_median(spark, rows):
    data, df = rows
    out = A.zero_sums(df.withColumn("f", F.col("i") % 5), ["e", "f"], "c", rounds=30).collect()
    assert len(out) == len(data)
    for key in ("e", "f"):
        for k in {r[key] for r in out}:
            assert abs(sum(r.c_adjusted for r in out if r[key] == k)) < 1e-6
    order = lambda rs, f: [x for _, x in sorted((f(r), r.i) for r in rs)]
    one = [r for r in out if r.e == "e0" and r.f == 1]
    assert order(one, lambda r: r.c) == order(one, lambda r: r.c_adjusted)
    at = A.geometric_median(df, ["b", "c"])
    far = lambda p: sum(math.dist(p, (r[3], r[4])) for r in data if None not in (r[3], r[4]))
    assert all(far(at) <= far((at[0] + x, at[1] + y)) + 1e-6 for x, y in itertools.product((-0.01, 0, 0.01), repeat=2))


def test_radius_groups_equal_all_pairs(spark):
    r = random.Random(3)
    pts = [(i, r.uniform(0, 12), r.uniform(0, 12)) for i in range(260)] + [(900, 1.0, None), (901, 3.0, 3.0), (902, 3.0, 3.0)]
    got = {x.k: x.group for x in joins.radius_groups(spark.createDataFrame(pts, "k int, x double, y double").repartition(4), "k", ["x", "y"], 0.6).collect()}
    up = {i: i for i, _, y in pts if y is not None}

    def top(i):
        return i if up[i] == i else top(up[i])

    known = [p for p in pts if p[2] is not None]
    for a, b in itertools.combinations(known, 2):
        if math.dist(a[1:], b[1:]) <= 0.6:
            x, y = sorted((top(a[0]), top(b[0])))
            up[y] = x
    assert got == {i: top(i) for i in up} and 5 < len(set(got.values())) < 200


def test_connected_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 4)], "a int, b int")
    got = {r.k: r.group for r in joins.connected(e, spark.createDataFrame([(i,) for i in [*range(n + 1), 1000, 2000]], "k int"), "k").collect()}
    assert got == dict.fromkeys(range(n + 1), 0) | {1000: 1000, 2000: 2000}


def test_nulls_in_ranks_and_information(spark):
    v = [3.0, None, 1.0, 3.0, None, 2.0]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    got = {r.i: r.u for r in P.rank_ecdf(df, "v").collect()}
    assert got == {0: 3.5 / 4, 1: None, 2: 0.5 / 4, 3: 3.5 / 4, 4: None, 5: 1.5 / 4}
    codes = spark.createDataFrame([("a", "b|c", 0), ("a|b", "c", 1)] * 5, "x string, z string, y int")
    assert A.joint_mutual_information(codes, "x", "z", "y").first()[0] == pytest.approx(math.log(2))
    nulls = spark.createDataFrame([("a", None, 0), (None, "a", 1)] * 5, "x string, z string, y int")
    assert A.joint_mutual_information(nulls, "x", "z", "y").first()[0] == pytest.approx(math.log(2))
    part = spark.createDataFrame([(0, 0), (1, 1), (None, 1), (0, None), (None, None)] * 4, "x int, y int")
    assert A.mutual_information(part, "x", "y").first()[0] == pytest.approx(math.log(2))
    assert A.symmetric_uncertainty(part, "x", "y").first()[0] == pytest.approx(1.0)
    assert A.entropies(part, "x").first().plugin == pytest.approx(-(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3))
    z = part.withColumn("z", F.lit(1))
    assert A.conditional_mutual_information(z, "x", "y", "z").first()[0] == pytest.approx(math.log(2))
    xi = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(50)] + [(99, None, 1.0), (98, 1.0, None)], "k int, x double, y double")
    assert A.xi_correlation(xi, "x", "y", "k", parts=4).first()[0] == pytest.approx(1 - 3 * 49 / (50**2 - 1))


def test_row_stats_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (4.0, 2.0, 9.0)], "a double, b double, c double")
    got = df.select(*(c.alias(n) for n, c in S.row_stats(["a", "b", "c"]).items())).collect()
    assert tuple(got[0]) == (2.0, 1.0, 1.0, 3.0, 2.0, 1.5, 2.5) and set(got[1]) == {None}
    assert tuple(got[2]) == pytest.approx((5.0, np.std([4, 2, 9]), 2.0, 9.0, 4.0, 3.0, 6.5))
    assert spark.range(1).select(S.uncross(F.array(F.lit(3.0), F.lit(None), F.lit(1.0)))).first()[0] == [1.0, 3.0, None]


def test_required_n_and_bootstrap(spark):
    assert spark.range(1).select(metrics.required_n(F.lit(0.5), F.lit(0.05))).first()[0] == 385
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)] + [(5000, None)], "k int, v double")
    a, b = (A.bootstrap_mean(df.repartition(n), "v", "k").first() for n in (2, 7))
    assert a.mean == pytest.approx(4.5) and (a.low, a.high) == pytest.approx((b.low, b.high))
    assert a.low < 4.5 < a.high and a.high - a.low == pytest.approx(2 * 1.96 * math.sqrt(8.25 / 2000), rel=0.2)


def test_stream_ewma_equals_the_batch(spark):
    from plumbline.operators import windows
    from plumbline.streaming import windows as stream

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    last = {r.user_id: r for r in stream.run_batchwise(e, stream.running_ewma, "update", keys=["user_id"]).collect()}
    batch = windows.ewma(e, "user_id", ["ts", "event_id"], "value", (0.2,), "event_id").join(e, "event_id")
    ends = {r.user_id: r.v for r in batch.groupBy("user_id").agg(F.max_by("ewma_0_2", F.struct("ts", "event_id")).alias("v")).collect()}
    assert {u: r.ewma for u, r in last.items()} == pytest.approx(ends) and sum(r.n for r in last.values()) == e.count()


def test_ewma_goes_on_from_batch_to_batch(spark):
    from plumbline.operators import windows

    r = random.Random(1)
    rows = [(i, r.choice([None, "a", "a", "b", "c"]), None if i % 50 == 9 else r.random()) for i in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {x[0]: x[1:] for x in windows.ewma(spark.createDataFrame(rows, "i int, e string, v double").repartition(3), "e", ["i"], "v", (0.3, 0.05), "i").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {}
    for i, e, v in rows:
        at[e] = tuple(a * (v or 0) + (1 - a) * o for a, o in zip((0.3, 0.05), at[e])) if e in at else (v or 0, v or 0)
        assert got[i] == pytest.approx(at[e])
    assert len(got) == len(rows)
