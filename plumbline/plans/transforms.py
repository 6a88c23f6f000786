"""Queries over target transforms with their inverses, and over rank rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import frames as P
from ..operators import transforms as T
from .frames import _SCORES, scores
from .registry import query

K = ["l_orderkey", "l_linenumber"]
_SHARES = "SELECT l_orderkey, l_linenumber, l_quantity, (count(*) OVER (ORDER BY l_quantity) - 0.5) / count(*) OVER () AS uy, (count(*) OVER (ORDER BY l_discount) - 0.5) / count(*) OVER () AS ub FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, uy - ub AS residual, l_quantity AS back FROM ({_SHARES})", "residual back")
def share_residual(read):
    rows = read("lineitem")
    of_y, of_base = T.fit_ecdf(rows, "l_quantity"), T.fit_ecdf(rows, "l_discount")
    t = rows.withColumn("residual", T.share_forward(F.col("l_quantity"), F.col("l_discount"), of_y, of_base))
    return t.select(*K, "residual", T.share_inverse(F.col("residual"), F.col("l_discount"), of_y, of_base).alias("back"))


@query(
    f"""WITH u AS ({_SHARES}), k AS (SELECT DISTINCT l_quantity AS x, uy AS u FROM u), e AS (SELECT 1 / (2.0 * count(*)) AS eps FROM k),
        j AS (SELECT x, u, lag(x) OVER (ORDER BY x) AS px, lag(u) OVER (ORDER BY x) AS pu FROM k), c AS (SELECT l_orderkey, l_linenumber, least(greatest(uy, eps), 1 - eps) AS v FROM u, e)
        SELECT l_orderkey, l_linenumber, CASE WHEN pu IS NULL THEN x ELSE px + (v - pu) / (u - pu) * (x - px) END AS back FROM c JOIN j ON v <= u AND (pu IS NULL OR v > pu)""",
    "back",
    4,
)
def copula_inverse(read):
    rows = read("lineitem")
    c = T.fit_copula(rows, "l_quantity", "l_discount")
    return rows.withColumn("t", c.forward(F.col("l_quantity"), F.col("l_discount"))).select(*K, c.inverse(F.col("t"), F.col("l_discount")).alias("back"))


@query()
def copula_residual(read):
    rows = read("lineitem")
    return rows.select(*K, T.fit_copula(rows, "l_quantity", "l_discount").forward(F.col("l_quantity"), F.col("l_discount")).alias("residual"))


@query(
    """WITH r AS (SELECT o_orderkey, o_totalprice AS y, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), c AS (SELECT * FROM r WHERE b IS NOT NULL),
       f AS (SELECT regr_slope(y, b) AS s, regr_intercept(y, b) AS i, count(*) AS n FROM c), e AS (SELECT y, b, y - s * b - i AS d FROM c, f), m AS (SELECT median(d) AS med FROM e),
       g AS (SELECT 1.4826 * median(abs(d - med)) AS sigma FROM e, m), k AS (SELECT y, b FROM e, m, g WHERE abs(d - med) <= 3 * sigma), q AS (SELECT regr_slope(y, b) AS s2, count(*) AS kept FROM k),
       a AS (SELECT least(1, greatest(0, (n * (CASE WHEN kept = n OR kept < n / 2 THEN s ELSE s2 END) + 10) / (n + 20))) AS a FROM f, q)
       SELECT o_orderkey, y - a * b AS residual, CASE WHEN b IS NOT NULL THEN y END AS back FROM r, a""",
    "residual back",
    4,
)
def causal_residual(read):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read("orders").withColumn("anchor", F.lag("o_totalprice").over(w))
    share = T.fit_anchor(rows, "o_totalprice", "anchor")
    t = rows.withColumn("residual", T.anchor_forward(F.col("o_totalprice"), F.col("anchor"), share))
    return t.select("o_orderkey", "residual", T.anchor_inverse(F.col("residual"), F.col("anchor"), share).alias("back"))


@query()
def robust_plane_residual(read):
    rows, bases = read("lineitem"), ["l_quantity", "l_discount"]
    return rows.select(*K, T.plane_forward(F.col("l_extendedprice"), bases, T.fit_robust_plane(rows, "l_extendedprice", bases)).alias("residual"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS back FROM lineitem", "back", 4)
def robust_plane_inverse(read):
    rows, bases = read("lineitem"), ["l_quantity", "l_discount"]
    beta = T.fit_robust_plane(rows, "l_extendedprice", bases)
    return rows.withColumn("t", T.plane_forward(F.col("l_extendedprice"), bases, beta)).select(*K, T.plane_inverse(F.col("t"), bases, beta).alias("back"))


def _volatile(read):
    rows, order = read("orders").withColumn("base", F.col("o_totalprice") / 2), ["o_orderdate", "o_orderkey"]
    fit = T.fit_volatility(rows, "o_custkey", order, "base", "o_orderkey")
    return T.with_volatility(rows, "o_custkey", order, "base", "o_orderkey", fit).withColumn("scaled", T.volatility_forward(F.col("o_totalprice")))


@query()
def volatility_residual(read):
    return _volatile(read).select("o_orderkey", "scaled")


@query("SELECT o_orderkey, o_totalprice AS back FROM orders", "back", 4)
def volatility_inverse(read):
    return _volatile(read).select("o_orderkey", T.volatility_inverse(F.col("scaled")).alias("back"))


@query(
    """WITH g AS (SELECT avg(o_totalprice) AS g FROM orders WHERE o_orderdate < '1999-01-01'), m AS (SELECT o_custkey, (sum(o_totalprice) + 20 * any_value(g)) / (count(*) + 20) AS m FROM orders, g WHERE o_orderdate < '1999-01-01' GROUP BY 1)
       SELECT o_orderkey, o_totalprice - coalesce(m, g) AS residual, o_totalprice AS back FROM orders LEFT JOIN m USING (o_custkey), g""",
    "residual back",
    4,
)
def group_mean_residual(read):
    rows = read("orders")
    fit = T.fit_group_means(rows.where("o_orderdate < '1999-01-01'"), "o_custkey", "o_totalprice")
    t = T.with_group_mean(rows, "o_custkey", fit).withColumn("residual", F.col("o_totalprice") - F.col("group_mean"))
    return t.select("o_orderkey", "residual", (F.col("residual") + F.col("group_mean")).alias("back"))


_DUELS = f"s AS {_SCORES}, d AS (SELECT a.model, b.model AS other, CAST(sum((a.score > b.score)::INT) AS BIGINT) AS won, CAST(sum((a.score < b.score)::INT) AS BIGINT) AS lost FROM s a JOIN s b ON a.task = b.task AND a.model <> b.model GROUP BY 1, 2)"


@query(f'WITH {_DUELS} SELECT model, count(*) FILTER (won > lost) AS lower, -(count(*) FILTER (won < lost)) AS upper, count(*) FILTER (won > lost) - count(*) FILTER (won < lost) AS difference, count(*) FILTER (won > lost) + count(*) FILTER (won = lost) / 2 AS lower_with_ties FROM d GROUP BY 1', "lower_with_ties")
def copeland_slices(read):
    return P.copeland(scores(read))


@query(f"WITH {_DUELS} SELECT model, -max(CASE WHEN lost > won THEN lost ELSE 0 END) AS winning_votes, -max(lost - won) AS margins, -max(lost) AS pairwise_opposition FROM d GROUP BY 1")
def minimax_scores(read):
    return P.minimax(scores(read))


@query(
    f"""WITH s AS (SELECT task, model, CASE WHEN (task + length(model)) % 3 <> 0 THEN score END AS score FROM {_SCORES}), m AS (SELECT task, median(score) AS m FROM s GROUP BY 1 HAVING count(score) > 0)
        SELECT model, avg(coalesce(score, m)) AS mean, avg(least(coalesce(score, m), 4e6) - 4e6) AS optimality_gap FROM s JOIN m USING (task) GROUP BY 1""",
    "mean optimality_gap",
    3,
)
def partial_tables(read):
    s = scores(read).withColumn("score", F.when((F.col("task") + F.length("model")) % 3 != 0, F.col("score")))
    whole = P.median_filled(s)
    return whole.groupBy("model").agg(F.avg("score").alias("mean")).join(P.optimality_gap(whole, 4e6), "model")


@query()
def threshold_rule(read):
    return P.threshold_winners(scores(read))


@query()
def geometric_median(read):
    at = A.geometric_median(read("lineitem"), ["l_quantity", "l_discount"])
    return read("lineitem").sparkSession.createDataFrame([at], "l_quantity double, l_discount double")


@query()
def zero_sums_of_two_groupings(read):
    return A.zero_sums(read("orders"), ["o_orderpriority", "o_custkey"], "o_totalprice").select("o_orderkey", "o_totalprice_adjusted")
