"""Queries over blends, re-ordered rankings and further transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blends as B
from .metrics import R, priced
from .registry import query


def predictions(read):
    return priced(read).withColumn("q", F.col("b") * 0.5 + F.col("p") * 0.5).select("k", "l_suppkey", "y", "p", "b", "q")


@query()
def hill_climb_blend(read):
    rows = predictions(read)
    return rows.sparkSession.createDataFrame(sorted(B.hill_climb(rows, ["p", "b", "q"], "y").items()), "name string, weight double")


@query()
def simplex_blend(read):
    rows = predictions(read)
    return rows.sparkSession.createDataFrame(sorted(B.simplex_weights(rows, ["p", "b"], "y").items()), "name string, weight double")


@query(f"SELECT k, exp(0.7 * ln(p) + 0.3 * ln(b)) AS geometric, 0.7 * p + 0.3 * b AS linear, CASE WHEN p >= 40000 THEN p ELSE b END AS gated FROM {R}", "geometric linear gated", 4)
def fixed_blends(read):
    w = {"p": 0.7, "b": 0.3}
    return priced(read).select("k", B.geometric_blend(w).alias("geometric"), B.linear_blend(w).alias("linear"), B.gated_blend(F.col("b"), F.col("p"), F.col("p"), 40000.0).alias("gated"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
       SELECT o_orderkey, CAST(CASE WHEN r BETWEEN 2 AND 5 THEN row_number() OVER (PARTITION BY o_custkey, r BETWEEN 2 AND 5 ORDER BY o_orderdate DESC, o_orderkey) + 1 ELSE r END AS INTEGER) AS place FROM r"""
)
def rank_splice(read):
    return B.rank_splice(read("orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey", 2, 5).select("o_orderkey", "place")


@query("SELECT CAST(s AS INTEGER) AS size, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), (SELECT unnest([5, 20, 80]) AS s) WHERE r <= s")
def top_subsets(read):
    return B.top_subsets(read("orders"), "o_totalprice", "o_orderkey", (5, 20, 80))


@query("SELECT event_id, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS scaled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", "scaled")
def volatility_normalised(read):
    return B.volatility_normalised(read("events"), "user_id", ["ts"], "value", 10).select("event_id", "scaled")


@query(
    """SELECT g AS "at", sum(exp(-0.5 * pow((g - l_quantity) / 3, 2)) * l_extendedprice) / sum(exp(-0.5 * pow((g - l_quantity) / 3, 2))) AS mean
       FROM lineitem, (SELECT unnest(range(11)) * 5.0::DOUBLE AS g) GROUP BY 1""",
    "mean",
    4,
)
def kernel_means(read):
    return B.kernel_means(read("lineitem"), "l_quantity", "l_extendedprice", 0.0, 50.0, 11, 3.0)


@query(f"SELECT k, CASE WHEN y <= p * 0.7 THEN 0.05 WHEN y <= p THEN 0.05 + 0.45 * (y - p * 0.7) / (p - p * 0.7) WHEN y <= p * 1.2 THEN 0.5 + 0.45 * (y - p) / (p * 1.2 - p) ELSE 0.95 END AS pit FROM {R}", "pit", 9)
def probability_transform(read):
    p = F.col("p")
    return priced(read).select("k", B.interval_transform(F.col("y"), p * 0.7, p, p * 1.2).alias("pit"))
