"""Queries over grouped aggregates, drift and information measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import resampling as R
from .registry import query


def _halves(read):
    o = read("orders")
    return o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'")


@query(
    """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, m, l_quantity - m AS d FROM lineitem JOIN m USING (l_returnflag))
       SELECT l_returnflag, any_value(m) AS mean, avg(d * d) AS var, sqrt(avg(d * d)) AS std, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS kurt FROM d GROUP BY 1""",
    "mean var std skew kurt",
)
def moments(read):
    return A.moments(read("lineitem"), ["l_returnflag"], "l_quantity")


@query(
    """WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS r FROM n)
       SELECT o_custkey, count(*) AS n_distinct, avg(n) AS mean_count, max(n) AS max_count, max(v) FILTER (r = 1) AS value_1, max(n) FILTER (r = 1) AS count_1, max(v) FILTER (r = 2) AS value_2, max(n) FILTER (r = 2) AS count_2 FROM r GROUP BY 1""",
    "mean_count",
)
def value_count_aggregates(read):
    return A.value_counts(read("orders"), "o_custkey", "o_orderpriority", 2)


@query("SELECT l_suppkey, count(DISTINCT (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT) AS bins FROM lineitem GROUP BY 1")
def binned_unique(read):
    return A.binned_unique(read("lineitem"), "l_suppkey", "l_quantity", [10, 20, 30, 40])


@query(
    """WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS d FROM orders),
       a AS (SELECT o_custkey, avg(v) FILTER (u <= 3) AS first, avg(v) FILTER (d <= 3) AS last FROM r GROUP BY 1) SELECT *, last - first AS diff, last / nullif(first, 0) AS ratio FROM a""",
    "first last diff ratio",
)
def edge_diff(read):
    return A.edge_diff(read("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 3)


_P = "l_quantity * 1500.0"


@query(
    f"""WITH a AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) / avg({_P}) AS r FROM lineitem GROUP BY 1), g AS (SELECT avg(l_extendedprice) / avg({_P}) AS g FROM lineitem)
        SELECT l_suppkey, CASE WHEN n < 20 THEN 1.0 ELSE least(greatest((n * r + 50 * g) / (n + 50), 0.5), 2.0) END AS ratio FROM a, g""",
    "ratio",
)
def group_bias(read):
    return A.group_bias(read("lineitem").withColumn("p", F.expr("l_quantity * 1500.0D")), "l_suppkey", "l_extendedprice", "p", shrink=50.0)


@query("SELECT o_orderkey, o_totalprice - coalesce(sum(o_custkey * o_totalprice) OVER (PARTITION BY o_orderdate) / nullif(sum(o_custkey) OVER (PARTITION BY o_orderdate), 0), 0) AS o_totalprice_adjusted FROM orders", "o_totalprice_adjusted")
def zero_sum(read):
    return A.zero_sum(read("orders"), "o_orderdate", "o_totalprice", "o_custkey").select("o_orderkey", "o_totalprice_adjusted")


@query("SELECT o_orderkey, quantile_cont(o_totalprice, 0.3) OVER (PARTITION BY o_custkey) AS o_totalprice_collapsed FROM orders", "o_totalprice_collapsed")
def collapse_quantile(read):
    return A.collapse(read("orders"), "o_custkey", "o_totalprice", 0.3).select("o_orderkey", "o_totalprice_collapsed")


@query(
    """WITH a AS (SELECT l_suppkey, l_extendedprice AS p, (sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity / 2) / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS pos FROM lineitem),
       b AS (SELECT *, lead(pos) OVER w AS n, lead(p) OVER w AS np FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY pos, p))
       SELECT l_suppkey, CASE WHEN min(pos) > 0.5 THEN min(p) ELSE coalesce(max(CASE WHEN pos <= 0.5 AND n > 0.5 THEN p + (0.5 - pos) / (n - pos) * (np - p) END), max(p)) END AS quantile FROM b GROUP BY 1""",
    "quantile",
)
def weighted_quantile(read):
    return A.weighted_quantile(read("lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", 0.5)


_TR, _TE = "o_orderdate < '1999-01-01'", "o_orderdate >= '1999-01-01'"


def _drift(c):
    return f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, (count(*) FILTER ({_TE}) / (SELECT count(*) FROM orders WHERE {_TE})) / (count(*) FILTER ({_TR}) / (SELECT count(*) FROM orders WHERE {_TR})) AS ratio FROM orders GROUP BY {c}"""


@query(f"{_drift('o_orderpriority')} UNION ALL {_drift('o_orderstatus')}", "ratio")
def prevalence_drift(read):
    return A.prevalence_drift(*_halves(read), ["o_orderpriority", "o_orderstatus"])


@query(
    """WITH v AS (SELECT var_samp(l_extendedprice) AS v FROM lineitem), g AS (SELECT 'l_quantity' AS c, var_samp(l_extendedprice) AS g, count(*) AS n FROM lineitem GROUP BY l_quantity UNION ALL
       SELECT 'l_returnflag', var_samp(l_extendedprice), count(*) FROM lineitem GROUP BY l_returnflag)
       SELECT c AS "column", min(g) / any_value(v) AS ratio, CAST(min(g) / any_value(v) < 0.1 AS INTEGER) AS leak FROM g, v WHERE n >= 20 GROUP BY 1""",
    "ratio",
)
def constant_group_scan(read):
    return A.constant_group_scan(read("lineitem"), ["l_quantity", "l_returnflag"], "l_extendedprice")


_X, _Z = "l_returnflag", "l_linestatus"
_CODE = "(SELECT *, (l_quantity >= 13)::INT + (l_quantity >= 26)::INT + (l_quantity >= 39)::INT AS q FROM lineitem)"


def coded(read):
    q = F.col("l_quantity")
    return read("lineitem").withColumn("q", (q >= 13).cast("int") + (q >= 26).cast("int") + (q >= 39).cast("int"))


def _mi(x, y):
    return f"""SELECT greatest(sum(n / a * ln(n * a / (nx * ny))), 0) FROM (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS a FROM (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {_CODE} GROUP BY 1, 2))"""


def _h(x, t="lineitem"):
    return f"(SELECT -sum(n / a * ln(n / a)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS a FROM {t} GROUP BY {x}))"


@query(f"SELECT ({_mi(_X, 'q')}) AS mi", "mi", 9)
def mi_contingency(read):
    return A.mutual_information(coded(read), _X, "q")


@query(f"SELECT ({_mi(_X + ' || ' + _Z, 'q')}) AS jmi", "jmi", 9)
def joint_mi(read):
    return A.joint_mutual_information(coded(read), _X, _Z, "q")


@query(
    f"""SELECT sum(n / a * ln(n * nz / (xz * yz))) AS cmi FROM (SELECT *, sum(n) OVER (PARTITION BY x, z) AS xz, sum(n) OVER (PARTITION BY y, z) AS yz, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER () AS a
        FROM (SELECT {_X} AS x, q AS y, {_Z} AS z, count(*) AS n FROM {_CODE} GROUP BY 1, 2, 3))""",
    "cmi",
    9,
)
def conditional_mi(read):
    return A.conditional_mutual_information(coded(read), _X, "q", _Z)


@query(
    """WITH n AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), t AS (SELECT n, sum(n) OVER () AS a, count(*) OVER () AS k, sum((n = 1)::INT) OVER () AS f1 FROM n),
       c AS (SELECT n / a AS p, (1 - f1 / a) * n / a AS c, a, k FROM t)
       SELECT -sum(p * ln(p)) AS plugin, -sum(p * ln(p)) + (max(k) - 1) / (2 * max(a)) AS miller_madow, -sum(c * ln(c) / (1 - pow(1 - c, a))) AS chao_shen FROM c""",
    "plugin miller_madow chao_shen",
)
def chao_shen(read):
    return A.entropies(read("orders"), "o_custkey")


@query(f"SELECT 2 * ({_mi(_X, _Z)}) / ({_h(_X)} + {_h(_Z)}) AS su", "su", 9)
def symmetric_uncertainty(read):
    return A.symmetric_uncertainty(read("lineitem"), _X, _Z)


@query()
def column_screen(read):
    rows = coded(read)
    got = A.screen(rows, ["q", "l_linenumber", "l_linestatus"], "l_returnflag", 2)
    return rows.sparkSession.createDataFrame([(i, f, float(g)) for i, (f, g) in enumerate(got)], "step int, feature string, gain double")


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.9) AS b FROM orders)
       SELECT avg(o_totalprice) FILTER (o_totalprice BETWEEN a AND b) AS trimmed, avg(least(greatest(o_totalprice, a), b)) AS winsorised, median(o_totalprice) AS median FROM orders, q""",
    "trimmed winsorised median",
    4,
)
def robust_location(read):
    return A.robust_location(read("orders"), "o_totalprice")


@query()
def huber_location(read):
    rows = read("orders")
    return rows.sparkSession.createDataFrame([(A.m_estimate(rows, "o_totalprice"),)], "location double")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, count(*) OVER (ORDER BY l_quantity) AS le, count(*) OVER (ORDER BY l_quantity DESC) AS ge, count(*) OVER () AS n FROM lineitem),
       d AS (SELECT le, ge, n, lead(le) OVER (ORDER BY x, l_orderkey * 10 + l_linenumber) AS nx FROM r) SELECT 1 - any_value(n) * sum(abs(nx - le)) / (2 * sum(ge * (n - ge))) AS xi FROM d""",
    "xi",
)
def xi_correlation(read):
    return A.xi_correlation(read("lineitem").withColumn("k", F.expr("l_orderkey * 10 + l_linenumber")), "l_extendedprice", "l_quantity", "k")


@query(
    f"""WITH v AS (SELECT o_totalprice AS v, ({_TR})::INT AS a FROM orders), c AS (SELECT v, sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM v) AS fa, sum(1 - a) OVER (ORDER BY v) / (SELECT sum(1 - a) FROM v) AS fb FROM v),
        k AS (SELECT max(abs(fa - fb)) AS ks, (SELECT sum(a) FROM v) AS na, (SELECT sum(1 - a) FROM v) AS nb FROM c), e AS (SELECT ks, sqrt(na * nb / (na + nb)) * ks AS e FROM k)
        SELECT ks, least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * e * e))), 0), 1) AS p_value FROM e""",
    "ks p_value",
)
def two_sample_ks(read):
    return A.two_sample_ks(*_halves(read), "o_totalprice")


@query()
def bootstrap_mean(read):
    return A.bootstrap_mean(read("orders"), "o_totalprice", "o_orderkey", 50)


@query()
def permutation_test(read):
    return A.permutation_test(read("orders").where("o_orderkey > 0"), "o_orderstatus", "o_custkey", "o_totalprice", "o_orderkey", 20)


@query()
def bootstrap_bca(read):
    """Root mean squared error of the price that the quantity alone would give."""
    rows = read("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.bootstrap_bca(rows, (F.col("l_extendedprice") - 1500 * F.col("l_quantity")) ** 2, "id", shape=F.sqrt, replicates=200)


@query()
def max_statistic(read):
    rows = read("lineitem").withColumns({"id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "noise": F.xxhash64("l_orderkey", "l_linenumber") % 1000})
    return R.max_statistic_test(rows, ["l_quantity", "l_discount", "l_tax", "noise"], "l_extendedprice", "id", "l_returnflag", 50)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "total", 4)
def rollup_totals(read):
    return A.grouping_sets(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").drop("about")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "total", 4)
def cube_totals(read):
    return A.grouping_sets(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "cube").drop("about")
