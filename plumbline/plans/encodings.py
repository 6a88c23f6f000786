"""Queries over encodings and imputations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encodings as C
from .registry import query

Y = "CAST(o_orderstatus = 'F' AS INTEGER)"


def orders(read):
    return read("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def split(read):
    o = orders(read)
    return o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'")


TRAIN, TEST = f"(SELECT *, {Y} AS y FROM orders WHERE o_orderdate < '1999-01-01')", f"(SELECT *, {Y} AS y FROM orders WHERE o_orderdate >= '1999-01-01')"


@query("SELECT o_orderkey, coalesce(CAST(nullif(o_orderpriority, '5-LOW') AS VARCHAR), 'nan') || '_' || o_orderstatus AS key FROM orders")
def concat_key(read):
    o = read("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return C.concat_key(o, ["p", "o_orderstatus"]).select("o_orderkey", "key")


@query("SELECT l_orderkey, l_linenumber, l_returnflag || '_' || l_linestatus AS l_returnflag__l_linestatus, l_returnflag || '_' || l_linenumber AS l_returnflag__l_linenumber, l_linestatus || '_' || l_linenumber AS l_linestatus__l_linenumber, l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS l_returnflag__l_linestatus__l_linenumber FROM lineitem")
def powerset_concat(read):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    out = C.powerset_concat(read("lineitem"), cols, 3)
    return out.select("l_orderkey", "l_linenumber", *(c for c in out.columns if "__" in c))


@query("SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS VARCHAR) || '_' || p_brand AS p_retailprice_x_p_brand FROM part")
def rounded_category(read):
    return C.rounded_category(read("part"), "p_retailprice", "p_brand").select("p_partkey", "p_retailprice_x_p_brand")


@query(
    f"""WITH m AS (SELECT avg(y) AS g FROM {TRAIN}), t AS (SELECT o_orderpriority, (sum(y) + 20 * any_value(g)) / (count(y) + 20) AS te FROM {TRAIN}, m WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
        SELECT o_orderkey, coalesce(te, (SELECT avg(y) FROM {TRAIN} WHERE o_orderpriority <> '5-LOW')) AS o_orderpriority_te FROM {TEST} LEFT JOIN
        (SELECT o_orderpriority, (sum(y) + 20 * (SELECT avg(y) FROM {TRAIN} WHERE o_orderpriority <> '5-LOW')) / (count(y) + 20) AS te FROM {TRAIN} WHERE o_orderpriority <> '5-LOW' GROUP BY 1) USING (o_orderpriority)""",
    "o_orderpriority_te",
)
def smoothed_te(read):
    train, test = split(read)
    return C.apply_target_means(test, C.fit_target_means(train.where("o_orderpriority <> '5-LOW'"), "o_orderpriority", "y"), "o_orderpriority").select("o_orderkey", "o_orderpriority_te")


_PRIOR = f"(coalesce(sum({Y}) OVER w, 0) + 0.5) / (count(*) OVER w + 1)"


@query(f"SELECT o_orderkey, {_PRIOR} AS te FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "te")
def ordered_te(read):
    return C.ordered_target_encode(orders(read), "o_custkey", ["o_orderdate", "o_orderkey"], "y", 0.5).select("o_orderkey", "te")


@query(
    f"""WITH e AS (SELECT o_custkey, o_orderdate, {_PRIOR} AS enc FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        w AS (SELECT *, pow(0.5, date_diff('day', o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey)) / 90.0) AS w FROM e) SELECT o_custkey, sum(enc * w) / sum(w) AS recency FROM w GROUP BY 1""",
    "recency",
)
def two_step_te(read):
    return C.two_step_encode(orders(read), "o_custkey", "o_orderdate", ["o_orderdate", "o_orderkey"], "o_orderpriority", "y", 0.5)


@query(
    f"""WITH p AS (SELECT o_orderpriority, year(o_orderdate) AS yr, count(*) AS n, avg({Y}) AS m FROM orders GROUP BY 1, 2), g AS (SELECT o_orderpriority, avg({Y}) AS g FROM orders GROUP BY 1)
        SELECT o_orderpriority, CAST(yr AS INTEGER) AS yr, (n * m + 30 * g) / (n + 30) AS value FROM p JOIN g USING (o_orderpriority)""",
    "value",
)
def cross_locale_te(read):
    return C.cross_locale_encode(orders(read).withColumn("yr", F.year("o_orderdate")), "yr", "o_orderpriority", "y", 30.0)


def _stat(n, e, least):
    return f"CASE WHEN count(*) >= {least} THEN {e} ELSE (SELECT {e} FROM orders) END AS {n}"


_Q = "quantile_cont(o_totalprice, {})"


@query(
    "SELECT o_custkey, "
    + ", ".join(_stat(*s) for s in (("median", "median(o_totalprice)", 8), ("q10", _Q.format(0.1), 20), ("q90", _Q.format(0.9), 20), ("iqr", f"{_Q.format(0.75)} - {_Q.format(0.25)}", 12), ("min", "min(o_totalprice)", 8), ("max", "max(o_totalprice)", 8)))
    + " FROM orders GROUP BY 1",
    "median q10 q90 iqr min max",
)
def order_stat_te(read):
    return C.order_stat_encode(read("orders"), "o_custkey", "o_totalprice")


@query("SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS value, count(*) / (SELECT count(*) FROM orders) AS frequency FROM orders GROUP BY 1", "frequency")
def freq_union(read):
    train, test = split(read)
    blank = lambda d: d.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return C.union_frequency(blank(train), blank(test), "p")


@query(
    """WITH n AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), f AS (SELECT value, sum(n) OVER (PARTITION BY split_part(value, ' ', 1)) AS f1,
       sum(n) OVER (PARTITION BY array_to_string(string_split(value, ' ')[1:2], ' ')) AS f2, (SELECT count(*) FROM part) AS a FROM n)
       SELECT value, exp((ln(f1 / a) + ln(f2 / a)) / 2) AS frequency FROM f""",
    "frequency",
)
def prefix_frequency(read):
    return C.prefix_frequency(read("part"), "p_type", " ", 2)


@query(
    f"""WITH a AS (SELECT o_custkey, count(*) AS n, sum(y) AS s FROM {TRAIN} GROUP BY 1), b AS (SELECT o_custkey, count(*) AS m FROM {TEST} GROUP BY 1)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN n IS NOT NULL THEN CASE WHEN s = 0 THEN CASE WHEN n = 1 THEN 'unique_0' ELSE 'repeated_0' END WHEN s = n THEN CASE WHEN n = 1 THEN 'unique_1' ELSE 'repeated_1' END ELSE 'repeated_mixed' END
          WHEN m = 1 THEN 'new_unique' ELSE 'new_repeated' END AS flag FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""
)
def uniqueness_flags(read):
    train, test = split(read)
    return C.uniqueness_flags(train, test, "o_custkey", "y")


@query("SELECT p_partkey, CAST(NOT (count(*) OVER (PARTITION BY p_retailprice) = 1 OR count(*) OVER (PARTITION BY p_type, p_size) = 1) AS INTEGER) AS synthetic FROM part")
def synthetic_rows(read):
    p = read("part").withColumn("ts", F.concat_ws("|", "p_type", "p_size"))
    return C.synthetic_rows(p, ["p_retailprice", "ts"]).select("p_partkey", "synthetic")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) >= 20 THEN p_type ELSE 'other' END AS p_type_kept FROM part")
def rare_collapse(read):
    return C.collapse_rare(read("part"), "p_type", 20).select("p_partkey", "p_type_kept")


@query(
    f"""WITH e AS (SELECT o_custkey AS v, count(*) AS n, sum({Y}) AS s FROM orders GROUP BY 1), a AS (SELECT sum(n) AS an, sum(s) AS a FROM e),
        z AS (SELECT v, n, abs((ln((s + 0.5) / (n - s + 0.5)) - ln((a + 0.5) / (an - a + 0.5))) / sqrt(1 / (s + 0.5) + 1 / (n - s + 0.5))) AS z FROM e, a)
        SELECT CAST(v AS VARCHAR) AS value, CASE WHEN n >= 12 OR z >= 1.96 THEN CAST(v AS VARCHAR) ELSE 'other' END AS kept FROM z"""
)
def rare_collapse_target(read):
    return C.collapse_rare_by_target(orders(read).withColumn("c", F.col("o_custkey").cast("string")), "c", "y", 12)


@query(
    f"""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM {TRAIN} GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM {TEST} GROUP BY 1),
        r AS (SELECT coalesce(a.k, b.k) AS k, (a.n / (SELECT sum(n) FROM a)) / (b.n / (SELECT sum(n) FROM b)) AS r FROM a FULL JOIN b ON a.k = b.k)
        SELECT CAST(k AS VARCHAR) AS value, CASE WHEN r <= 2 AND r >= 0.5 THEN CAST(k AS VARCHAR) ELSE 'other' END AS bin FROM r"""
)
def adversarial_rebin(read):
    train, test = (d.withColumn("c", F.col("o_custkey").cast("string")) for d in split(read))
    return C.rebin_by_skew(train, test, "c")


@query(
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 5 <> 0 AND p_brand <> (SELECT min(p_brand) FROM part) THEN p_retailprice END AS v FROM part),
       m0 AS (SELECT p_brand, p_size, median(v) AS m0 FROM p GROUP BY 1, 2), m1 AS (SELECT p_brand, median(v) AS m1 FROM p GROUP BY 1)
       SELECT p_partkey, CAST(v IS NULL AS INTEGER) AS v_was_missing, coalesce(v, m0, m1, (SELECT median(v) FROM p)) AS v_filled FROM p JOIN m0 USING (p_brand, p_size) JOIN m1 USING (p_brand)""",
    "v_filled",
)
def regime_median_impute(read):
    p = read("part")
    least = p.agg(F.min("p_brand").alias("least"))
    p = p.crossJoin(least).withColumn("v", F.expr("case when p_partkey % 5 <> 0 and p_brand <> least then p_retailprice end"))
    return C.regime_impute(p, "v", "p_brand", "p_size").select("p_partkey", "v_was_missing", "v_filled")


_V = "CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END"


@query(f"SELECT l_orderkey, l_linenumber, CAST({_V} IS NULL AS INTEGER) AS v_was_missing, coalesce({_V}, (SELECT median({_V}) FROM lineitem)) AS v FROM lineitem", "v")
def missing_indicator(read):
    rows = read("lineitem").withColumn("v", F.expr(_V))
    return C.apply_imputes(rows, C.fit_imputes(rows, ["v"], "median")).select("l_orderkey", "l_linenumber", "v_was_missing", "v")


@query(
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
       SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, q1 - 0.3 * 0 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS l_extendedprice_capped FROM lineitem, b""",
    "l_extendedprice_capped",
)
def outlier_bounds(read):
    rows = read("lineitem")
    return C.cap(rows, "l_extendedprice", C.fit_bounds(rows, "l_extendedprice", "iqr")).select("l_orderkey", "l_linenumber", "l_extendedprice_capped")


@query(
    """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_custkey) AS c, max(o_custkey) AS d FROM orders WHERE o_orderdate < '1999-01-01')
       SELECT o_orderkey, ((o_totalprice < a OR o_totalprice > b)::INT + (o_custkey < c OR o_custkey > d)::INT) / 2 AS out_share FROM orders, e WHERE o_orderdate >= '1999-01-01'""",
    "out_share",
)
def out_of_range_share(read):
    o = read("orders")
    return C.out_of_range_share(o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'"), ["o_totalprice", "o_custkey"]).select("o_orderkey", "out_share")
