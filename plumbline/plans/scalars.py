"""Queries over column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query

K = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, CAST(a & b AS TINYINT) AS a__and__b, CAST(a | b AS TINYINT) AS a__or__b, CAST(xor(a, b) AS TINYINT) AS a__xor__b FROM (SELECT *, (l_quantity > 20)::INT AS a, CASE WHEN l_linenumber < 6 THEN (l_discount > 0.05)::INT END AS b FROM lineitem)")
def boolean_pairs(read):
    r = read("lineitem").withColumn("a", (F.col("l_quantity") > 20).cast("int")).withColumn("b", F.when(F.col("l_linenumber") < 6, (F.col("l_discount") > 0.05).cast("int")))
    return r.select(*K, *(c.alias(n) for n, c in S.boolean_pairs("a", "b").items()))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice / CASE WHEN abs(l_tax) >= 0.01 THEN l_tax ELSE 0.01 END AS ratio, ln(1 + abs(l_extendedprice) + 1e-9) - ln(1 + abs(l_tax) + 1e-9) AS log_ratio,
         l_quantity * l_discount AS l_quantity__mul__l_discount, l_quantity / CASE WHEN l_discount >= 0.001 THEN l_discount ELSE 0.001 END AS l_quantity__div__l_discount, l_quantity + l_discount AS l_quantity__add__l_discount, l_quantity - l_discount AS l_quantity__sub__l_discount FROM lineitem""",
    "ratio log_ratio l_quantity__mul__l_discount l_quantity__div__l_discount l_quantity__add__l_discount l_quantity__sub__l_discount",
)
def ratios_interactions(read):
    p, t = F.col("l_extendedprice"), F.col("l_tax")
    return read("lineitem").select(*K, S.safe_ratio(p, t, 0.01).alias("ratio"), S.log_ratio(p, t).alias("log_ratio"), *(c.alias(n) for n, c in S.interactions("l_quantity", "l_discount", 0.001).items()))


@query(
    """WITH s AS (SELECT var_samp(l_quantity) AS va, var_samp(l_discount) AS vb, var_samp(l_tax) AS vc, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_quantity, l_tax) AS ac, covar_samp(l_discount, l_tax) AS bc FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_quantity - l_discount AS l_quantity__diff__l_discount, l_quantity - l_tax AS l_quantity__diff__l_tax FROM lineitem, s WHERE va + vb - 2 * ab > 1 AND va + vc - 2 * ac > 1 AND vb + vc - 2 * bc <= 1""",
    "l_quantity__diff__l_discount l_quantity__diff__l_tax",
)
def variance_gated_diff(read):
    from ..operators.frames import variance_gated_diffs

    out = variance_gated_diffs(read("lineitem"), ["l_quantity", "l_discount", "l_tax"], 1.0)
    return out.select(*K, *(c for c in out.columns if "__diff__" in c))


@query(
    """SELECT o_orderkey, greatest(0, CASE WHEN d < 0 THEN 30 ELSE 10 END - abs(d))::DOUBLE AS force FROM (SELECT o_orderkey, date_diff('day', TIMESTAMP '1998-12-25', o_orderdate) AS d FROM orders)""",
    "force",
)
def event_proximity(read):
    return read("orders").select("o_orderkey", S.proximity(F.col("o_orderdate"), F.lit("1998-12-25").cast("timestamp_ntz"), 30, 10).alias("force"))


@query("SELECT l_orderkey, l_linenumber, (l_discount = 0)::INT + (l_tax = 0)::INT + (l_quantity = 1)::INT AS sentinels, (l_discount = 0)::INT + (l_tax = 0)::INT AS n_null, CAST((l_discount = 0)::INT + 2 * (l_tax = 0)::INT AS BIGINT) AS pattern FROM lineitem")
def sentinels_missing(read):
    r = read("lineitem").withColumn("d", F.nullif("l_discount", F.lit(0.0))).withColumn("t", F.nullif("l_tax", F.lit(0.0)))
    n, p = S.missing_pattern(["d", "t"])
    return r.select(*K, (S.sentinel_count(["l_discount", "l_tax"], [0.0]) + S.sentinel_count(["l_quantity"], [1.0])).alias("sentinels"), n.alias("n_null"), p.alias("pattern"))


@query(
    """SELECT k1 AS l_orderkey, k2 AS l_linenumber, list_avg(v) AS mean, sqrt(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v)) AS std, list_min(v) AS min, list_max(v) AS max, list_median(v) AS median,
       list_aggregate(v, 'quantile_cont', 0.25) AS q25, list_aggregate(v, 'quantile_cont', 0.75) AS q75
       FROM (SELECT l_orderkey AS k1, l_linenumber AS k2, list_filter([l_quantity, nullif(l_discount, 0) * 100, l_tax * 100, l_linenumber::DOUBLE], lambda x: x IS NOT NULL) AS v FROM lineitem)""",
    "mean std min max median q25 q75",
    4,
)
def row_wise_summary(read):
    r = read("lineitem").withColumn("a", F.nullif("l_discount", F.lit(0.0)) * 100).withColumn("b", F.col("l_tax") * 100)
    return r.select(*K, *(c.alias(n) for n, c in S.row_stats(["l_quantity", "a", "b", "l_linenumber"]).items()))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 AND l_quantity <= 20 THEN l_quantity * 1.1 ELSE l_quantity END AS band, CASE WHEN l_quantity - 25 < 0 THEN (l_quantity - 25) * 1.5 ELSE (l_quantity - 25) / 1.5 END AS signed,
         least(greatest(l_discount, 0.02), 0.08) AS clipped, CASE WHEN l_linenumber = 1 THEN 0.7 * l_tax + 0.3 * l_discount ELSE l_discount END AS blended FROM lineitem""",
    "band signed clipped blended",
)
def band_correction(read):
    q = F.col("l_quantity")
    return read("lineitem").select(*K, S.band_scale(q, 10, 20, 1.1).alias("band"), S.signed_rescale(q - 25, 1.5).alias("signed"), S.clip(F.col("l_discount"), 0.02, 0.08).alias("clipped"), S.override(F.col("l_discount"), F.when(F.col("l_linenumber") == 1, F.col("l_tax")), 0.7).alias("blended"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, [l_discount * 5, (1 - l_discount * 5) * 0.25, (1 - l_discount * 5) * 0.75] AS p FROM lineitem)
       SELECT l_orderkey, l_linenumber, CASE WHEN p[1] < 0.3 THEN 0.3 ELSE p[1] END AS p0, CASE WHEN p[1] < 0.3 THEN p[2] * 0.7 / (1 - p[1]) ELSE p[2] END AS p1, CASE WHEN p[1] < 0.3 THEN p[3] * 0.7 / (1 - p[1]) ELSE p[3] END AS p2 FROM p""",
    "p0 p1 p2",
)
def sticky_floor(read):
    d = F.col("l_discount") * 5
    out = read("lineitem").select(*K, S.sticky_floor(F.array(d, (1 - d) * 0.25, (1 - d) * 0.75), F.lit(0), 0.3).alias("p"))
    return out.select(*K, *(F.col("p")[i].alias(f"p{i}") for i in range(3)))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN q >= 25 THEN 0 WHEN q > 10 THEN (25 - q) / 15 ELSE 1 END AS low, CASE WHEN q <= 10 OR q >= 40 THEN 0 WHEN q < 25 THEN (q - 10) / 15 ELSE (40 - q) / 15 END AS mid, CASE WHEN q <= 25 THEN 0 WHEN q < 40 THEN (q - 25) / 15 ELSE 1 END AS high,
       exp(-0.5 * pow((q - 10) / 8, 2)) / (exp(-0.5 * pow((q - 10) / 8, 2)) + exp(-0.5 * pow((q - 40) / 8, 2))) AS near_10 FROM (SELECT *, l_quantity AS q FROM lineitem)""",
    "low mid high near_10",
)
def fuzzy_partition(read):
    q = F.col("l_quantity")
    return read("lineitem").select(*K, *(c.alias(n) for n, c in zip(("low", "mid", "high"), S.triangular(q, [10.0, 25.0, 40.0]), strict=True)), S.gaussian_memberships(q, [10.0, 40.0], 8.0)[0].alias("near_10"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, list_filter(list_transform(range(1, 21), lambda i: i * CAST(0.05 AS DOUBLE)), lambda x: abs(l_quantity * x - 10) <= 2) AS v FROM lineitem)
       SELECT l_orderkey, l_linenumber, list_min(v) AS fit_min, list_max(v) AS fit_max, list_avg(v) AS fit_mean, list_median(v) AS fit_median, CAST(len(v) AS INTEGER) AS fit_count FROM v""",
    "fit_min fit_max fit_mean fit_median",
)
def latent_parameter_scan(read):
    grid = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i * F.lit(0.05))
    return read("lineitem").select(*K, *(c.alias(n) for n, c in S.fitting_grid(grid, lambda x: F.col("l_quantity") * x - 10, 2.0).items()))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE l_tax END AS gated, CAST(CASE WHEN l_quantity / 50 >= l_discount * 10 AND l_quantity / 50 >= l_tax * 12 THEN 0 WHEN l_discount * 10 >= l_tax * 12 THEN 1 ELSE 2 END AS INTEGER) AS best,
         gcd(l_partkey, l_suppkey) AS gcd, lcm(l_partkey, l_suppkey) AS lcm, l_partkey & l_suppkey AS "and", l_partkey | l_suppkey AS "or", xor(l_partkey, l_suppkey) AS xor FROM lineitem""",
    "gated",
)
def gates_lattice(read):
    r = read("lineitem").withColumn("a", F.col("l_quantity") / 50).withColumn("b", F.col("l_discount") * 10).withColumn("c", F.col("l_tax") * 12)
    return r.select(*K, S.gate(F.col("l_discount"), 0.05, F.col("l_quantity"), F.col("l_tax")).alias("gated"), S.row_argmax(["a", "b", "c"]).alias("best"), *(c.alias(n) for n, c in S.lattice(F.col("l_partkey"), F.col("l_suppkey")).items()))


@query(
    "SELECT l_orderkey, l_linenumber, 4 * pow(x, 3) - 3 * x AS cheb3, (5 * pow(x, 3) - 3 * x) / 2 AS leg3, 3 * pow(x, 2) * (1 - x) AS bern2 FROM (SELECT *, l_discount * 10 AS x FROM lineitem)",
    "cheb3 leg3 bern2",
)
def polynomial_bases(read):
    x = F.col("l_discount") * 10
    return read("lineitem").select(*K, S.chebyshev(x, 3)[3].alias("cheb3"), S.legendre(x, 3)[3].alias("leg3"), S.bernstein(x, 3)[2].alias("bern2"))


_B = math.log(0.2 / 0.8)


@query(
    f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, 0.3 + l_discount AS p, 0.4 + l_tax AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber, exp(a) / (exp(a) + exp(b)) AS soft_a, 1 / (1 + exp(-a)) AS sig, 1 / (1 + exp(-({_B} + ln(p / (1 - p)) - {_B} + ln(q / (1 - q)) - {_B}))) AS odds FROM z""",
    "soft_a sig odds",
)
def softmax_odds(read):
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    return read("lineitem").select(*K, S.softmax(F.array(a, b))[0].alias("soft_a"), S.sigmoid(a).alias("sig"), S.combined_odds([0.3 + F.col("l_discount"), 0.4 + F.col("l_tax")], 0.2).alias("odds"))


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(dayofyear(o_orderdate) AS INTEGER) AS yearday, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS weekend, sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos,
         sin(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS weekday_cos FROM orders""",
    "month_sin month_cos weekday_sin weekday_cos",
)
def date_features(read):
    return read("orders").select("o_orderkey", *(c.alias(n) for n, c in S.date_parts(F.col("o_orderdate")).items()))


@query("SELECT l_orderkey, l_linenumber, list_sort([l_tax, l_discount, l_quantity / 100])[1] AS q0, list_sort([l_tax, l_discount, l_quantity / 100])[2] AS q1, list_sort([l_tax, l_discount, l_quantity / 100])[3] AS q2 FROM lineitem", "q0 q1 q2")
def quantile_uncross(read):
    out = read("lineitem").select(*K, S.uncross(F.array(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 100)).alias("q"))
    return out.select(*K, *(F.col("q")[i].alias(f"q{i}") for i in range(3)))


@query(
    """WITH p AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey % 50) AS s FROM lineitem GROUP BY 1), x AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.s, b.s))::DOUBLE AS n, len(a.s) AS na, len(b.s) AS nb FROM p a JOIN p b ON b.k = a.k + 1)
       SELECT a, b, n / (na + nb - n) AS jaccard, 2 * n / (na + nb) AS dice, n / least(na, nb) AS overlap, n / greatest(na, nb) AS braun_blanquet, n / sqrt(na * nb) AS ochiai, (n / na + n / nb) / 2 AS kulczynski, n / (n + 0.5 * (na - n) + 0.5 * (nb - n)) AS tversky FROM x""",
    "jaccard dice overlap braun_blanquet ochiai kulczynski tversky",
)
def set_similarity(read):
    p = read("lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("s"))
    a, b = p.select(F.col("l_suppkey").alias("a"), F.col("s").alias("sa")), p.select(F.col("l_suppkey").alias("b"), F.col("s").alias("sb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", *(c.alias(n) for n, c in S.set_similarities(F.col("sa"), F.col("sb")).items()))
