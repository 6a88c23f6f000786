"""Queries over as-of joins, lookups, neighbours and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, joins, neighbours
from .registry import query

VIEWS = "event_type = 'view'"
BUYS = "event_type = 'purchase'"


@query(
    """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "view_value",
)
def asof_last_view(read):
    e = read("events")
    views = e.where(VIEWS).select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof.asof_join(e.where(BUYS).select("event_id", "user_id", "ts"), views, "ts", ["user_id"], ["view_id", "view_value"], tiebreak="view_id")


@query(
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), h AS (SELECT * FROM events WHERE event_type = 'error'),
       n AS (SELECT user_id, count(*) AS n FROM h GROUP BY 1),
       a AS (SELECT p.event_id, h.value AS v0 FROM p ASOF LEFT JOIN h ON p.user_id = h.user_id AND p.ts >= h.ts),
       m AS (SELECT max(event_id) AS event_id, ts FROM h GROUP BY ts),
       g AS (SELECT h.ts, h.value FROM h JOIN m USING (event_id)),
       b AS (SELECT p.event_id, g.value AS v1 FROM p ASOF LEFT JOIN g ON p.ts >= g.ts)
       SELECT p.event_id, coalesce(CASE WHEN n.n >= 12 THEN v0 END, v1) AS value,
         CAST(CASE WHEN n.n >= 12 AND v0 IS NOT NULL THEN 0 WHEN v1 IS NOT NULL THEN 1 ELSE -1 END AS INTEGER) AS tier
       FROM p LEFT JOIN n USING (user_id) JOIN a USING (event_id) JOIN b USING (event_id)""",
    "value",
)
def asof_fallback_tiers(read):
    e = read("events")
    got = asof.asof_join_tiers(e.where(BUYS).select("event_id", "user_id", "ts"), e.where("event_type = 'error'"), "ts", [["user_id"], []], "value", "event_id", 12, "event_id")
    return got.select("event_id", "value", "tier")


@query(
    """SELECT q.event_id, sum(h.value) AS value_sum, avg(h.value) AS value_mean, nullif(count(h.value), 0) AS value_count,
         min(h.value) AS value_min, max(h.value) AS value_max
       FROM (SELECT * FROM events WHERE event_type = 'purchase') q LEFT JOIN events h ON h.user_id = q.user_id AND h.ts < q.ts GROUP BY 1""",
    "value_sum value_mean value_min value_max",
)
def asof_strict_agg(read):
    e = read("events")
    return asof.strict_aggregate(e, e.where(BUYS).select("event_id", "user_id", "ts"), "user_id", "ts", "value", ("sum", "mean", "count", "min", "max")).drop("user_id", "ts")


@query(
    """SELECT q.event_id, sum(h.value) FILTER (h.ts >= q.ts - INTERVAL 1 DAY) AS value_sum_last_1d, count(h.value) FILTER (h.ts >= q.ts - INTERVAL 1 DAY) AS value_count_last_1d,
         sum(h.value) AS value_sum_last_7d, count(h.value) AS value_count_last_7d
       FROM (SELECT * FROM events WHERE event_type = 'purchase') q
       LEFT JOIN events h ON h.user_id = q.user_id AND h.ts < q.ts AND h.ts >= q.ts - INTERVAL 7 DAY GROUP BY 1""",
    "value_sum_last_1d value_sum_last_7d",
)
def lookback_7d_1d(read):
    e = read("events")
    return asof.lookback_aggregate(e, e.where(BUYS).select("event_id", "user_id", "ts"), "user_id", "ts", "value", {"1d": 86400, "7d": 604800}, ("sum", "count")).drop("user_id", "ts")


@query(
    """WITH r AS (SELECT l_suppkey, sum(l_extendedprice) / sum(l_quantity) AS ratio FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
       SELECT s_suppkey, coalesce(ratio, 1.0) AS ratio FROM supplier LEFT JOIN r ON s_suppkey = l_suppkey""",
    "ratio",
)
def lookup_default(read):
    r = read("lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ratio"))
    return joins.lookup(read("supplier").select("s_suppkey"), r, ["s_suppkey"], {"ratio": 1.0})


@query("SELECT o_orderkey, CAST((o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < '1996-01-01')) AS INTEGER) AS seen FROM orders WHERE o_orderdate >= '2001-01-01'")
def membership_flag(read):
    o = read("orders")
    return joins.member_flag(o.where("o_orderdate >= '2001-01-01'"), o.where("o_orderdate < '1996-01-01'"), "o_custkey").select("o_orderkey", "seen")


@query(
    """WITH a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderdate < '1999-01-01' GROUP BY 1),
       b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderdate >= '1999-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS o_orderpriority, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b,
         (a.n / (SELECT sum(n) FROM a)) / (b.n / (SELECT sum(n) FROM b)) AS ratio FROM a FULL JOIN b ON a.k = b.k""",
    "ratio",
)
def count_shift(read):
    o = read("orders")
    return joins.count_shift(o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01' and o_orderpriority <> '5-LOW'"), "o_orderpriority")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.i - a.i BETWEEN 1 AND 3 WHERE a.n <= 12""",
)
def affiliation_edges(read):
    return joins.affiliation_edges(read("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", 3, 12)


@query(
    """WITH d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour,
         sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS distance
         FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
       o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d)
       SELECT query, neighbour, distance, rank, 1 / (1 + distance) AS weight FROM o WHERE rank <= 5""",
    "distance weight",
)
def knn_topk(read):
    v = read("embeddings")
    return joins.nearest_rows(v.where("vec_id % 20 = 0"), v, "embedding", "vec_id", 5)


@query(
    """WITH RECURSIVE k AS (SELECT DISTINCT p_name AS k FROM part), e AS (
         SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON substr(a.k, 1, 6) = substr(b.k, 1, 6) AND a.k <> b.k AND abs(length(a.k) - length(b.k)) <= 2 AND levenshtein(a.k, b.k) <= 2),
       r AS (SELECT k, k AS g FROM k UNION SELECT e.b, r.g FROM r JOIN e ON r.k = e.a)
       SELECT k AS p_name, min(g) AS "group" FROM r GROUP BY 1""",
)
def fuzzy_keys(read):
    return joins.fuzzy_groups(read("part"), "p_name", 6, 2)


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY round(l_quantity), round(l_discount, 2), l_returnflag) AS pseudo_group FROM lineitem")
def rounded_groups(read):
    from ..operators.encodings import pseudo_groups

    return pseudo_groups(read("lineitem"), [F.round("l_quantity"), F.round("l_discount", 2), F.col("l_returnflag")]).select("l_orderkey", "l_linenumber", "pseudo_group")


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice AS x, CASE WHEN o_totalprice - lag(o_totalprice) OVER (ORDER BY o_totalprice) <= 0.75 THEN 0 ELSE 1 END AS new FROM orders),
       g AS (SELECT o_orderkey, sum(new) OVER (ORDER BY x) AS g FROM o) SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY g) AS "group" FROM g"""
)
def radius_linkage(read):
    return joins.radius_groups(read("orders"), "o_orderkey", ["o_totalprice"], 0.75)


@query(
    """WITH x AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 10 <> 3 THEN o_totalprice END AS v FROM orders),
       l AS (SELECT o_custkey, max_by(v, (o_orderdate, o_orderkey)) FILTER (v IS NOT NULL) AS last FROM x GROUP BY 1),
       s AS (SELECT o_custkey, last_value(last IGNORE NULLS) OVER (ORDER BY o_custkey) AS last FROM l)
       SELECT o_orderkey, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), s.last, (SELECT avg(v) FROM x)) AS filled
       FROM x JOIN s USING (o_custkey)""",
    "filled",
)
def sibling_fill(read):
    o = read("orders").withColumn("v", F.expr("case when o_orderkey % 4 <> 0 and o_custkey % 10 <> 3 then o_totalprice end"))
    return joins.sibling_fill(o, "o_custkey", "o_orderdate", "v", "o_orderkey").select("o_orderkey", "filled")


@query(
    """WITH v AS (SELECT vec_id, embedding, label FROM embeddings), d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour,
         list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS distance
         FROM v q JOIN v r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
       o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d)
       SELECT query, neighbour, distance, rank, 1 / (1 + distance) AS weight FROM o WHERE rank <= 5""",
    "distance weight",
)
def knn_within_labels(read):
    v = read("embeddings")
    return neighbours.nearest_rows(v.where("vec_id % 20 = 0"), v, "embedding", "vec_id", 5, "manhattan", F.col("label"))


@query(
    """WITH v AS (SELECT vec_id, embedding, (vec_id * 7919) % 1009 AS t FROM embeddings), d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour,
         1 - list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(r.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS distance
         FROM v q JOIN v r ON r.t < q.t),
       o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d)
       SELECT query, neighbour, distance, rank, 1 / (1 + distance) AS weight FROM o WHERE rank <= 5""",
    "distance weight",
)
def knn_earlier(read):
    v = read("embeddings").withColumn("t", F.col("vec_id") * 7919 % 1009)
    return neighbours.nearest_earlier(v, "embedding", "vec_id", "t", 5, "cosine")


@query()
def knn_approximate(read):
    v = read("embeddings")
    return neighbours.approximate_neighbours(v.where("vec_id % 20 = 0"), v, "embedding", "vec_id", 10)


@query(
    """WITH m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice) / 1000 AS price, avg(o_custkey) / 10 AS customer FROM orders GROUP BY 1),
       d AS (SELECT a.month, b.price, b.customer, sqrt((a.price - b.price) ** 2 + (a.customer - b.customer) ** 2) AS d FROM m a JOIN m b ON a.month <> b.month),
       r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY d) AS i FROM d)
       SELECT month, avg(price) AS price_mean, stddev_pop(price) AS price_std, avg(customer) AS customer_mean, stddev_pop(customer) AS customer_std,
         CASE WHEN max(d) FILTER (i = 5) > 0 THEN min(d) / (max(d) FILTER (i = 5)) ELSE 1.0 END AS distance_ratio FROM r WHERE i <= 5 GROUP BY 1""",
    "price_mean price_std customer_mean customer_std distance_ratio",
)
def snapshot_neighbours(read):
    o = read("orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") / 10).alias("customer"))
    return neighbours.snapshot_neighbours(o, "month", ["price", "customer"], 5)


@query(
    """WITH RECURSIVE p AS (SELECT c_custkey AS k, c_acctbal / 50 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
       e AS (SELECT a.k AS a, b.k AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
       c AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 6),
       l AS (SELECT a, b FROM e WHERE a IN (FROM c) AND b IN (FROM c)),
       r AS (SELECT k, k AS g FROM c UNION SELECT l.b, r.g FROM r JOIN l ON r.k = l.a),
       g AS (SELECT k, min(g) AS cluster FROM r GROUP BY k),
       o AS (SELECT e.a AS k, arg_min(cluster, (d, cluster)) AS cluster FROM e JOIN g ON g.k = e.b WHERE e.a NOT IN (FROM c) GROUP BY 1)
       SELECT p.k AS c_custkey, coalesce(g.cluster, o.cluster) AS cluster, g.k IS NOT NULL AS core FROM p LEFT JOIN g ON g.k = p.k LEFT JOIN o ON o.k = p.k"""
)
def density_clusters(read):
    c = read("customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("x"), F.col("c_nationkey").alias("y"))
    return joins.density_clusters(c, "c_custkey", ["x", "y"], 2.0, 6)
