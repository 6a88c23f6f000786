"""Queries over graphs, text weights and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators.joins import connected
from .registry import query

_E = "(SELECT l_suppkey AS a, l_orderkey % 97 + 1000000000 AS b FROM lineitem)"
_U = f"WITH u AS (SELECT DISTINCT a AS s, b AS d FROM {_E} UNION SELECT DISTINCT b, a FROM {_E} UNION SELECT DISTINCT l_suppkey, l_suppkey % 10 + 1 FROM lineitem WHERE l_suppkey <> l_suppkey % 10 + 1 UNION SELECT DISTINCT l_suppkey % 10 + 1, l_suppkey FROM lineitem WHERE l_suppkey <> l_suppkey % 10 + 1)"


def edges(read):
    """Suppliers and buckets of orders, and suppliers among each other: whole tables."""
    pair = lambda b: F.struct(F.col("l_suppkey").cast("bigint").alias("src"), b.cast("bigint").alias("dst"))
    both = F.explode(F.array(pair(F.col("l_orderkey") % 97 + 1000000000), pair(F.col("l_suppkey") % 10 + 1)))
    return read("lineitem").select(both.alias("e")).select("e.*").distinct()


@query(
    f"""{_U}, g AS (SELECT s AS node, count(*) AS degree FROM u GROUP BY 1), t AS (SELECT x.s AS node, count(*) // 2 AS triangles FROM u x JOIN u y ON x.s = y.s AND x.d <> y.d JOIN u z ON z.s = x.d AND z.d = y.d GROUP BY 1)
        SELECT node, degree, coalesce(triangles, 0) AS triangles, coalesce(coalesce(triangles, 0) / nullif(degree * (degree - 1) / 2, 0), 0) AS clustering FROM g LEFT JOIN t USING (node)""",
    "clustering",
)
def graph_structure(read):
    return G.structure(edges(read))


@query(f"{_U} SELECT s_suppkey, count(d) AS neighbours, coalesce(avg(CASE WHEN d IS NOT NULL THEN v END), 0) AS neighbour_mean FROM supplier LEFT JOIN (SELECT s, d, s_acctbal AS v FROM u JOIN supplier ON d = s_suppkey) ON s = s_suppkey GROUP BY 1", "neighbour_mean")
def neighbour_aggregate(read):
    return G.neighbour_aggregate(edges(read), read("supplier"), "s_suppkey", "s_acctbal")


@query(
    f"""{_U}, g AS (SELECT s, count(*) AS d FROM u GROUP BY 1), p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
        c AS (SELECT a, b, count(*) AS n, sum(1 / ln(g.d)) AS aa, sum(1 / g.d) AS ra FROM p JOIN u x ON x.s = a JOIN u y ON y.s = b AND y.d = x.d JOIN g ON g.s = x.d GROUP BY 1, 2)
        SELECT p.a, p.b, coalesce(n, 0) AS common, coalesce(coalesce(n, 0) / nullif(coalesce(ga.d, 0) + coalesce(gb.d, 0) - coalesce(n, 0), 0), 0) AS jaccard, coalesce(ga.d, 0) * coalesce(gb.d, 0) AS attachment, coalesce(aa, 0) AS adamic_adar, coalesce(ra, 0) AS allocation
        FROM p LEFT JOIN c ON p.a = c.a AND p.b = c.b LEFT JOIN g ga ON ga.s = p.a LEFT JOIN g gb ON gb.s = p.b""",
    "jaccard adamic_adar allocation",
)
def link_prediction(read):
    pairs = read("supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return G.link_prediction(edges(read), pairs)


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, a AS g FROM u UNION SELECT u.b, r.g FROM r JOIN u ON r.n = u.a) SELECT n AS o_custkey, min(g) AS \"group\" FROM r GROUP BY 1")
def components(read):
    o = read("orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("b")).distinct()
    nodes = o.select(F.col("a").alias("o_custkey")).unionByName(o.select(F.col("b").alias("o_custkey"))).distinct()
    return connected(o, nodes, "o_custkey")


@query(
    """WITH n AS (SELECT o_custkey, o_orderpriority, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2), t AS (SELECT o_custkey, sum(c) AS t FROM n GROUP BY 1), d AS (SELECT o_orderpriority, count(*) AS df FROM n GROUP BY 1)
       SELECT o_orderpriority, o_custkey, c / t * (ln((SELECT count(*) FROM t) / df) + 1) AS w FROM n JOIN t USING (o_custkey) JOIN d USING (o_orderpriority)""",
    "w",
)
def tfidf_terms(read):
    return G.tf_idf(read("orders"), "o_custkey", "o_orderpriority")


@query("SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2")
def term_counts(read):
    return read("documents").select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


@query()
def interaction_embedding(read):
    return G.embed(G.tf_idf(read("lineitem"), "l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", 2, 2).select("l_suppkey", F.size("vector").alias("width"))


@query(
    """SELECT o_custkey, o_orderpriority, sum(pow(0.5, date_diff('microsecond', o_orderdate, (SELECT max(o_orderdate) FROM orders)) / (86400 * 1e6) / 90)) AS w
       FROM orders GROUP BY 1, 2""",
    "w",
)
def decayed_interactions(read):
    return G.decayed_weights(read("orders"), "o_custkey", "o_orderpriority", "o_orderdate", 90.0)


@query(places=3)
def decayed_embedding(read):
    """How much of each customer's decayed interactions lies in the two leading directions."""
    w = G.decayed_weights(read("orders"), "o_custkey", "o_orderpriority", "o_orderdate", 365.0)
    v = G.embed(w, "o_custkey", "o_orderpriority", 2, tol=1e-4)
    return v.select("o_custkey", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("inside"))


@query()
def oof_neighbours(read):
    return G.out_of_fold_neighbours(read("embeddings"), "vec_id", "embedding", "label")


@query(
    """WITH a AS (SELECT vec_id AS t, embedding AS tv, label AS ty FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 20 <> 0), n AS (SELECT count(*) AS n FROM b),
       p AS (SELECT t, vec_id, (label = ty)::INT AS hit, row_number() OVER (PARTITION BY t ORDER BY list_sum(list_transform(list_zip(tv, embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), vec_id) AS i FROM a, b),
       s AS (SELECT *, lead(hit) OVER (PARTITION BY t ORDER BY i) AS nx FROM p), v AS (SELECT vec_id, sum(CASE WHEN nx IS NULL THEN hit / n ELSE (hit - nx) / 5 * least(5, i) / i END) OVER (PARTITION BY t ORDER BY i DESC) AS s FROM s, n)
       SELECT vec_id, avg(s) AS value FROM v GROUP BY 1""",
    "value",
    9,
)
def knn_shapley(read):
    v = read("embeddings")
    return G.knn_shapley(v.where("vec_id % 20 != 0"), v.where("vec_id % 20 = 0"), "vec_id", "embedding", "label")


@query(
    """WITH u AS (SELECT o_totalprice AS p, o_custkey AS c, (o_orderdate >= '1999-01-01')::INT AS y FROM orders), l AS (SELECT 'o_totalprice' AS "column", p AS v, y FROM u UNION ALL SELECT 'o_custkey', c, y FROM u),
       r AS (SELECT "column", y, rank() OVER (PARTITION BY "column" ORDER BY v) + (count(*) OVER (PARTITION BY "column", v) - 1) / 2 AS r FROM l), a AS (SELECT "column", (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS a FROM r GROUP BY 1)
       SELECT "column", greatest(a, 1 - a) AS auc FROM a""",
    "auc",
)
def adversarial_validation(read):
    o = read("orders")
    return G.adversarial_auc(o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1999-01-01'"), ["o_totalprice", "o_custkey"])


@query()
def spectral_gap(read):
    """The gap of each connected component of the graph in which nations supply their neighbours by number."""
    n = read("supplier").select((F.col("s_nationkey") * 7).alias("src"), (F.col("s_nationkey") * 7 + 1 + F.col("s_suppkey") % 3).alias("dst")).distinct()
    e = G.undirected(n)
    groups = connected(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select("src").distinct(), "src")
    return G.spectral(e.join(groups, "src").select("group", "src", "dst"), "group")
