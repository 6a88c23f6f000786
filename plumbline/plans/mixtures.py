"""Queries over shrunk covariances, mixtures and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixtures, tables
from .registry import query

#: Two columns' moments about their means, and the intensity of shrinkage.
_MOMENTS = """m AS (SELECT avg(l_quantity) AS a, avg(l_discount * 100) AS b, count(*) AS n FROM lineitem),
    d AS (SELECT l_orderkey, l_linenumber, l_quantity - a AS x, l_discount * 100 - b AS y, n FROM lineitem, m),
    s AS (SELECT sum(x * x) / any_value(n) AS xx, sum(x * y) / any_value(n) AS xy, sum(y * y) / any_value(n) AS yy, sum((x * x + y * y) ** 2) / any_value(n) AS q, any_value(n) AS n FROM d),
    f AS (SELECT *, (xx + yy) / 2 AS mu, ((xx - (xx + yy) / 2) ** 2 + (yy - (xx + yy) / 2) ** 2 + 2 * xy * xy) / 2 AS spread, greatest((q - xx * xx - yy * yy - 2 * xy * xy) / (2 * n), 0) AS noise FROM s),
    c AS (SELECT (1 - k) * xx + k * mu AS xx, (1 - k) * xy AS xy, (1 - k) * yy + k * mu AS yy FROM (SELECT *, least(noise, spread) / spread AS k FROM f))"""


@query(f"WITH {_MOMENTS} SELECT l_orderkey, l_linenumber, sqrt((yy * x * x - 2 * xy * x * y + xx * y * y) / (xx * yy - xy * xy)) AS distance FROM d, c", "distance")
def mahalanobis_distance(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("percent"))
    return rows.select("l_orderkey", "l_linenumber", mixtures.fit_mahalanobis(rows, ["l_quantity", "percent"]).distance().alias("distance"))


@query(places=3)
def mixture_memberships(read):
    rows = read("orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.dayofyear("o_orderdate").alias("day"))
    fit = mixtures.fit_mixture(rows, ["price", "day"], range(1, 3), rounds=500, tol=1e-4)
    return rows.select("o_orderkey", F.array_max(fit.memberships()).alias("share"), F.lit(len(fit.weights)).alias("components"))


@query(
    """WITH l AS (SELECT event_id AS src, unnest([{'d': lag(event_id, 1) OVER w, 'b': 1}, {'d': lag(event_id, 2) OVER w, 'b': 2}]) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT src, x.d AS dst, CAST(x.b AS INTEGER) AS back FROM l WHERE x.d IS NOT NULL"""
)
def table_function_edges(read):
    e = read("events")
    tables.register(e.sparkSession)
    return e.sparkSession.sql("SELECT * FROM recent_edges(TABLE(SELECT user_id, ts, event_id FROM {e}) PARTITION BY user_id ORDER BY (ts, event_id), 'event_id', 2)", e=e)


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
       SELECT event_type AS state, arg_min(event_id, ts) AS first_at, arg_max(event_id, ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, event_type, g"""
)
def table_function_runs(read):
    e = read("events")
    tables.register(e.sparkSession)
    return e.sparkSession.sql("SELECT * FROM runs(TABLE(SELECT user_id, ts, event_id, event_type FROM {e}) PARTITION BY user_id ORDER BY (ts, event_id), 'event_type', 'event_id')", e=e)
