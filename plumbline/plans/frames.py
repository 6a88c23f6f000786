"""Queries over time windows, target transforms, rank aggregation, calendars, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames as P
from ..sources import files
from ..sources.shared import shared_dir
from ..streaming import windows as stream
from .registry import query

_BUCKET = "time_bucket(INTERVAL {0}, ts, TIMESTAMP '1970-01-01')"


@query(f"SELECT event_type, {_BUCKET.format('1 DAY')} AS start, count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2", "total mean least most", 5)
def tumbling(read):
    return P.time_windows(read("events"), "ts", ["event_type"], "value", "1 day")


@query(
    f"""SELECT event_type, s AS start, count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most
        FROM (SELECT *, unnest([{_BUCKET.format('12 HOUR')}, {_BUCKET.format('12 HOUR')} - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2""",
    "total mean least most",
    5,
)
def sliding(read):
    return P.time_windows(read("events"), "ts", ["event_type"], "value", "12 hours", "1 day")


@query(
    """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, sum(value) AS total FROM b GROUP BY user_id, s""",
    "total",
)
def session_windows(read):
    return P.sessions(read("events"), "ts", ["user_id"], "value", "6 hours")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - (regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity + regr_intercept(l_extendedprice, l_quantity) OVER ()) AS residual, ln(l_extendedprice) - ln(l_quantity) AS log_ratio, asinh((l_extendedprice - 30000) / 1000) AS scaled FROM lineitem", "residual log_ratio scaled", 5)
def target_transforms(read):
    rows = read("lineitem")
    y, b = F.col("l_extendedprice"), F.col("l_quantity")
    p = P.fit_linear(rows, "l_extendedprice", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", P.linear_forward(y, b, p).alias("residual"), P.log_ratio_forward(y, b).alias("log_ratio"), P.asinh_forward(y, 30000.0, 1000.0).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS linear, l_extendedprice AS log_ratio, l_extendedprice AS scaled FROM lineitem", "linear log_ratio scaled", 4)
def transform_inverses(read):
    rows = read("lineitem")
    y, b = F.col("l_extendedprice"), F.col("l_quantity")
    p = P.fit_linear(rows, "l_extendedprice", "l_quantity")
    back = [P.linear_inverse(P.linear_forward(y, b, p), b, p), P.log_ratio_inverse(P.log_ratio_forward(y, b), b), P.asinh_inverse(P.asinh_forward(y, 30000.0, 1000.0), 30000.0, 1000.0)]
    return rows.select("l_orderkey", "l_linenumber", *(v.alias(n) for v, n in zip(back, ("linear", "log_ratio", "scaled"), strict=True)))


@query("SELECT o_orderkey, o_totalprice - 2 * lag(o_totalprice) OVER w + lag(o_totalprice, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "second")
def second_difference(read):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    y = F.col("o_totalprice")
    return read("orders").select("o_orderkey", P.second_difference(y, F.lag(y).over(w), F.lag(y, 2).over(w)).alias("second"))


@query(
    """WITH p AS (SELECT unnest([4, 5, 7, 12, 24, 52]) AS p), r AS (SELECT p, (date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) % p) AS phase, avg(o_totalprice) AS mean, sum(o_totalprice * o_totalprice) - count(*) * pow(avg(o_totalprice), 2) AS v FROM orders, p GROUP BY 1, 2),
       b AS (SELECT p FROM r GROUP BY p ORDER BY sum(v), p LIMIT 1) SELECT CAST(p AS INTEGER) AS period, CAST(phase AS BIGINT) AS phase, mean FROM r JOIN b USING (p)""",
    "mean",
    4,
)
def seasonal_means(read):
    day = F.expr("datediff(cast(o_orderdate as date), date '1995-01-01')").cast("long")
    period, means = P.fit_seasonal(read("orders"), day, "o_totalprice")
    return means.select(F.lit(period).alias("period"), "phase", "mean")


@query("SELECT o_orderkey, (count(*) OVER (ORDER BY o_totalprice) - 0.5) / count(*) OVER () AS u FROM orders", "u", 9)
def rank_ecdf(read):
    return P.rank_ecdf(read("orders"), "o_totalprice").select("o_orderkey", "u")


@query()
def gaussian_copula(read):
    return P.rank_ecdf(read("orders"), "o_totalprice").select("o_orderkey", P.normal_score(F.col("u")).alias("z"))


_SCORES = "(SELECT year(o_orderdate) AS task, o_orderpriority AS model, sum(o_totalprice) AS score FROM orders GROUP BY 1, 2)"


def scores(read):
    return read("orders").groupBy(F.year("o_orderdate").alias("task"), F.col("o_orderpriority").alias("model")).agg(F.sum("o_totalprice").alias("score"))


@query(
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY task ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY task) AS n, max(score) OVER (PARTITION BY task) AS best FROM {_SCORES})
        SELECT model, avg(score) AS mean, exp(avg(ln(score))) AS geometric, CAST(sum((score = best)::INT) AS BIGINT) AS wins, CAST(sum(n - place) AS BIGINT) AS borda, sum(1 / place) AS dowdall, max(best - score) AS worst_gap, avg(best - score) AS gap FROM p GROUP BY 1""",
    "mean geometric dowdall worst_gap gap",
    3,
)
def borda_dowdall(read):
    return P.positional(scores(read))


@query(
    f"""WITH s AS {_SCORES}, d AS (SELECT a.model, b.model AS other, sum((a.score > b.score)::INT) - sum((a.score < b.score)::INT) AS m FROM s a JOIN s b ON a.task = b.task AND a.model <> b.model GROUP BY 1, 2)
        SELECT model, CAST(sum(sign(m)) AS BIGINT) AS copeland, CAST(max(greatest(-m, 0)) AS BIGINT) AS minimax, CAST(min(m) > 0 AS INTEGER) AS condorcet FROM d GROUP BY 1"""
)
def copeland_minimax(read):
    return P.pairwise(scores(read))


@query()
def baldwin(read):
    s = scores(read)
    return s.sparkSession.createDataFrame([(m,) for m in P.baldwin(s)], "model string")


@query(f"SELECT model, sum(1 / (60 + r)) AS rrf FROM (SELECT model, row_number() OVER (PARTITION BY task ORDER BY score DESC, model) AS r FROM {_SCORES}) GROUP BY 1", "rrf", 9)
def rrf(read):
    return P.reciprocal_rank_fusion(scores(read))


@query(f"SELECT model, avg(p) AS percentile FROM (SELECT model, count(*) OVER (PARTITION BY task ORDER BY score) / count(*) OVER (PARTITION BY task) AS p FROM {_SCORES}) GROUP BY 1", "percentile")
def percentile_stack(read):
    return P.percentile_stack(scores(read))


@query(
    """WITH h AS (SELECT unnest([DATE '1997-12-25', DATE '1998-01-01', DATE '1998-12-25']) AS h), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
       SELECT o_orderkey, CAST(d IN (SELECT h FROM h) AS INTEGER) AS holiday, CAST(d + 1 IN (SELECT CAST(h AS TIMESTAMP) FROM h) AS INTEGER) AS eve, CAST(d - (SELECT max(h) FROM h WHERE h <= d) AS INTEGER) AS since, CAST((SELECT min(h) FROM h WHERE h >= d) - d AS INTEGER) AS until FROM o"""
)
def holiday_calendar(read):
    return P.holiday_features(read("orders"), "o_orderdate", ["1997-12-25", "1998-01-01", "1998-12-25"], "o_orderkey")


@query(
    """WITH b AS (SELECT user_id, date_trunc('day', ts) AS d, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c FROM events GROUP BY 1, 2)
       SELECT user_id, strftime(d, '%Y-%m-%d') AS d, c / nullif(o, 0) - 1 AS body, (h - l) / nullif(o, 0) AS range, o / nullif(lag(c) OVER (PARTITION BY user_id ORDER BY d), 0) - 1 AS gap FROM b""",
    "body range gap",
    5,
)
def price_bars(read):
    bars = read("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"))
    return P.price_ratios(bars, "user_id", ["d"], "o", "h", "l", "c").select("user_id", F.col("d").cast("string").alias("d"), "body", "range", "gap")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25", "o_totalprice")
def tail_scan(read):
    return files.tail(read("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 25)


@query("SELECT l_orderkey, l_linenumber, CAST(l_discount AS FLOAT) AS l_discount, CASE WHEN l_tax = 0 THEN -1.0 ELSE l_tax END::FLOAT AS tax FROM lineitem", "l_discount tax")
def column_scan(read):
    """Four columns of a table that has a null for no tax."""
    path = f"{shared_dir(read.spark)}/scan-{uuid.uuid4().hex}"
    read("lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0))).write.parquet(path)
    return files.read_columns(read.spark, path, ["l_orderkey", "l_linenumber", "l_discount", "tax"], single=True, fill=-1.0)


@query("SELECT 'o_orderstatus' AS target, 'classification' AS task UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) <= 50 THEN 'classification' ELSE 'regression' END FROM orders")
def inferred_tasks(read):
    path = f"{read.folder}/orders.parquet"
    return read.spark.createDataFrame([(c, files.task_of(read.spark, path, c)) for c in ("o_orderstatus", "o_totalprice")], "target string, task string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'a \"quoted, name\"', 1")
def csv_round_trip(read):
    path = f"{shared_dir(read.spark)}/csv-{uuid.uuid4().hex}"
    rows = read("nation").unionByName(read("nation").limit(1).select(F.lit(100).alias("n_nationkey"), F.lit('a "quoted, name"').alias("n_name"), F.lit(1).alias("n_regionkey")))
    files.write_csv(rows, path)
    return files.read_csv(read.spark, path, rows.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def constant_columns(read):
    n = read("nation").withColumn("always", F.lit(1)).withColumn("never", F.lit(None).cast("string"))
    return files.drop_constant(n.select("n_nationkey", "n_name", "always", "never"))


@query(
    """WITH h AS (SELECT l_returnflag AS k1, l_linestatus AS k2, l_linenumber AS k3, l_suppkey % 5 AS k4, l_quantity AS metric, l_linenumber AS n_obs, l_shipdate AS ts FROM lineitem),
       x AS (SELECT *, unnest(range(n_obs)) FROM h) SELECT k1, k2, k3, k4, median(metric) AS metric, count(*) AS n_obs, max(ts) AS ts FROM x GROUP BY ALL""",
    "metric",
)
def store_fold(read):
    h = read("lineitem").select(F.col("l_returnflag").alias("k1"), F.col("l_linestatus").alias("k2"), F.col("l_linenumber").alias("k3"), (F.col("l_suppkey") % 5).alias("k4"), F.col("l_quantity").alias("metric"), F.col("l_linenumber").alias("n_obs"), F.col("l_shipdate").alias("ts"))
    return files.fold_observations(h, ["k1", "k2", "k3", "k4"], ["metric"])


@query("SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings", places=4)
def vector_text(read):
    lines = read("embeddings").select(F.concat_ws(" ", F.concat(F.lit("v"), "vec_id"), F.transform("embedding", lambda x: x.cast("string"))).alias("value"))
    v = files.parse_vectors(lines)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("word", F.size("vector").alias("width"), total.alias("total"), F.col("vector")[0].cast("double").alias("first"))


@query()
def synthetic_source(read):
    return files.synthetic(read("region").sparkSession, 1000, 3, seed=1)


@query(f"SELECT event_type, {_BUCKET.format('1 DAY')} AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "total", 5)
def stream_windows(read):
    return stream.run_batchwise(read("events"), stream.windowed)


@query("SELECT user_id, count(*) AS n, sum(value) / count(*) AS mean FROM events GROUP BY 1", "mean", 9)
def stream_running_mean(read):
    return stream.run_batchwise(read("events"), stream.running_mean, "update", keys=["user_id"])


@query(
    f"""SELECT event_type, {_BUCKET.format('1 DAY')} AS start, count(*) AS n, sum(value) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1, 2
        HAVING {_BUCKET.format('1 DAY')} + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""",
    "total",
    5,
)
def stream_late_rows(read):
    """Rows before the eleventh come after all others, so later than the watermark allows: they are dropped."""
    e, cut = read("events"), F.lit("2024-01-11").cast("timestamp_ntz")
    return stream.run_in_turn([e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut)], stream.windowed)


@query()
def stream_ewma(read):
    return stream.run_batchwise(read("events"), stream.running_ewma, "update", keys=["user_id"])
