"""Queries over per-entity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import windows as W
from .registry import query

E = "user_id"
T = ["ts"]
SORTED = "PARTITION BY user_id ORDER BY ts"


@query(f"SELECT event_id, lag(value) OVER w AS value_lag1, value - lag(value) OVER w AS value_diff, lag(value, 3) OVER w AS value_lag3, value - lag(value, 3) OVER w AS value_diff_lag3 FROM events WINDOW w AS ({SORTED})", "value_lag1 value_diff value_lag3 value_diff_lag3")
def entity_diff(read):
    return W.shift_diff(read("events"), E, T, ["value"], (1, 3)).select("event_id", "value_lag1", "value_diff", "value_lag3", "value_diff_lag3")


@query(
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS rank_avg,
         (rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey) AS rank_pct,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS INTEGER) AS rank_ord FROM lineitem""",
    "rank_avg rank_pct",
)
def group_rank(read):
    return W.group_rank(read("lineitem"), "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank_avg", "rank_pct", "rank_ord")


@query(
    """SELECT a.event_id, (count(*) FILTER (b.value < a.value) + (count(*) FILTER (b.value = a.value) + 1) / 2) / count(*) AS causal_rank
       FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id""",
    "causal_rank",
)
def causal_rank(read):
    return W.causal_rank(read("events").select("event_id", "user_id", "ts", "value"), E, T, "value").select("event_id", "causal_rank")


@query(
    f"""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS cum_count, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS INTEGER) AS cum_count_reverse,
        sum(value) OVER w AS cum_sum, max(value) OVER w AS cum_max FROM events WINDOW w AS ({SORTED})""",
    "cum_sum cum_max",
)
def cumulative_counts(read):
    return W.cumulative_counts(read("events"), E, T, "value").select("event_id", "cum_count", "cum_count_reverse", "cum_sum", "cum_max")


@query(
    f"""SELECT event_id, {", ".join(f"CASE WHEN count(value) OVER w >= 3 THEN {s}(value) OVER w END AS value_{n}_5" for n, s in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median")))}
        FROM events WINDOW w AS ({SORTED} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "value_mean_5 value_sum_5 value_std_5 value_min_5 value_max_5 value_median_5",
)
def rolling_reduce(read):
    return W.rolling(read("events"), E, T, "value", 5, 3).drop("user_id", "ts", "event_type", "value", "props")


@query(
    f"""WITH m AS (SELECT event_id, user_id, ts, avg(value) OVER ({SORTED} ROWS 2 PRECEDING) AS ma_3, avg(value) OVER ({SORTED} ROWS 6 PRECEDING) AS ma_7, avg(value) OVER ({SORTED} ROWS 13 PRECEDING) AS ma_14 FROM events),
        d AS (SELECT *, ma_3 - ma_7 AS ma_diff_3_7, ma_3 - ma_14 AS ma_diff_3_14, ma_7 - ma_14 AS ma_diff_7_14 FROM m)
        SELECT event_id, ma_diff_3_7, ma_diff_3_14, ma_diff_7_14 FROM d""",
    "ma_diff_3_7 ma_diff_3_14 ma_diff_7_14",
)
def ma_crossover(read):
    return W.ma_crossover(read("events"), E, T, "value", (3, 7, 14)).select("event_id", "ma_diff_3_7", "ma_diff_3_14", "ma_diff_7_14")


@query(
    f"""WITH a AS (SELECT *, 2 * avg(value) OVER ({SORTED} ROWS 7 PRECEDING) - avg(value) OVER ({SORTED} ROWS 15 PRECEDING) AS raw FROM events),
        b AS (SELECT *, avg(raw) OVER ({SORTED} ROWS 3 PRECEDING) AS hull FROM a) SELECT event_id, hull, value - hull AS hull_dev FROM b""",
    "hull hull_dev",
    9,
)
def hull_moving_average(read):
    return W.hull(read("events"), E, T, "value", 16).select("event_id", "hull", "hull_dev")


def _fold(a):
    return f"list_reduce(list(value) OVER ({SORTED} ROWS UNBOUNDED PRECEDING), lambda acc, x: {a} * x + {1 - a} * acc)"


@query(f"SELECT event_id, {_fold(1 / 3)} AS ewma_0_333333, {_fold(2 / 7)} AS ewma_0_285714 FROM events", "ewma_0_333333 ewma_0_285714")
def ewma(read):
    return W.ewma(read("events"), E, T, "value", (1 / 3, 2 / 7), "event_id")


@query()
def adaptive_ewma(read):
    return W.adaptive_ewma(read("events"), E, T, "value", (0.1, 0.3, 0.5, 0.9))


@query(
    f"""WITH s AS (SELECT event_id, user_id, ts, CAST(event_type = 'view' AS INTEGER) AS s, row_number() OVER w AS rn, coalesce(lag(event_type) OVER w = 'view', false) AS was FROM events WINDOW w AS ({SORTED})),
        r AS (SELECT *, sum(CASE WHEN s = 1 AND NOT was THEN 1 ELSE 0 END) OVER w AS act, max(CASE WHEN s = 0 THEN rn END) OVER w AS off, max(CASE WHEN s = 1 THEN rn END) OVER w AS on_ FROM s WINDOW w AS ({SORTED}))
        SELECT event_id, CAST(act AS BIGINT) AS activations, CAST(CASE WHEN act > 0 THEN CASE WHEN s = 1 THEN rn - coalesce(off, 0) ELSE 0 END END AS INTEGER) AS possession,
          CAST(CASE WHEN act > 0 THEN CASE WHEN s = 0 THEN rn - on_ ELSE 0 END END AS INTEGER) AS cancellation FROM r"""
)
def state_duration(read):
    return W.state_duration(read("events"), E, T, F.col("event_type") == "view").select("event_id", "activations", "possession", "cancellation")


@query(
    f"""WITH a AS (SELECT event_id, user_id, ts, event_type, CASE WHEN lag(event_type) OVER ({SORTED}) = event_type THEN 0 ELSE 1 END AS new FROM events),
        b AS (SELECT *, sum(new) OVER ({SORTED}) AS run FROM a), c AS (SELECT user_id, run, min(event_type) AS s, count(*) AS n FROM b GROUP BY 1, 2),
        d AS (SELECT user_id, run, coalesce(lag(s) OVER w, '-1') AS state_1, coalesce(lag(s, 2) OVER w, '-1') AS state_2, coalesce(lag(n) OVER w, 0) AS length_1, coalesce(lag(n, 2) OVER w, 0) AS length_2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY run))
        SELECT event_id, state_1, state_2, length_1, length_2 FROM b JOIN d USING (user_id, run)"""
)
def state_history(read):
    return W.state_history(read("events"), E, T, "event_type").select("event_id", "state_1", "state_2", "length_1", "length_2")


@query()
def merge_short_states(read):
    return W.merge_short_states(read("events"), E, T, "event_type", "event_id")


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
       m AS (SELECT o_custkey, min_by(o_orderpriority, (-n, o_orderpriority)) AS mode FROM c GROUP BY 1)
       SELECT o_orderkey, CAST(o_orderpriority = mode AS INTEGER) AS mode_match, CAST(row_number() OVER w - 1 AS INTEGER) AS occurrence,
         date_diff('day', lag(o_orderdate) OVER w, o_orderdate) * 86400.0 AS gap
       FROM orders JOIN m USING (o_custkey) WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""",
    "gap",
)
def same_value_features(read):
    return W.same_value_features(read("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_orderdate").select("o_orderkey", "mode_match", "occurrence", "gap")


@query(
    f"""WITH a AS (SELECT *, CAST(event_id % 7 AS DOUBLE) AS x FROM events), b AS (SELECT event_id, user_id, ts, lag(x) OVER ({SORTED}) AS x, lag(value) OVER ({SORTED}) AS y FROM a)
        SELECT event_id, CASE WHEN isfinite(c) THEN c END AS corr_x FROM (SELECT event_id, CASE WHEN count(y) OVER w > 2 THEN corr(x, y) OVER w END AS c FROM b WINDOW w AS ({SORTED} ROWS 11 PRECEDING))""",
    "corr_x",
)
def rolling_correlation(read):
    e = read("events").withColumn("x", (F.col("event_id") % 7).cast("double"))
    out = W.rolling_target_correlation(e, E, T, ["x"], "value", 12)
    n = F.count("_lagged").over(W.by(E, T).rowsBetween(-11, 0))
    out = out.withColumn("_lagged", F.lag("value").over(W.by(E, T)))
    return out.select("event_id", F.when(n > 2, F.col("corr_x")).alias("corr_x"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS i FROM orders)
       SELECT o_custkey, max(o_totalprice) FILTER (i = 0) AS o_totalprice_lag0, max(o_totalprice) FILTER (i = 1) AS o_totalprice_lag1, max(o_totalprice) FILTER (i = 2) AS o_totalprice_lag2,
         avg(o_totalprice) FILTER (i >= 3) AS o_totalprice_older_mean, count(o_totalprice) FILTER (i >= 3) AS o_totalprice_older_count,
         CAST(date_diff('day', max(o_orderdate) FILTER (i = 1), max(o_orderdate) FILTER (i = 0)) AS DOUBLE) AS gap_0, CAST(date_diff('day', max(o_orderdate) FILTER (i = 2), max(o_orderdate) FILTER (i = 1)) AS DOUBLE) AS gap_1
       FROM r GROUP BY 1""",
    "o_totalprice_lag0 o_totalprice_lag1 o_totalprice_lag2 o_totalprice_older_mean gap_0 gap_1",
)
def panel_pivot(read):
    return W.panel_pivot(read("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 3, "o_orderdate")


@query(
    """WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i, count(*) OVER (PARTITION BY o_custkey) AS d FROM orders),
       x AS (SELECT o_custkey, v * pow((d - i + 1) / d, 1.5) AS x, pow((d - i + 1) / d, 1.5) AS w FROM r)
       SELECT o_custkey, sum(x) / sum(w) AS wmean, sum(x) AS wsum, min(x) AS wmin, max(x) AS wmax, stddev_samp(x) AS wstd FROM x GROUP BY 1""",
    "wmean wsum wmin wmax wstd",
    4,
)
def recency_weighted(read):
    return W.recency_aggregate(read("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "poly", 1.5)


@query(
    f"""WITH c AS (SELECT user_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events), l AS (SELECT user_id, c, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c WINDOW w AS ({SORTED})),
        s AS (SELECT user_id, count(*) AS n, sum(c * c) AS v, sum(c * c1) AS p1, sum(c * c2) AS p2 FROM l GROUP BY 1)
        SELECT user_id, 1 AS lag, p1 / v AS acf, CAST(abs(p1 / v) > 1.96 / sqrt(n) AS INTEGER) AS significant FROM s
        UNION ALL SELECT user_id, 2, p2 / v, CAST(abs(p2 / v) > 1.96 / sqrt(n) AS INTEGER) FROM s""",
    "acf",
)
def autocorrelation(read):
    return W.autocorrelation(read("events"), E, T, "value", 2)


@query(
    f"""WITH c AS (SELECT user_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events), l AS (SELECT user_id, c, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM c WINDOW w AS ({SORTED})),
        s AS (SELECT user_id, count(*) AS n, sum(c * c) AS v, unnest([{{'lag': 1, 'p': sum(c * c1)}}, {{'lag': 2, 'p': sum(c * c2)}}, {{'lag': 3, 'p': sum(c * c3)}}]) AS x FROM l GROUP BY 1)
        SELECT x.lag, avg(CAST(abs(x.p / v) > 1.96 / sqrt(n) AS INTEGER)) AS share FROM s GROUP BY 1 HAVING avg(CAST(abs(x.p / v) > 1.96 / sqrt(n) AS INTEGER)) >= 0.02""",
    "share",
)
def lag_consensus(read):
    return W.consensus_lags(read("events"), E, T, "value", 3, 0.02)


@query(
    f"""SELECT event_id, CASE WHEN count(*) OVER w = 10 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) END AS older
        FROM events WINDOW w AS ({SORTED} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "older",
)
def nested_windows(read):
    """The mean of the seven values before the last three, from the means of the last ten and the last three."""
    ten, three = (W.by(E, T).rowsBetween(1 - n, 0) for n in (10, 3))
    older = scalars.nested_mean(F.avg("value").over(ten), 10, F.avg("value").over(three), 3)
    return read("events").select("event_id", F.when(F.count("*").over(ten) == 10, older).alias("older"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT AS bin FROM lineitem)
       SELECT l_orderkey, l_linenumber, bin, avg(l_quantity) OVER (PARTITION BY bin) AS smoothed FROM b""",
    "smoothed",
)
def bin_smooth(read):
    return W.bin_smooth(read("lineitem"), "l_quantity", [10, 20, 30, 40]).select("l_orderkey", "l_linenumber", "bin", "smoothed")


@query()
def change_points(read):
    return W.change_points(read("events"), E, T, "value", penalty=2000.0)


@query()
def density_mode(read):
    return W.density_mode(read("events"), E, T, "value")


@query(
    f"""WITH a AS (SELECT event_id, user_id, row_number() OVER ({SORTED}) - 1 AS i, sum(abs(value)) OVER ({SORTED}) AS c, abs(value) AS v FROM events)
        SELECT a.event_id, min(b.i) AS reaches FROM a LEFT JOIN a b ON a.user_id = b.user_id AND b.i >= a.i AND b.c >= a.c - a.v + 150 - 1e-9 GROUP BY 1"""
)
def cumsum_to_amount(read):
    return W.cumsum_to_amount(read("events").select("event_id", "user_id", "ts", "value"), E, T, "value", 150.0, True).select("event_id", "reaches")


@query()
def best_positions(read):
    return W.best_positions(read("events"), E, T, "value", 0.01)
