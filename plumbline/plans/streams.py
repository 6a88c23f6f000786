"""Queries over streams whose batch versions are known: online regression and drift."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import online
from ..sources.shared import shared_dir
from ..streaming import drift, regression
from ..streaming import windows as stream
from .registry import query

#: y is the value, x a constant and the share of the day; an entity's rows before a row give two sums and a determinant.
REGRESSION = """WITH e AS (SELECT event_id, user_id, ts, value AS y, hour(ts) / 24.0::DOUBLE AS x FROM events),
    s AS (SELECT *, 1.0 + count(y) OVER w AS a, coalesce(sum(x) OVER w, 0) AS b, 0.5 + 0.5 + coalesce(sum(x * x) OVER w, 0) AS d, coalesce(sum(y) OVER w, 0) AS u, coalesce(sum(x * y) OVER w, 0) AS v
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, ((d * u - b * v) + x * (a * v - b * u)) / (a * d - b * b) AS pred_mean, (d - 2 * b * x + a * x * x) / (a * d - b * b) + 1 AS pred_var FROM s)
    SELECT event_id, user_id, pred_mean, pred_var, -0.5 * (ln(2 * pi() * pred_var) + (y - pred_mean) ** 2 / pred_var) AS log_evidence FROM m"""
SHOWN = ("event_id", "user_id", "pred_mean", "pred_var", "log_evidence")


def _rows(read):
    return read("events").select("event_id", "user_id", "ts", F.col("value").alias("y"), F.lit(1.0).alias("one"), (F.hour("ts") / 24.0).alias("x"))


@query(REGRESSION, "pred_mean pred_var log_evidence", 4)
def online_regression(read):
    return online.online_regression(_rows(read), "user_id", ["ts", "event_id"], "y", ["one", "x"]).select(*SHOWN)


@query(REGRESSION, "pred_mean pred_var log_evidence", 4)
def stream_regression(read):
    """Thirds of the month, each read by a new start of the stream from what the last one left."""
    rows = _rows(read)
    regression.with_rocksdb(rows.sparkSession)
    day = F.dayofmonth("ts")
    thirds = [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]
    return stream.run_in_turn(thirds, lambda r: regression.running_regression(r, "user_id", ["ts", "event_id"], "y", ["one", "x"])).select(*SHOWN)


def _weeks(read):
    """Values by week; from the third week on they are half as large again."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    return read("events").select(week.alias("week"), F.when(week >= 2, F.col("value") * 1.5).otherwise(F.col("value")).alias("value"), F.hour("ts").cast("double").alias("hour"))


def _watched(read, relearn: bool):
    rows = _weeks(read)
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    reference = rows.where("week = 0")
    for week in range(1, 5):  # each by a new monitor, as after a restart
        rows.where(F.col("week") == week).write.mode("append").parquet(f"{root}/in")
        monitor = drift.DriftMonitor(reference, ["value", "hour"], f"{root}/monitor", relearn=relearn)
        monitor.watch(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    return monitor.verdicts()


_EDGES = ", ".join(f"quantile_cont({{0}}, {i / 10})" for i in range(1, 10))
_LONG = " UNION ALL ".join(f"SELECT week, '{c}' AS c, {c} AS v FROM r" for c in ("value", "hour"))


@query(
    f"""WITH r AS (SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS week, CASE WHEN day(ts) > 14 THEN value * 1.5 ELSE value END AS value, CAST(hour(ts) AS DOUBLE) AS hour FROM events),
        l AS ({_LONG}), e AS (SELECT c, list_distinct([{_EDGES.format("v")}]) AS edges FROM l WHERE week = 0 GROUP BY c),
        b AS (SELECT week, c, len(edges) + 1 AS bins, len(list_filter(edges, lambda x: x <= v)) AS bin, count(*) AS n FROM l JOIN e USING (c) GROUP BY ALL),
        f AS (SELECT DISTINCT w.week, e.c, len(edges) + 1 AS bins, unnest(range(len(edges) + 1)) AS bin FROM e, (SELECT DISTINCT week FROM r) w),
        h AS (SELECT f.week, f.c, f.bins, f.bin, coalesce(b.n, 0) AS n, sum(coalesce(b.n, 0)) OVER (PARTITION BY f.week, f.c) AS total FROM f LEFT JOIN b USING (week, c, bin)),
        p AS (SELECT week, c, bin, total, (n + 0.5) / (total + 0.5 * bins) AS p FROM h)
        SELECT c AS "column", CAST(any_value(x.total) AS BIGINT) AS n, sum((x.p - y.p) * ln(x.p / y.p)) AS psi, sum((x.p - y.p) * ln(x.p / y.p)) > 0.25 AS drifted, -1 AS reference, x.week - 1 AS batch
        FROM p x JOIN p y USING (c, bin) WHERE y.week = 0 AND x.week > 0 GROUP BY c, x.week""",
    "psi",
)
def stream_drift(read):
    return _watched(read, relearn=False)


@query()
def stream_drift_relearned(read):
    """The first week that drifts becomes the reference of those after it."""
    return _watched(read, relearn=True)
