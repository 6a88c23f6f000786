"""Streaming twins: windows under a watermark, a keyed running state, and a helper that feeds a table to a query as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir


def windowed(events: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Count and sum by type and window, with a watermark ``late`` behind the newest time. In append and update mode, rows of windows that
    the watermark has passed are dropped; in complete mode no row is."""
    w = F.window("ts", every)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def running_mean(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) after each trigger, from a state of two numbers a user."""

    def step(key, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, mean double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def running_ewma(events: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(user_id, n, ewma) after each trigger: alpha * value + (1 - alpha) * ewma along a user's rows by time, from the first value on. The
    state is two numbers a user; rows that come in a later trigger count as later."""

    def step(key, batches, state: GroupState):
        n, at = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for v in rows["value"].fillna(0).astype(float):
            at, n = (alpha * v + (1 - alpha) * at if n else v), n + 1
        state.update((n, float(at)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ewma": [at]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, ewma double", "n bigint, ewma double", "update", GroupStateTimeout.NoTimeout)


def run_in_turn(tables: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a streaming query in append mode says when it reads the tables one after the other, a trigger each: windows that
    the watermark has passed by the end."""
    spark = tables[0].sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in tables:
        rows.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(tables[0].schema).parquet(f"{root}/in")
        sink = build(source).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def run_batchwise(rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """What a streaming query has said once it has read the table's files: complete results, or each key's last update."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    out, at = f"{root}/out", [0]

    def keep(batch: DataFrame, epoch: int) -> None:
        at[0] = max(at[0], epoch)
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{epoch}")

    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
    q = build(source).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{out}/{at[0]}").drop("_epoch")
    said = spark.read.parquet(*(f"{out}/{i}" for i in range(at[0] + 1)))
    last = said.groupBy(*keys).agg(F.max("_epoch").alias("_epoch"))
    return said.join(last, [*keys, "_epoch"]).drop("_epoch")
