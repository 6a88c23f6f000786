"""As-of joins and leakage-safe aggregates: what a row may know of a history is what came before it.

Both sides are united and sorted once by (key, time); windows then look back. That is one shuffle on the key and no
range join, whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import _cuts, _part, parts_of


def _known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], suffix: str = "", tiebreak: str | None = None) -> DataFrame:
    """``left`` with the values of the latest ``right`` row of the same keys at or before its time.

    The row is matched, not each value, so its null values stay null. Right rows without a time or with a null key match
    nothing. Among right rows of one time, the last by ``tiebreak`` counts. Without keys, time is cut into ranges, and a range's rows
    also see the last right row of the ranges before it: no task holds all rows.
    """
    carried = F.struct(*(F.col(v).alias(f"{v}{suffix}") for v in values), *([F.col(tiebreak).alias("_tie")] if tiebreak else []))
    own = F.struct(*left.columns)
    l_rows = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), own.alias("_l"))
    r_rows = right.where(F.col(on).isNotNull() & _known(by)).select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), carried.alias("_r"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side")] + ([F.col("_r._tie")] if tiebreak else [])
    if by:
        seen = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
    else:
        both = both.withColumn("_part", _part("_t", _cuts(both, "_t", parts_of(both)), dict(both.dtypes)["_t"]))
        ends = both.groupBy("_part").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(*order))).alias("_end"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))  # a row for each part
        seen = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
        found = found.join(F.broadcast(ends), "_part").withColumn("_r", F.coalesce("_r", "_carry"))
    return found.select("_l.*", *(F.when(_known(by) & F.col("_t").isNotNull(), F.col(f"_r.{v}{suffix}")).alias(f"{v}{suffix}") for v in values))


def asof_join_tiers(left: DataFrame, right: DataFrame, on: str, tiers: list[list[str]], value: str, key: str, min_group_size: int = 1, tiebreak: str | None = None) -> DataFrame:
    """As-of join along a chain of coarser keys, of none for all rows: the first tier whose value isn't null and whose group of right rows is large
    enough. Adds ``value`` and ``tier`` (-1: none). ``key`` identifies left rows."""
    out = left
    for i, by in enumerate(tiers):
        sizes = right.groupBy(*by).agg(F.count("*").alias(f"_n{i}"))
        got = asof_join(left.select(key, on, *by), right, on, by, [value], suffix=f"_{i}", tiebreak=tiebreak)
        got = got.join(sizes, by, "left") if by else got.join(F.broadcast(sizes), how="left")  # one row
        out = out.join(got.select(key, F.when(F.col(f"_n{i}") >= min_group_size, F.col(f"{value}_{i}")).alias(f"_v{i}")), key, "left")
    tier = F.lit(-1)
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)).otherwise(tier)
    found = out.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(tiers))))).withColumn("tier", tier)
    return found.drop(*(f"_v{i}" for i in range(len(tiers))))


def _united(history: DataFrame, cutoffs: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    rows = history.select(entity, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_h"))
    asks = cutoffs.select(entity, F.col(time).alias("_t"), F.lit(0).alias("_h"), F.struct(*cutoffs.columns).alias("_q"))
    return asks.unionByName(rows, allowMissingColumns=True)


_AGGS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}


def strict_aggregate(history: DataFrame, cutoffs: DataFrame, entity: str, time: str, value: str, aggs: tuple[str, ...] = ("mean", "count")) -> DataFrame:
    """``cutoffs`` with aggregates of the history strictly before each one's time; null for every one if there is none."""
    before = Window.partitionBy(entity).orderBy("_t", "_h").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_h").over(before)
    cols = [F.when(n > 0, _AGGS[a]("_v").over(before)).alias(f"{value}_{a}") for a in aggs]
    return _united(history, cutoffs, entity, time, value).select("_h", "_q", *cols).where("_h = 0").select("_q.*", *(f"{value}_{a}" for a in aggs))


def lookback_aggregate(history: DataFrame, cutoffs: DataFrame, entity: str, time: str, value: str, seconds: dict[str, int], aggs: tuple[str, ...] = ("sum", "count", "mean")) -> DataFrame:
    """Aggregates over [time - horizon, time) for each named horizon, from frames of their own and not differences of sums."""
    rows = _united(history, cutoffs, entity, time, value).withColumn("_us", F.expr("unix_micros(cast(_t as timestamp))"))
    cols = []
    for name, s in seconds.items():
        frame = Window.partitionBy(entity).orderBy("_us").rangeBetween(-s * 1_000_000, -1)
        cols += [_AGGS[a]("_v").over(frame).alias(f"{value}_{a}_last_{name}") for a in aggs]
    return rows.select("_h", "_q", *cols).where("_h = 0").drop("_h").select("_q.*", *(f"{value}_{a}_last_{n}" for n in seconds for a in aggs))
