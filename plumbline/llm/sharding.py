"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the id, row number). A size-weighted sample of these
keys gives quantile boundaries of many narrow ranges; the exact bytes of every range are summed, ranges
that came out overfull are sampled again and subdivided until none of several rows is left (a row larger than
a range gets one of its own). Groups of equal texts that take several ranges go to the emptiest shards, whole as long as a
shard can hold them; runs of the other ranges, in their order, fill the shards up to near-equal bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def _packed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Both signed keys as 16 bytes whose order is that of the pair."""
    both = np.stack([k1, k2], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _boundaries(sample: pd.DataFrame, n_ranges: int, whole: bool = True) -> set[tuple[int, int]]:
    """Quantile boundaries of a weighted key sample.

    A boundary inside a group of equal first keys moves to the group's start, unless the group spans a
    whole range or more; such a group gets ranges of its own. If not ``whole``, no boundary moves.
    """
    if not len(sample):
        return set()
    s = sample.sort_values(["k1", "k2"], kind="stable")
    k1, k2, w = s["k1"].to_numpy(), s["k2"].to_numpy(), s["w"].to_numpy().cumsum()
    at = np.unique(np.searchsorted(w, w[-1] * np.arange(1, n_ranges) / n_ranges, side="left"))
    picks = [(int(k1[i]), int(k2[i])) for i in at]
    inside, out = Counter(a for a, _ in picks), set()
    for a, b in picks:
        out.add((a, LOWEST))
        if inside[a] > 2 or not whole:
            out.add((a, b))
            if a < HIGHEST:
                out.add((a + 1, LOWEST))
    return out


def _apart(large: pd.DataFrame) -> set[tuple[int, int]]:
    """Boundaries before each of these rows and after each group of equal texts, so that each row has a range of its own."""
    keys = [(int(a), int(b)) for a, b in zip(large["k1"], large["k2"], strict=True)]
    return {*keys, *((a + 1, LOWEST) for a, _ in keys if a < HIGHEST)}


def _range_of(bounds: list[tuple[int, int]]):
    edges = _packed(np.array([a for a, _ in bounds], np.int64), np.array([b for _, b in bounds], np.int64)) if bounds else np.array([], "S16")

    @F.pandas_udf("int")
    def of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _packed(k1.to_numpy(), k2.to_numpy()), side="right").astype(np.int32))

    return of("k1", "k2")


def _placed(sums: list[tuple[int, int, int, int | None]], n_shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, rows before it in the shard) of (range, bytes, rows, the group that the range is part of) in order.

    A group of several ranges that fits into an even shard is placed whole, the largest first, where most room is left. The
    other ranges fill the rooms from the first shard to the last, in the order of the keys.
    """
    total = sum(b for _, b, _, _ in sums)
    room, groups = [total / n_shards] * n_shards, {}
    for i, (*_, g) in enumerate(sums):
        if g is not None:
            groups.setdefault(g, []).append(i)
    size = {g: sum(sums[i][1] for i in own) for g, own in groups.items() if len(own) > 1}
    shard_of: dict[int, int] = {}
    for g in sorted((g for g in size if size[g] <= total / n_shards), key=lambda g: (-size[g], g)):
        s = max(range(n_shards), key=lambda x: room[x])
        room[s] -= size[g]
        shard_of |= dict.fromkeys(groups[g], s)
    ends = np.cumsum(np.maximum(room, 0)).tolist()
    rest = [i for i in range(len(sums)) if i not in shard_of]
    scale, before = ends[-1] / max(1, sum(sums[i][1] for i in rest)), 0.0
    for i in rest:
        shard_of[i] = min(n_shards - 1, bisect_right(ends, (before + sums[i][1] / 2) * scale))
        before += sums[i][1]
    slots, out = [0] * n_shards, []
    for i, (r, _, n, _) in enumerate(sums):
        out.append((r, shard_of[i], slots[shard_of[i]]))
        slots[shard_of[i]] += n
    return out


def shard(
    documents: DataFrame,
    n_shards: int = 24,
    ranges_per_shard: int = 128,
    samples_per_range: int = 8,
) -> DataFrame:
    """Put every row in one of ``n_shards`` shards of near-equal bytes (UTF-8 bytes of the text plus 8).

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in each shard) and a null
    grown_shard. Equal texts share a shard, unless they take more than an even shard's bytes. A null text has size 8 and a null text_crc32; null ids and repeated rows are ordinary rows;
    an empty table gives no rows; other columns are ignored. To the driver go the sample (about
    n_shards * ranges_per_shard * samples_per_range keys), the keys of rows larger than a range (fewer than there are
    ranges) and one sum for each range, whatever the input's size.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shard")
    rows = scratch.keep(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("k2"),
            F.xxhash64("doc_id").alias("k3"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    n_ranges = n_shards * ranges_per_shard
    fair = total / n_ranges

    def drawn(part: DataFrame, per_range: int, turn: int = 0) -> pd.DataFrame:
        """Keys drawn with a chance in proportion to their size; another turn draws others."""
        p = F.col("size") * (per_range / fair)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(11 + turn), "k1", "k2"), 11) / float(1 << 53)
        return part.where(u < p).select("k1", "k2", F.greatest(p, F.lit(1.0)).alias("w")).toPandas()

    bounds, turn = sorted(_boundaries(drawn(rows, samples_per_range), n_ranges)), 0
    while True:  # ends with the sums of the last bounds
        dealt = rows.withColumn("r", _range_of(bounds))
        found = dealt.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi")).collect()
        sums = {x["r"]: (x["bytes"], x["n"], x["lo"] if x["lo"] == x["hi"] else None) for x in found}
        over = [r for r, (b, n, _) in sums.items() if b > 2 * fair and n > 1]
        if not over:
            break
        turn += 1
        part = dealt.where(F.col("r").isin(over))
        large = _apart(part.where(F.col("size") > fair).select("k1", "k2").toPandas())
        more, n_more = drawn(part, 4 * samples_per_range, turn), max(2, round(2 * sum(sums[r][0] for r in over) / fair))
        grown = sorted({*bounds, *large, *_boundaries(more, n_more)})
        if grown == bounds:  # what is left is a group of copies, to be split inside
            grown = sorted({*bounds, *_boundaries(more, n_more, whole=False)})
        if grown == bounds:
            break
        bounds = grown
    placed = _placed([(r, *sums[r]) for r in sorted(sums)], n_shards)
    where = F.broadcast(spark.createDataFrame(placed, "r int, shard int, base bigint"))  # a row for each range
    spot = F.expr("row_number() over (partition by r order by k1, k3, k2)")
    return (
        dealt.withColumn("spot", spot)
        .join(where, "r")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("spot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
