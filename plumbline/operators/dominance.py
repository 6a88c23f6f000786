"""Counts of rows that are smaller in two columns, and positions in groups of any size, by ranges.

Rows are sorted by range and cut into blocks of a bounded number of rows. A pair of rows is told apart within a block of the one
order, within a block of the other, or by the blocks' numbers, which are points of the same question but far fewer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept_table

#: A block's rows, as bits of a row's number.
BLOCK_BITS = 16


def _ranged(df: DataFrame, order: list[Column], bits: int, at: str, block: str) -> DataFrame:
    """``df`` kept in order, with a number that ascends along it and the block that the number is in."""
    parts = max(1, -(-df.count() >> bits))
    out = df.repartitionByRange(parts, *order) if parts > 1 else df.repartition(1)
    return kept_table(out.sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).withColumn(block, F.shiftright(at, bits)))


def group_name(groups: list[str]) -> Column:
    """Groups as one string; nulls are a value."""
    return F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")


def positions(df: DataFrame, groups: list[str], order: list[str], name: str, bits: int | None = None) -> DataFrame:
    """``df`` with the row's number in its group, from 1. A group of any size is many tasks' work; rows of equal order are numbered as
    they come."""
    bits = BLOCK_BITS if bits is None else bits
    rows = _ranged(df.withColumn("_pg", group_name(groups)), [F.asc(c) for c in ("_pg", *order)], bits, "_pa", "_pb")
    own = F.row_number().over(Window.partitionBy("_pb", "_pg").orderBy("_pa"))
    sizes = rows.groupBy("_pg", "_pb").agg(F.count("*").alias("_pe"))
    earlier = F.coalesce(F.sum("_pe").over(Window.partitionBy("_pg").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    sizes = sizes.select("_pg", "_pb", earlier.alias("_pe"))
    return rows.withColumn("_pi", own).join(sizes, ["_pg", "_pb"]).select(*df.columns, (F.col("_pe") + F.col("_pi")).alias(name))


def smaller_before(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the weights of earlier rows of its group whose value is smaller; groups stand together. Merge counting: at each bit
    of the place, rows of a right half see those of the left half that come before them by value."""
    n = len(value)
    order = np.lexsort([-np.arange(n), value, group])  # of equal values the later row comes first, so that none counts
    w, out = weight[order].astype(np.int64), np.zeros(n, np.int64)
    for b in range(max(n - 1, 0).bit_length()):
        node = order >> (b + 1)
        by = np.argsort(node, kind="stable")
        left = np.where((order[by] >> b) & 1 == 0, w[by], 0)
        total = np.cumsum(left)
        first = np.searchsorted(node[by], node[by])
        seen = total - left - (total[first] - left[first])
        right = (order[by] >> b) & 1 == 1
        out[order[by][right]] += seen[right]
    start = np.searchsorted(group, group)
    return out - (np.cumsum(weight) - weight)[start]  # all of earlier groups came before


def dominated(points: DataFrame, x: list[str], y: str, weight: str, bits: int | None = None) -> DataFrame:
    """``points`` (_g string, columns x, number y, weight; each point once, none null) with ``below``: the weight of the group's points
    that are smaller in x and in y.

    In the order of (x, y descending) a point's smaller ones in both are the earlier ones that are smaller in y. Those of its own block
    are counted there. For the others x means the number of the block: in the order of (y, block descending) they are the
    earlier ones of a smaller block; again those of the same block of this order are counted there, and pairs of points that
    differ in both blocks by the blocks' totals.
    """
    bits = BLOCK_BITS if bits is None else bits
    xb, yb = f"_x{bits}", f"_y{bits}"
    a = _ranged(points, [F.asc("_g"), *(F.asc(c) for c in x), F.desc(y)], bits, "_at", xb)

    def count_in(at: str, value: str):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(at)
            change = (g["_g"] != g["_g"].shift()).cumsum().to_numpy()
            return g.assign(below=g["below"] + smaller_before(change, g[value].to_numpy(), g[weight].to_numpy(np.int64)))

        return run

    a = a.withColumn("below", F.lit(0).cast("long"))
    a = a.groupBy(xb).applyInPandas(count_in("_at", y), a.schema).drop("_at")
    b = _ranged(a, [F.asc("_g"), F.asc(y), F.desc(xb)], bits, "_at", yb)
    b = kept_table(b.groupBy(yb).applyInPandas(count_in("_at", xb), b.schema).drop("_at"))
    cells = b.groupBy("_g", xb, yb).agg(F.sum(weight).alias(weight))
    wide = cells.groupBy("_g").agg((F.min(xb) < F.max(xb)).alias("p"), (F.min(yb) < F.max(yb)).alias("q")).where("p and q").select("_g")
    cells = kept_table(cells.join(wide, "_g"))
    if cells.isEmpty():
        return b.drop(xb, yb)
    far = dominated(cells, [xb], yb, weight, bits + 2).select("_g", xb, yb, F.col("below").alias("_far"))
    out = b.join(far, ["_g", xb, yb], "left").withColumn("below", F.col("below") + F.coalesce("_far", F.lit(0)))
    return out.drop(xb, yb, "_far")


def causal_rank(df: DataFrame, entity: str, order: list[str], value: str, exclude_self: bool = False) -> DataFrame:
    """``df`` with causal_rank, the percentile rank of a row's value among its entity's values so far: (less + (equal + 1) / 2) / n; with
    ``exclude_self`` among the earlier ones only, the first's being null. Null and NaN values count in no rank and have none; a
    null entity is an entity. ``order`` is unique within an entity.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.select(*dict.fromkeys([entity, *order]), F.col(value).cast("double").alias("_v")).where(known)
    rows = positions(rows, [entity], order, "_n")
    rows = positions(rows, [entity, "_v"], order, "_same").withColumns({"_g": group_name([entity]), "_w": F.lit(1).cast("long")})
    found = dominated(rows.select("_g", "_n", "_v", "_w", "_same"), ["_n"], "_v", "_w")
    less, equal, n = F.col("below"), F.col("_same") - 1, F.col("_n") - 1  # among earlier rows
    rank = F.when(n > 0, (less + (equal + 1) / 2) / F.nullif(n, F.lit(0))) if exclude_self else (less + (equal + 2) / 2) / (n + 1)
    ranks = found.select("_g", "_n", rank.alias("causal_rank"))
    keys = rows.select("_g", "_n", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(dict.fromkeys([entity, *order]))))
    ranks = keys.join(ranks, ["_g", "_n"]).drop("_g", "_n")
    on = None
    for i, c in enumerate(dict.fromkeys([entity, *order])):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return df.join(ranks, on & known, "left").select(*(df[c] for c in df.columns), "causal_rank")


def pair_concordance(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """(group, tau_b, c_index): Kendall's tau-b and the C-index of the pairs within each group; pairs of equal y don't count for the
    index, pairs of equal p count half. Rows with a null in y, p or group take no part; null where no pair counts."""
    known = df.where(F.col(group).isNotNull() & F.col(y).isNotNull() & F.col(p).isNotNull())
    points = known.select(F.col(group).alias("_k"), F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    points = points.groupBy("_k", "_y", "_p").agg(F.count("*").alias("_w")).withColumn("_g", group_name(["_k"]))
    both = dominated(points, ["_y"], "_p", "_w")

    def pairs(keys: list[str], name: str) -> DataFrame:
        n = points.groupBy("_k", *keys).agg(F.sum("_w").cast("double").alias("n"))
        return n.groupBy("_k").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    t = both.groupBy("_k").agg(F.sum(F.col("_w") * F.col("below").cast("double")).alias("c"))
    for keys, name in (([], "all"), (["_y"], "ty"), (["_p"], "tp"), (["_y", "_p"], "typ")):
        t = t.join(pairs(keys, name), "_k")
    uneven, scored = F.col("all") - F.col("ty"), F.col("all") - F.col("tp")
    discordant = F.col("all") - F.col("ty") - F.col("tp") + F.col("typ") - F.col("c")
    half = (F.col("tp") - F.col("typ")) / 2
    return t.select(F.col("_k").alias(group), ((F.col("c") - discordant) / F.nullif(F.sqrt(uneven * scored), F.lit(0.0))).alias("tau_b"), ((F.col("c") + half) / F.nullif(uneven, F.lit(0.0))).alias("c_index"))
