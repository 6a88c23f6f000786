"""Blends of predictions, re-ordered rankings and further target transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_moments(df: DataFrame, cols: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean products of predictions with each other and with the target, and of the target with itself: one job, whatever is fitted."""
    own = [F.avg(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = df.agg(*own, *(F.avg(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(cols)), F.avg(F.col(y) * F.col(y)).alias("yy")).first()
    n = len(cols)
    return np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]), np.array([r[f"y{i}"] for i in range(n)]), r["yy"]


def hill_climb(df: DataFrame, cols: list[str], y: str, steps: int = 20) -> dict[str, float]:
    """Weights by adding, with replacement, the prediction that lowers the mean squared error of the average most; stops when none does."""
    g, c, yy = cross_moments(df, cols, y)
    counts, best = np.zeros(len(cols)), np.inf
    for _ in range(steps):
        tries = [(yy - 2 * w @ c + w @ g @ w, i) for i in range(len(cols)) for w in [(counts + np.eye(len(cols))[i]) / (counts.sum() + 1)]]
        loss, i = min(tries)
        if loss >= best - 1e-12:
            break
        best, counts[i] = loss, counts[i] + 1
    return dict(zip(cols, (counts / max(1, counts.sum())).tolist(), strict=True))


def simplex_weights(df: DataFrame, cols: list[str], y: str, rounds: int = 2000) -> dict[str, float]:
    """Non-negative weights of sum 1 of least mean squared error, by exponentiated gradients on the moments."""
    g, c, _ = cross_moments(df, cols, y)
    w, scale = np.full(len(cols), 1 / len(cols)), np.abs(g).max() or 1.0
    for _ in range(rounds):
        w = w * np.exp(-(g @ w - c) / scale)
        w /= w.sum()
    return dict(zip(cols, w.tolist(), strict=True))


def linear_blend(weights: dict[str, float]) -> Column:
    return sum(F.col(c) * float(w) for c, w in weights.items())


def geometric_blend(weights: dict[str, float], floor: float = 1e-12) -> Column:
    """exp of the weighted mean of logs, values below ``floor`` raised to it."""
    return F.exp(sum(F.log(F.greatest(F.col(c), F.lit(floor))) * float(w) for c, w in weights.items()) / sum(weights.values()))


def gated_blend(p: Column, q: Column, confidence: Column, cut: float) -> Column:
    """q where confidence reaches the cut, else p."""
    return F.when(confidence >= cut, q).otherwise(p)


def rank_splice(df: DataFrame, group: str, score: str, other: str, key: str, first: int, last: int) -> DataFrame:
    """With place: the order by falling ``score`` (ties by key), its places ``first`` to ``last`` re-ordered by falling ``other``."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    inside = F.col("_r").between(first, last)
    sub = F.row_number().over(Window.partitionBy(group, inside).orderBy(F.desc(other), key)) + (first - 1)
    return r.withColumn("place", F.when(inside, sub).otherwise(F.col("_r"))).drop("_r")


def top_subsets(df: DataFrame, score: str, key: str, sizes: tuple[int, ...]) -> DataFrame:
    """(size, key) of the best rows for each size: one top-n, then a row for each size that holds it."""
    top = df.orderBy(F.desc(score), key).limit(max(sizes)).select(key, score)
    r = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))  # at most max(sizes) rows
    return r.select(F.explode(F.array(*map(F.lit, sizes))).alias("size"), key, "_r").where("_r <= size").drop("_r")


def volatility_normalised(df: DataFrame, entity: str, order: list[str], y: str, width: int) -> DataFrame:
    """With scaled: y less its entity's earlier mean over their deviation, both of the ``width`` rows before; null if these don't vary."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-width, -1)
    return df.withColumn("scaled", (F.col(y) - F.avg(y).over(w)) / F.nullif(F.stddev_samp(y).over(w), F.lit(0.0)))


def kernel_means(df: DataFrame, x: str, y: str, lo: float, hi: float, grid: int, width: float) -> DataFrame:
    """(at, mean): Gaussian-weighted mean of y at grid points. Rows are summed by x first, then meet the few grid points."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.sum(y).alias("_s"), F.count("*").alias("_n"))
    at = F.explode(F.array(*(F.lit(lo + (hi - lo) * i / (grid - 1)) for i in range(grid)))).alias("at")
    k = F.exp(-0.5 * F.pow((F.col("at") - F.col(x)) / width, F.lit(2)))
    return n.select(x, "_s", "_n", at).groupBy("at").agg((F.sum(k * F.col("_s")) / F.sum(k * F.col("_n"))).alias("mean"))


def interval_transform(y: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """Probability integral transform from three quantiles (5 %, 50 %, 95 %), linear between them, flat beyond."""
    return F.when(y <= lo, 0.05).when(y <= mid, 0.05 + 0.45 * (y - lo) / F.nullif(mid - lo, F.lit(0.0))).when(y <= hi, 0.5 + 0.45 * (y - mid) / F.nullif(hi - mid, F.lit(0.0))).otherwise(0.95)
