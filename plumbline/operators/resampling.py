"""Intervals and null distributions by resampling, in passes that never copy the rows: a partition gives a few sums for each replicate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import SMALL
from .windows import TASK_ROWS

#: Poisson(1)'s distribution function, from which a row's weights in replicates are drawn.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
#: Rows within which values are exchanged.
BLOCK = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(h: np.ndarray, replicates: int) -> np.ndarray:
    """rows x replicates weights from the rows' hashes: a row's are the same in any partition."""
    turns = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = (_mixed(h.astype(np.uint64)[:, None] + turns[None, :]) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def weighted_replicates(rows: DataFrame, replicates: int) -> np.ndarray:
    """replicates x 2: the resampled sums of columns w and wv of ``rows`` (h, w, wv)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, 2))
        for b in batches:
            h, values = b["h"].to_numpy().view(np.uint64), np.stack([b["w"].to_numpy(), b["wv"].to_numpy()], axis=1)
            for i in range(0, len(h), 2048):
                total += poisson_weights(h[i : i + 2048], replicates).T @ values[i : i + 2048]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["r", "w", "wv"])

    got = rows.mapInArrow(sums, "r bigint, w double, wv double").groupBy("r").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv")).toPandas()
    return got.sort_values("r")[["w", "wv"]].to_numpy()


def bootstrap_bca(df: DataFrame, row: Column, key: str, weight: Column | None = None, shape: Callable[[Column], Column] = lambda mean: mean, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(metric, low, high, bias, acceleration): bias-corrected and accelerated interval of any metric that is a function ``shape`` of the
    (weighted) mean of a contribution of each row: squared error with ``F.sqrt``, log loss, Brier score, accuracy, a ratio of sums.

    Leaving a row out changes the mean in closed form, so the jackknife is one aggregate. Replicates weigh rows by Poisson draws
    from a seeded hash of the key: reruns agree, rows of one key share their draws. Rows with a null contribution or weight, or
    a weight of 0, don't count. Without rows all is null; if replicates don't vary, both ends are the metric.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.xxhash64(F.lit(seed), key).alias("h"), w.alias("w"), (w * row.cast("double")).alias("wv")).where("wv is not null and w > 0")
    n, total, sum_wv = rows.agg(F.count("*"), F.sum("w"), F.sum("wv")).first()
    out = "metric double, low double, high double, bias double, acceleration double"
    if not n:
        return df.sparkSession.createDataFrame([(None,) * 5], out)

    def shaped(w: np.ndarray, wv: np.ndarray) -> np.ndarray:
        means = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(wv / w)], "i int, m double")  # a row for each replicate
        return means.select("i", shape(F.col("m")).cast("double").alias("m")).toPandas().sort_values("i")["m"].to_numpy()

    drawn = weighted_replicates(rows, replicates)
    drawn = drawn[drawn[:, 0] > 0]
    values = shaped(np.append(drawn[:, 0], total), np.append(drawn[:, 1], sum_wv))
    metric, values = float(values[-1]), np.sort(values[:-1])
    left = shape((F.lit(sum_wv) - F.col("wv")) / F.nullif(F.lit(total) - F.col("w"), F.lit(0.0))) - F.lit(metric)  # about 0, so that powers keep their digits
    s1, s2, s3, m = rows.select(left.cast("double").alias("d")).agg(F.sum("d"), F.sum(F.col("d") ** 2), F.sum(F.col("d") ** 3), F.count("d")).first()
    acceleration = 0.0
    if m:
        mean = s1 / m
        second, third = s2 - m * mean**2, s3 - 3 * mean * s2 + 2 * m * mean**3
        acceleration = -third / (6 * second**1.5) if second > 1e-300 else 0.0
    normal = NormalDist()
    if not len(values) or values[0] == values[-1]:
        return df.sparkSession.createDataFrame([(metric, metric, metric, 0.0, acceleration)], out)
    below = ((values < metric).sum() + (values == metric).sum() / 2) / len(values)
    bias = normal.inv_cdf(min(max(below, 0.5 / len(values)), 1 - 0.5 / len(values)))

    def end(p: float) -> float:
        z = bias + normal.inv_cdf(p)
        return float(np.quantile(values, normal.cdf(bias + z / (1 - acceleration * z))))

    return df.sparkSession.createDataFrame([(metric, end((1 - level) / 2), end((1 + level) / 2), float(bias), float(acceleration))], out)


def exchanges(n: int, block: int, permutations: int, seed: int) -> np.ndarray:
    """permutations x n places: the orders that a block's values of y take."""
    rng = np.random.default_rng([seed, block & 0xFFFFFFFF, (block >> 32) & 0xFFFFFFFF])
    return rng.permuted(np.tile(np.arange(n), (permutations, 1)), axis=1)


def permutation_null(df: DataFrame, features: list[str], y: str, key: str, stratum: str | None = None, permutations: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((feature, corr), (r, feature, corr)): absolute correlations with ``y`` as they are, and for each of ``permutations`` exchanges of
    y among rows, all features seeing the same exchange.

    Values are exchanged within blocks of about BLOCK rows that a hash of the key makes up, within strata if one is given; since blocks
    have nothing to do with the values, that is as valid as exchanging all. A block is a matrix product; a partition gives one sum
    for each feature and permutation. Rows with a null y, key or stratum don't count; a null feature counts as the feature's mean; a
    feature that doesn't vary has a correlation of 0.
    """
    group = F.col(stratum) if stratum else F.lit(0)
    rows = df.select(group.alias("g"), F.col(key).alias("k"), F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features))).na.drop(subset=["g", "k", "y"])
    xs = [f"x{i}" for i in range(len(features))]
    means = rows.agg(*(F.avg(c).alias(c) for c in ("y", *xs))).first()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))  # a row for each stratum
    mean = {c: means[c] or 0.0 for c in ("y", *xs)}
    few = sizes.limit(SMALL + 1).count() <= SMALL
    rows = rows.join(F.broadcast(sizes) if few else sizes, "g").select("g", "k", F.pmod(F.xxhash64(F.lit(seed), "k"), F.ceil(F.col("n") / BLOCK)).alias("b"), *((F.coalesce(c, F.lit(mean[c])) - mean[c]).alias(c) for c in ("y", *xs)))
    squares = rows.agg(F.count("*"), *(F.sum(F.col(c) ** 2) for c in ("y", *xs)), *(F.sum(F.col(c) * F.col("y")) for c in xs)).first()
    n, spread, own = squares[0], squares[1 : 2 + len(xs)], squares[2 + len(xs) :]
    scale = np.array([1 / math.sqrt(v * spread[0]) if n and v > 1e-300 and spread[0] > 1e-300 else 0.0 for v in spread[1:]]) if n else np.zeros(len(xs))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, at = np.zeros((permutations, len(xs))), [], None

        def add() -> None:
            values = np.concatenate(held)
            total[:] += values[:, 0][exchanges(len(values), at, permutations, seed)] @ values[:, 1:]

        for b in batches:
            blocks, values = b["block"].to_numpy(), np.stack([b[c].to_numpy() for c in ("y", *xs)], axis=1)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if lo == hi:
                    continue
                if at is not None and blocks[lo] != at:
                    add()
                    held.clear()
                at = int(blocks[lo])
                held.append(values[lo:hi])
        if held:
            add()
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(total.ravel())], ["r", "f", "s"])

    blocked = rows.withColumn("block", F.xxhash64("g", "b")).repartition(max(8, (n or 0) // TASK_ROWS), "block").sortWithinPartitions("block", "k", "y", *xs)
    null = blocked.select("block", "y", *xs).mapInArrow(sums, "r bigint, f bigint, s double").groupBy("r", "f").agg(F.sum("s").alias("s"))
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c, float(scale[i]), float(abs((own[i] or 0.0) * scale[i]))) for i, c in enumerate(features)], "f bigint, feature string, scale double, corr double")
    null = null.join(F.broadcast(names.drop("corr")), "f").select("r", "feature", F.abs(F.col("s") * F.col("scale")).alias("corr"))  # a row for each feature
    return names.select("feature", "corr"), null


def max_statistic_test(df: DataFrame, features: list[str], y: str, key: str, stratum: str | None = None, permutations: int = 200, quantile: float = 0.95, seed: int = 0) -> DataFrame:
    """(feature, corr, p_value, adjusted, floor): the share of exchanges, the given order among them, in which the feature's own
    correlation, or the largest of all features', is as large; and the quantile of the largest, below which a correlation is no gain
    over the best of so many features of noise."""
    observed, null = permutation_null(df, features, y, key, stratum, permutations, seed)
    top = null.groupBy("r").agg(F.max("corr").alias("top"))
    rows = null.join(top, "r").join(F.broadcast(observed.withColumnRenamed("corr", "own")), "feature")  # a row for each feature
    share = lambda c: (1 + F.count_if(F.col(c) >= F.col("own") - 1e-12)) / F.lit(permutations + 1)
    return rows.groupBy("feature").agg(F.first("own").alias("corr"), share("corr").alias("p_value"), share("top").alias("adjusted"), F.percentile("top", F.lit(quantile)).alias("floor"))
