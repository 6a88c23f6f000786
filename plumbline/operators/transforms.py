"""Target transforms that are fitted on training rows: each has a fit, a forward and an inverse half.

Fits are a few numbers or a small table; forward and inverse need the base (and the group), never the target that is to be
recovered. Nulls give nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import kept_table
from .frames import normal_scores
from .joins import lookup
from .quantiles import quantiles
from .windows import by

#: Distinct values up to which a distribution function is exact: they are its knots, on the driver and in every task.
KNOTS = 4096


@dataclass(frozen=True)
class Ecdf:
    """A distribution function through (knot, share of rows at or below, less half a row), linear between knots, flat beyond."""

    knots: tuple[float, ...]
    shares: tuple[float, ...]

    def _through(self, x: tuple[float, ...], y: tuple[float, ...]) -> Callable[[Column], Column]:
        xs, ys = np.array(x), np.array(y)

        def run(v: pa.Array) -> pa.Array:
            given = v.to_numpy(zero_copy_only=False).astype(float)
            return pa.array(np.interp(given, xs, ys), mask=np.isnan(given))

        return F.arrow_udf(run, "double")

    def share(self, value: Column) -> Column:
        return self._through(self.knots, self.shares)(value.cast("double"))

    def value(self, share: Column) -> Column:
        return self._through(self.shares, self.knots)(share.cast("double"))

    def score(self, value: Column) -> Column:
        """The normal score of a value's share, kept off 0 and 1 by half a knot."""
        eps, xs, ys = 1 / (2 * max(2, len(self.knots))), np.array(self.knots), np.array(self.shares)

        def run(v: pa.Array) -> pa.Array:
            given = v.to_numpy(zero_copy_only=False).astype(float)
            return pa.array(normal_scores(np.clip(np.interp(given, xs, ys), eps, 1 - eps)), mask=np.isnan(given))

        return F.arrow_udf(run, "double")(value.cast("double"))


def fit_ecdf(df: DataFrame, col: str, most: int | None = None) -> Ecdf:
    """All distinct values as knots; over KNOTS of them are an error, unless ``most`` is given: then a column of more distinct values
    than that is described by as many quantiles. A constant gets a second knot."""
    exact, most = most is None, most or KNOTS
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    counts = rows.groupBy("v").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(counts) <= most:
        pairs = sorted((r["v"], r["n"]) for r in counts)
        ends = np.cumsum([n for _, n in pairs])
        knots, shares = [v for v, _ in pairs], [(e - 0.5) / ends[-1] for e in ends]
    elif exact:
        raise ValueError(f"{col} has over {KNOTS} distinct values; give the number of quantiles (most) that are to stand for them")
    else:
        shares = [(i + 0.5) / most for i in range(most)]
        found = dict(zip(rows.approxQuantile("v", shares, 0.1 / most), shares, strict=True))  # the last share of a repeated value
        knots, shares = list(found), list(found.values())
    if len(knots) == 1:
        knots, shares = [knots[0], knots[0] + 1], [0.5, 0.5 + 1e-9]
    return Ecdf(tuple(knots), tuple(map(float, shares))) if knots else Ecdf((0.0,), (0.5,))


# shares of target and base


def share_forward(y: Column, base: Column, of_y: Ecdf, of_base: Ecdf) -> Column:
    return of_y.share(y) - of_base.share(base)


def share_inverse(t: Column, base: Column, of_y: Ecdf, of_base: Ecdf) -> Column:
    """Never leaves the target's range in training."""
    return of_y.value(t + of_base.share(base))


# Gaussian copula: a line between normal scores


@dataclass(frozen=True)
class Copula:
    of_y: Ecdf
    of_base: Ecdf
    slope: float
    intercept: float

    def _line(self, base: Column) -> Column:
        return self.slope * self.of_base.score(base) + self.intercept

    def forward(self, y: Column, base: Column) -> Column:
        return self.of_y.score(y) - self._line(base)

    def inverse(self, t: Column, base: Column) -> Column:
        return self.of_y.value(normal_share(t + self._line(base)))


def normal_share(z: Column) -> Column:
    """The normal distribution function."""
    erf = np.vectorize(math.erf, otypes=[float])

    def run(v: pa.Array) -> pa.Array:
        given = v.to_numpy(zero_copy_only=False).astype(float)
        return pa.array((1 + erf(given / math.sqrt(2))) / 2 if len(given) else given, mask=np.isnan(given))

    return F.arrow_udf(run, "double")(z)


def fit_copula(df: DataFrame, y: str, base: str, most: int | None = None) -> Copula:
    """The line is 0 for fewer than three rows, and level where the base doesn't vary."""
    of_y, of_base = fit_ecdf(df, y, most), fit_ecdf(df, base, most)
    pairs = df.where(F.col(y).isNotNull() & F.col(base).isNotNull()).groupBy(F.col(y).cast("double").alias("y"), F.col(base).cast("double").alias("b")).agg(F.count("*").alias("n"))
    z = kept_table(pairs.select(of_y.score(F.col("y")).alias("y"), of_base.score(F.col("b")).alias("b"), "n").where("y is not null and b is not null"))
    n, mean, at = z.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("n") * F.col("y")) / F.sum("n"), F.sum(F.col("n") * F.col("b")) / F.sum("n")).first()
    if n < 3:
        return Copula(of_y, of_base, 0.0, 0.0)
    if z.agg(F.min("b") == F.max("b")).first()[0]:
        return Copula(of_y, of_base, 0.0, mean)
    d = F.col("b") - F.lit(at)
    slope = z.agg(F.sum(F.col("n") * d * (F.col("y") - F.lit(mean))) / F.sum(F.col("n") * d * d)).first()[0]
    return Copula(of_y, of_base, slope, mean - slope * at)


# lines that outliers don't bend


def fit_plane(df: DataFrame, y: str, bases: list[str]) -> np.ndarray:
    """Least squares coefficients of the bases and, last, the intercept, from sums of products about the means."""
    cols = [*bases, y]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).na.drop()
    means = rows.agg(*(F.avg(c).alias(c) for c in cols)).first()
    if means[0] is None:
        return np.zeros(len(bases) + 1)
    d = {c: F.col(c) - F.lit(means[c]) for c in cols}
    s = rows.agg(*(F.sum(d[a] * d[b]).alias(f"{i}_{j}") for i, a in enumerate(bases) for j, b in enumerate(cols))).first()
    k = len(bases)
    gram = np.array([[s[f"{i}_{j}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.lstsq(gram, np.array([s[f"{i}_{k}"] for i in range(k)]), rcond=None)[0]
    return np.append(beta, means[y] - sum(b * means[c] for b, c in zip(beta, bases, strict=True)))


def plane(bases: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(bases, beta, strict=False)), F.lit(float(beta[-1])))


def fit_robust_plane(df: DataFrame, y: str, bases: list[str], cut: float = 3.0, keep: float = 0.5) -> np.ndarray:
    """``fit_plane`` again without rows whose residual is over ``cut`` scaled median deviations from the median, unless that leaves
    less than the share ``keep`` of the rows, or takes none, or residuals hardly vary."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in [*bases, y])).na.drop()
    beta = fit_plane(rows, y, bases)
    left = rows.withColumn("_r", F.col(y) - plane(bases, beta))
    n = left.count()
    if n < len(bases) + 2:
        return beta
    (med,), (size,) = quantiles(left, "_r", [0.5]), quantiles(left, F.abs("_r"), [0.5])
    sigma = 1.4826 * quantiles(left, F.abs(F.col("_r") - F.lit(med)), [0.5])[0]
    if sigma <= max(1e-12, 1e-9 * (size or 1.0)):
        return beta
    inner = left.where(F.abs(F.col("_r") - F.lit(med)) <= cut * sigma)
    kept = inner.count()
    return beta if kept == n or kept < max(len(bases) + 2, int(keep * n)) else fit_plane(inner, y, bases)


def plane_forward(y: Column, bases: list[str], beta: np.ndarray) -> Column:
    return y - plane(bases, beta)


def plane_inverse(t: Column, bases: list[str], beta: np.ndarray) -> Column:
    return t + plane(bases, beta)


def fit_anchor(df: DataFrame, y: str, anchor: str, prior: float = 0.5, weight: float = 20.0, least: int = 5) -> float:
    """The share of an earlier value to subtract: the robust slope, drawn to ``prior`` by n / (n + ``weight``), within [0, 1]."""
    rows = kept_table(df.select(y, anchor).where(F.col(y).isNotNull() & F.col(anchor).isNotNull()))  # an anchor is mostly a window's
    n = rows.count()
    slope = float(fit_robust_plane(rows, y, [anchor])[0]) if n >= least else prior
    return min(1.0, max(0.0, (n * slope + weight * prior) / (n + weight) if n >= least else prior))


def anchor_forward(y: Column, anchor: Column, share: float) -> Column:
    return y - share * anchor


def anchor_inverse(t: Column, anchor: Column, share: float) -> Column:
    return t + share * anchor


# level and volatility of the base


@dataclass(frozen=True)
class Volatility:
    """``span`` of both moving averages, what they start from, and the least volatility to divide by."""

    span: int
    level: float
    volatility: float
    floor: float


def volatility_traces(df: DataFrame, entity: str, order: list[str], base: str, key: str, span: int, level: float, volatility: float) -> DataFrame:
    """``df`` with level and volatility: each entity's exponential averages, of weight 2 / (span + 1), of the base and of its distance from the
    level, from the given starts; a null base leaves them. A recursion along an entity: its rows are a stream in order, of which two
    numbers are carried on, so an entity may be of any length, and short ones cost no call each. ``key`` must name a row."""
    a, names = 2 / (span + 1), df.columns

    def run(batches):
        at, away = level, volatility
        for b in batches:
            levels, volatilities = [], []
            for v, first in zip(b["_v"].to_pylist(), b["_first"].to_pylist(), strict=True):
                if first:
                    at, away = level, volatility
                if v is not None and v == v:
                    at = (1 - a) * at + a * v
                    away = (1 - a) * away + a * abs(v - at)
                levels.append(at)
                volatilities.append(away)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(levels, pa.float64()), pa.array(volatilities, pa.float64())], [*names, "level", "volatility"])

    first = F.row_number().over(by(entity, [*order, key])) == 1
    rows = df.withColumn("_v", F.col(base).cast("double")).withColumn("_first", first).sortWithinPartitions(entity, *order, key)
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("level", DoubleType()), StructField("volatility", DoubleType())]))


def fit_volatility(df: DataFrame, entity: str, order: list[str], base: str, key: str, span: int = 7, least: float = 1e-3) -> Volatility:
    """Starts are the base's mean and its mean distance from the level; the floor is ``least`` of the median volatility."""
    df = df.select(*dict.fromkeys([entity, *order, base, key]))
    level = df.agg(F.avg(base)).first()[0] or 0.0
    away = volatility_traces(df, entity, order, base, key, span, level, 0.0).agg(F.avg(F.abs(F.col(base) - F.col("level")))).first()[0] or 0.0
    traced = kept_table(volatility_traces(df, entity, order, base, key, span, level, away).select("volatility"))
    middle = quantiles(traced, "volatility", [0.5])[0] or 0.0
    return Volatility(span, level, away, max(least * middle, 1e-12))


def with_volatility(df: DataFrame, entity: str, order: list[str], base: str, key: str, fit: Volatility) -> DataFrame:
    """``df`` with level and (floored) volatility, for ``volatility_forward`` and ``volatility_inverse``; ``key`` names a row."""
    t = volatility_traces(df, entity, order, base, key, fit.span, fit.level, fit.volatility)
    return t.withColumn("volatility", F.greatest("volatility", F.lit(fit.floor)))


def volatility_forward(y: Column) -> Column:
    return (y - F.col("level")) / F.col("volatility")


def volatility_inverse(t: Column) -> Column:
    return t * F.col("volatility") + F.col("level")


# groups' means


def fit_group_means(df: DataFrame, group: str, y: str, strength: float = 20.0) -> tuple[DataFrame, float]:
    """({group: smoothed mean}, overall mean); rows with a null target don't count."""
    rows = df.where(F.col(y).isNotNull())
    overall = rows.agg(F.avg(y)).first()[0] or 0.0
    means = rows.groupBy(group).agg(((F.sum(y) + strength * F.lit(overall)) / (F.count(y) + strength)).alias("_mean"))
    return means, overall


def with_group_mean(df: DataFrame, group: str, fit: tuple[DataFrame, float], name: str = "group_mean") -> DataFrame:
    """``df`` with what the forward half subtracts and the inverse half adds; an unseen group takes the overall mean."""
    return lookup(df, fit[0].withColumnRenamed("_mean", name), [group], {name: fit[1]})


def seasonal_inverse(t: Column, mean: Column) -> Column:
    return t + mean
