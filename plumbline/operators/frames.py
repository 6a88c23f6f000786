"""Whole-frame operators: gated column pairs, time windows, target transforms, rank aggregation and calendars."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance_gated_diffs(df: DataFrame, cols: list[str], least: float) -> DataFrame:
    """Differences of column pairs whose sample variance, from one job's variances and covariances, exceeds ``least``."""
    pairs = list(combinations(cols, 2))
    s = df.agg(*(F.var_samp(c).alias(c) for c in cols), *(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    return df.withColumns({f"{a}__diff__{b}": F.col(a) - F.col(b) for a, b in pairs if (s[a] or 0) + (s[b] or 0) - 2 * (s[f"{a}|{b}"] or 0) > least})


def time_windows(df: DataFrame, time: str, keys: list[str], value: str, every: str, period: str | None = None, start: str | None = None) -> DataFrame:
    """Count, sum, mean and extremes in tumbling (``every``) or sliding (``period`` long) windows, closed at the left, named by
    their start. Works on batches and streams."""
    w = F.window(time, period or every, every, start) if start else F.window(time, period or every, every)
    out = df.groupBy(*keys, w.alias("w")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total", "mean", "least", "most")


def sessions(df: DataFrame, time: str, keys: list[str], value: str, gap: str) -> DataFrame:
    out = df.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


# target transforms: fit on training rows gives parameters; forward and inverse are expressions


def fit_linear(df: DataFrame, y: str, base: str) -> tuple[float, float]:
    """Slope and intercept."""
    return tuple(df.agg(F.regr_slope(y, base), F.regr_intercept(y, base)).first())


def linear_forward(y: Column, base: Column, p: tuple[float, float]) -> Column:
    return y - (p[0] * base + p[1])


def linear_inverse(t: Column, base: Column, p: tuple[float, float]) -> Column:
    return t + (p[0] * base + p[1])


def log_ratio_forward(y: Column, base: Column) -> Column:
    """log(y / base); null outside the domain (both positive)."""
    return F.when((y > 0) & (base > 0), F.log(y) - F.log(base))


def log_ratio_inverse(t: Column, base: Column) -> Column:
    return F.exp(t) * base


def second_difference(y: Column, b1: Column, b2: Column) -> Column:
    return y - 2 * b1 + b2


def asinh_forward(y: Column, centre: float, scale: float) -> Column:
    return F.asinh((y - centre) / scale)


def asinh_inverse(t: Column, centre: float, scale: float) -> Column:
    return F.sinh(t) * scale + centre


def fit_seasonal(df: DataFrame, phase: Column, y: str, periods: tuple[int, ...] = (4, 5, 7, 12, 24, 52)) -> tuple[int, DataFrame]:
    """The period (the smallest of the best) whose phase means leave least variance, and those means. One job over all periods."""
    rows = df.select(F.col(y).alias("y"), phase.alias("i"), F.explode(F.array(*map(F.lit, periods))).alias("period"))
    each = rows.groupBy("period", F.pmod("i", "period").alias("phase")).agg(F.avg("y").alias("mean"), F.sum(F.col("y") * F.col("y")).alias("q"), F.count("*").alias("n"))
    left = each.groupBy("period").agg(F.sum(F.col("q") - F.col("n") * F.col("mean") * F.col("mean")).alias("left")).orderBy(F.round("left", 6), "period").first()
    return left["period"], each.where(F.col("period") == left["period"]).select("phase", "mean")


def rank_ecdf(df: DataFrame, y: str, parts: int | None = None) -> DataFrame:
    """``df`` with u = (rows at or below - 0.5) / n: the plotting position of the last of equal values; null for a null, which doesn't count."""
    from .aggregates import ranks_by_parts

    n = df.where(F.col(y).isNotNull()).count()
    return ranks_by_parts(df, y, parts).withColumn("u", (F.col("_le") - 0.5) / n).drop("_le", "_ge")


# fixed values: the published coefficients of Acklam's approximation
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(cs: tuple, x):
    out = cs[0]
    for v in cs[1:]:
        out = x * out + v
    return out


def normal_score(u: Column) -> Column:
    """Inverse of the normal distribution function by Acklam's rational approximation (relative error 1.2e-9)."""
    q = u - 0.5
    tail = lambda p: _poly(_C, F.sqrt(-2 * F.log(p))) / _poly(_D, F.sqrt(-2 * F.log(p)))
    return F.when(u < 0.02425, tail(u)).when(u > 1 - 0.02425, -tail(1 - u)).otherwise(_poly(_A, q * q) * q / _poly(_B, q * q))


def normal_scores(u: np.ndarray) -> np.ndarray:
    """``normal_score`` of shares inside (0, 1), for use in tasks."""
    q, t = u - 0.5, np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    return np.where(np.abs(q) > 0.5 - 0.02425, -np.sign(q) * _poly(_C, t) / _poly(_D, t), _poly(_A, q * q) * q / _poly(_B, q * q))


# rank aggregation over a long table (task, model, score), higher being better


def placings(scores: DataFrame) -> DataFrame:
    """With place: how many models score at least as well (ties share the worse place), and n models of the task."""
    w = Window.partitionBy("task")
    return scores.withColumn("place", F.count("*").over(w.orderBy(F.desc("score")))).withColumn("n", F.count("*").over(w))


def positional(scores: DataFrame) -> DataFrame:
    """By model: mean score, geometric mean (null unless all positive), wins, Borda (n - place), Dowdall (1 / place), and the largest
    shortfall from a task's best."""
    p = placings(scores).withColumn("best", F.max("score").over(Window.partitionBy("task")))
    return p.groupBy("model").agg(
        F.avg("score").alias("mean"), F.when(F.min("score") > 0, F.exp(F.avg(F.log(F.when(F.col("score") > 0, F.col("score")))))).alias("geometric"), F.sum((F.col("score") == F.col("best")).cast("long")).alias("wins"),
        F.sum(F.col("n") - F.col("place")).alias("borda"), F.sum(1 / F.col("place")).alias("dowdall"), F.max(F.col("best") - F.col("score")).alias("worst_gap"), F.avg(F.col("best") - F.col("score")).alias("gap"),
    )


def duels(scores: DataFrame) -> DataFrame:
    """(model, other, won, lost): tasks won and lost against each other model. Models meet by task."""
    a, b = scores.select("task", "model", "score"), scores.select("task", F.col("model").alias("other"), F.col("score").alias("rival"))
    return a.join(b, "task").where("model != other").groupBy("model", "other").agg(F.sum((F.col("score") > F.col("rival")).cast("long")).alias("won"), F.sum((F.col("score") < F.col("rival")).cast("long")).alias("lost"))


def pairwise(scores: DataFrame) -> DataFrame:
    """By model: Copeland score (duels won less lost), minimax (its worst defeat's margin, 0 without), and whether it beats all (Condorcet)."""
    d = duels(scores)
    margin = F.col("won") - F.col("lost")
    return d.groupBy("model").agg(F.sum(F.signum(margin)).cast("long").alias("copeland"), F.max(F.greatest(-margin, F.lit(0))).alias("minimax"), (F.min(margin) > 0).cast("int").alias("condorcet"))


def copeland(scores: DataFrame) -> DataFrame:
    """By model the four Copeland slices, from duels between all models by majority of tasks: lower (duels won), upper (less duels
    lost), difference (won less lost) and lower_with_ties (won, ties as halves)."""
    margin = F.col("won") - F.col("lost")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    won, lost, tied = count(margin > 0), count(margin < 0), count(margin == 0)
    return _of_all(scores, duels(scores).groupBy("model").agg(won.alias("lower"), (-lost).alias("upper"), (won - lost).alias("difference"), (won + tied / 2).alias("lower_with_ties")))


def minimax(scores: DataFrame) -> DataFrame:
    """By model the least opposition, the worst duel's value with its sign turned: winning_votes (tasks lost, where the duel is lost),
    margins (tasks lost less won) and pairwise_opposition (tasks lost)."""
    d = duels(scores).withColumn("votes", F.when(F.col("lost") > F.col("won"), F.col("lost")).otherwise(F.lit(0)))
    worst = d.groupBy("model").agg((-F.max("votes")).alias("winning_votes"), (-F.max(F.col("lost") - F.col("won"))).alias("margins"), (-F.max("lost")).alias("pairwise_opposition"))
    return _of_all(scores, worst)


def _of_all(scores: DataFrame, found: DataFrame) -> DataFrame:
    """A lone model has no duels: 0 throughout."""
    return scores.select("model").distinct().join(found, "model", "left").na.fill(0)


def median_filled(scores: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """A partial table (task, model, score) made whole: a model without a score takes the task's median. Tasks without any score go."""
    known = scores.where("score is not null")
    models = (models or scores).select("model").distinct()
    medians = known.groupBy("task").agg(F.percentile("score", F.lit(0.5)).alias("_m"))
    grid = medians.join(models, how="cross")  # a row for each task and model: the table itself
    return grid.join(known, ["task", "model"], "left").select("task", "model", F.coalesce("score", "_m").alias("score"))


def optimality_gap(scores: DataFrame, gamma: float) -> DataFrame:
    """(model, optimality_gap): mean of min(score, gamma) - gamma."""
    return scores.groupBy("model").agg(F.avg(F.least("score", F.lit(gamma)) - gamma).alias("optimality_gap"))


def threshold_winners(scores: DataFrame) -> DataFrame:
    """(model) left after rounds for the worst place, the second worst and so on, each of which keeps the models that take the place
    in fewest tasks; ties share the worse place. The places taken by each model are counted once: models x places."""
    taken = placings(scores).groupBy("model", "place").agg(F.count("*").alias("times")).collect()
    left = {r["model"] for r in taken}
    times = {(r["model"], r["place"]): r["times"] for r in taken}
    for place in range(len(left), 1, -1):
        least = min(times.get((m, place), 0) for m in left)
        left = {m for m in left if times.get((m, place), 0) == least}
    return scores.sparkSession.createDataFrame([(m,) for m in sorted(left)], "model string")


def baldwin(scores: DataFrame) -> list[str]:
    """Winners left after the models of least Borda count are struck off again and again. A job a round; models are few."""
    left = scores
    while True:
        b = positional(left).select("model", "borda").collect()
        least, most = min(r["borda"] for r in b), max(r["borda"] for r in b)
        if least == most:
            return sorted(r["model"] for r in b)
        left = left.where(F.col("model").isin([r["model"] for r in b if r["borda"] > least]))


def reciprocal_rank_fusion(scores: DataFrame, k: int = 60) -> DataFrame:
    """(model, rrf): sum of 1 / (k + rank) over tasks, ties by name."""
    r = scores.withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "model")))
    return r.groupBy("model").agg(F.sum(1 / (k + F.col("r"))).alias("rrf"))


def percentile_stack(scores: DataFrame) -> DataFrame:
    """(model, percentile): mean share of a task's models at or below it."""
    w = Window.partitionBy("task")
    return scores.withColumn("p", F.count("*").over(w.orderBy("score")) / F.count("*").over(w)).groupBy("model").agg(F.avg("p").alias("percentile"))


# calendars and prices


def holiday_features(df: DataFrame, day: str, holidays: list[str], key: str) -> DataFrame:
    """Holiday and eve flags, days since the last and until the next of a short list of days."""
    days = F.array(*(F.lit(h).cast("date") for h in sorted(holidays)))
    d = F.col(day).cast("date")
    past, next_ = F.array_max(F.filter(days, lambda h: h <= d)), F.array_min(F.filter(days, lambda h: h >= d))
    return df.select(key, F.array_contains(days, d).cast("int").alias("holiday"), F.array_contains(days, F.date_add(d, 1)).cast("int").alias("eve"), F.datediff(d, past).alias("since"), F.datediff(next_, d).alias("until"))


def price_ratios(df: DataFrame, entity: str, order: list[str], o: str, h: str, low: str, c: str) -> DataFrame:
    """Body, range and gap of price bars, each over its base."""
    w = Window.partitionBy(entity).orderBy(*order)
    last = F.lag(c).over(w)
    zero = F.lit(0.0)
    return df.withColumn("body", F.col(c) / F.nullif(o, zero) - 1).withColumn("range", (F.col(h) - F.col(low)) / F.nullif(o, zero)).withColumn("gap", F.col(o) / F.nullif(last, zero) - 1)


def cyclic(c: Column, n: int) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * c / n), F.cos(2 * math.pi * c / n)
