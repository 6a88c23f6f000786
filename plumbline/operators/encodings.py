"""Encodings and imputations. What is learned is a small table; apply it by join, so the rows that are scored teach nothing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup
from .quantiles import quantiles
from .windows import by


def text_of(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("nan"))


def concat_key(df: DataFrame, cols: list[str], sep: str = "_", name: str = "key") -> DataFrame:
    """Columns as one text; a null becomes the text nan."""
    return df.withColumn(name, F.concat_ws(sep, *map(text_of, cols)))


def powerset_concat(df: DataFrame, cols: list[str], max_order: int = 2, sep: str = "_") -> DataFrame:
    """A column for each subset of 2 to ``max_order`` columns, named by them."""
    return df.withColumns({"__".join(s): F.concat_ws(sep, *map(text_of, s)) for n in range(2, max_order + 1) for s in combinations(cols, n)})


def rounded_category(df: DataFrame, number: str, category: str, places: int = 0, sep: str = "_") -> DataFrame:
    """A number, rounded half to even, with a category."""
    return df.withColumn(f"{number}_x_{category}", F.concat_ws(sep, text_of(F.bround(number, places)), text_of(category)))


def pseudo_groups(df: DataFrame, cols: list[Column], name: str = "pseudo_group") -> DataFrame:
    """Rows whose columns are all equal share a number, by the columns' order: the position of their combination among the distinct ones,
    counted within ranges of the first column."""
    from .aggregates import position_by_parts

    named = {f"_g{i}": c for i, c in enumerate(cols)}
    keys = df.select(*(c.alias(n) for n, c in named.items())).distinct()
    numbered = position_by_parts(keys, list(named)).withColumn(name, F.col("_pos")).drop("_part", "_pos")
    same = F.lit(True)
    left = df.withColumns(named)
    for n in named:
        same = same & left[n].eqNullSafe(numbered[n])
    return left.join(numbered, same).drop(*(numbered[n] for n in named)).drop(*named)


def fit_target_means(df: DataFrame, key: str, y: str, strength: float = 20.0) -> tuple[DataFrame, float]:
    """({key: smoothed mean}, overall mean): (sum + strength * overall) / (n + strength)."""
    overall = df.agg(F.avg(y)).first()[0]
    return df.groupBy(key).agg(((F.sum(y) + strength * F.lit(overall)) / (F.count(y) + strength)).alias(f"{key}_te")), overall


def apply_target_means(df: DataFrame, fitted: tuple[DataFrame, float], key: str) -> DataFrame:
    return lookup(df, fitted[0], [key], {f"{key}_te": fitted[1]})


def ordered_target_encode(df: DataFrame, key: str, order: list[str], y: str, prior: float, strength: float = 1.0, name: str = "te") -> DataFrame:
    """(sum of earlier targets of the key + strength * prior) / (their number + strength)."""
    w = by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, (F.coalesce(F.sum(y).over(w), F.lit(0)) + strength * prior) / (F.count(y).over(w) + strength))


def two_step_encode(df: DataFrame, entity: str, time: str, order: list[str], category: str, y: str, prior: float, half_life_days: float = 90.0) -> DataFrame:
    """(entity, recency): categories are encoded by earlier targets, then averaged over each entity with weights that halve every
    ``half_life_days`` back from its last time."""
    enc = ordered_target_encode(df, category, order, y, prior, name="_enc")
    days = F.expr(f"unix_micros(cast({time} as timestamp))") / 86400e6
    enc = enc.withColumn("_d", days).withColumn("_w", F.pow(F.lit(0.5), (F.max("_d").over(Window.partitionBy(entity)) - F.col("_d")) / half_life_days))
    return enc.groupBy(entity).agg((F.sum(F.col("_enc") * F.col("_w")) / F.sum("_w")).alias("recency"))


def cross_locale_encode(df: DataFrame, local: str, shared: str, y: str, strength: float) -> DataFrame:
    """(shared, local, value): the pair's mean drawn to the mean of the shared name: (n * local + k * global) / (n + k)."""
    pair = df.groupBy(shared, local).agg(F.count(y).alias("_n"), F.avg(y).alias("_m"))
    whole = df.groupBy(shared).agg(F.avg(y).alias("_g"))
    return pair.join(whole, shared).select(shared, local, ((F.col("_n") * F.col("_m") + strength * F.col("_g")) / (F.col("_n") + strength)).alias("value"))


def order_stat_encode(df: DataFrame, key: str, y: str) -> DataFrame:
    """Median, tenth and ninetieth percentiles, quartile range and extremes of the target; groups below 8 (median), 12 (quartiles) or
    20 rows (percentiles, extremes: 8) take those of all rows."""
    of = (0.1, 0.25, 0.5, 0.75, 0.9)
    q10, q25, mid, q75, q90 = quantiles(df, y, list(of))
    lo, hi = df.agg(F.min(y), F.max(y)).first()
    whole = {"median": mid, "q10": q10, "q90": q90, "iqr": None if mid is None else q75 - q25, "min": lo, "max": hi}
    q = F.percentile(y, F.array(*map(F.lit, of)))
    each = df.groupBy(key).agg(F.count(y).alias("n"), q.alias("_q"), F.min(y).alias("min"), F.max(y).alias("max"))
    at = lambda p: F.col("_q")[of.index(p)]
    stats = {"median": (at(0.5), 8), "q10": (at(0.1), 20), "q90": (at(0.9), 20), "iqr": (at(0.75) - at(0.25), 12), "min": (F.col("min"), 8), "max": (F.col("max"), 8)}
    return each.select(key, *(F.when(F.col("n") >= least, c).otherwise(F.lit(whole[n])).alias(n) for n, (c, least) in stats.items()))


def union_frequency(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """(value, frequency): share of a value in both frames together; a null counts under the text nan."""
    both = train.select(text_of(col).alias("value")).unionByName(test.select(text_of(col).alias("value")))
    n = both.groupBy("value").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("value", (F.col("n") / F.col("all")).alias("frequency"))


def prefix_frequency(df: DataFrame, col: str, sep: str, levels: int) -> DataFrame:
    """(value, frequency): geometric mean, over the first ``levels`` prefixes of separated parts, of the prefixes' shares."""
    n = df.groupBy(text_of(col).alias("value")).agg(F.count("*").alias("n"))
    for i in range(1, levels + 1):
        p = F.array_join(F.slice(F.split("value", sep), 1, i), sep)
        n = n.withColumn(f"_p{i}", p).withColumn(f"_f{i}", F.sum("n").over(Window.partitionBy(f"_p{i}")))
    total = n.agg(F.sum("n").alias("all"))
    logs = sum(F.log(F.col(f"_f{i}") / F.col("all")) for i in range(1, levels + 1)) / levels
    return n.crossJoin(total).select("value", F.exp(logs).alias("frequency"))


def uniqueness_flags(train: DataFrame, test: DataFrame, col: str, y: str) -> DataFrame:
    """(value, flag): once or repeated in training with all targets 0, all 1 or mixed; else new once or repeated."""
    a = train.groupBy(col).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    b = test.groupBy(col).agg(F.count("*").alias("m"))
    few = F.when(F.col("n") == 1, F.lit("unique")).otherwise(F.lit("repeated"))
    seen = F.when(F.col("s") == 0, F.concat(few, F.lit("_0"))).when(F.col("s") == F.col("n"), F.concat(few, F.lit("_1"))).otherwise(F.lit("repeated_mixed"))
    new = F.when(F.col("m") == 1, F.lit("new_unique")).otherwise(F.lit("new_repeated"))
    return a.join(b, col, "full_outer").select(col, F.when(F.col("n").isNotNull(), seen).otherwise(new).alias("flag"))


def synthetic_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Marks rows none of whose values is the only one of its kind in its column."""
    out, some = df, F.lit(False)
    for c in cols:
        single = df.groupBy(c).agg(F.count("*").alias(f"_n_{c}"))
        out = out.join(single, c, "left")
        some = some | (F.col(f"_n_{c}") == 1)
    return out.withColumn("synthetic", (~some).cast("int")).drop(*(f"_n_{c}" for c in cols))


def collapse_rare(df: DataFrame, col: str, least: int, other: str = "other") -> DataFrame:
    """Values of fewer than ``least`` rows become ``other``."""
    keep = df.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(col, F.lit(1).alias("_k"))
    return df.join(keep, col, "left").withColumn(f"{col}_kept", F.when(F.col("_k") == 1, F.col(col)).otherwise(F.lit(other))).drop("_k")


def collapse_rare_by_target(df: DataFrame, col: str, y: str, least: int, z: float = 1.96, other: str = "other") -> DataFrame:
    """(value, kept): rare values stay if their log odds differ from all rows' by ``z`` standard errors, with 0.5 added to counts."""
    n, s = F.count(y), F.sum(y)
    each = df.groupBy(col).agg(n.alias("n"), s.alias("s")).crossJoin(df.agg(n.alias("all_n"), s.alias("all_s")))
    odds = F.log((F.col("s") + 0.5) / (F.col("n") - F.col("s") + 0.5)) - F.log((F.col("all_s") + 0.5) / (F.col("all_n") - F.col("all_s") + 0.5))
    error = F.sqrt(1 / (F.col("s") + 0.5) + 1 / (F.col("n") - F.col("s") + 0.5))
    return each.select(F.col(col).alias("value"), F.when((F.col("n") >= least) | (F.abs(odds / error) >= z), F.col(col)).otherwise(F.lit(other)).alias("kept"))


def rebin_by_skew(train: DataFrame, test: DataFrame, col: str, ratio: float = 2.0, other: str = "other") -> DataFrame:
    """(value, bin): values whose shares in the frames differ by more than ``ratio``, or that one frame lacks, become ``other``."""
    from .joins import count_shift

    r = F.col("ratio")
    return count_shift(train, test, col).select(F.col(col).alias("value"), F.when(r.isNotNull() & (r <= ratio) & (r >= 1 / ratio), F.col(col)).otherwise(F.lit(other)).alias("bin"))


def regime_impute(df: DataFrame, value: str, regime: str, finer: str | None = None) -> DataFrame:
    """Nulls filled by the median of (regime, finer), then of the regime, then of all; with a flag of what was missing."""
    levels = ([[regime, finer]] if finer else []) + [[regime]]
    out, fills = df, [F.col(value)]
    for i, keys in enumerate(levels):
        out = out.join(df.groupBy(*keys).agg(F.median(value).alias(f"_m{i}")), keys, "left")
        fills.append(F.col(f"_m{i}"))
    out = out.withColumn("_all", F.lit(quantiles(df, value, [0.5])[0]).cast("double"))
    return out.withColumn(f"{value}_was_missing", F.col(value).isNull().cast("int")).withColumn(f"{value}_filled", F.coalesce(*fills, "_all")).drop("_all", *(f"_m{i}" for i in range(len(levels))))


def fit_imputes(df: DataFrame, cols: list[str], how: str = "mean") -> dict:
    """{column: fill} by mean, median or mode (ties: the least)."""
    if how == "median":
        return {c: quantiles(df, c, [0.5])[0] for c in cols}
    of = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}[how]
    return df.agg(*(of(c).alias(c) for c in cols)).first().asDict()


def apply_imputes(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in fills}).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def fit_bounds(df: DataFrame, col: str, rule: str = "auto") -> tuple[float, float]:
    """Outlier bounds: iqr (1.5 ranges beyond the quartiles), mad (3 * 1.4826 deviations about the median), sd (3 about the mean); auto
    takes iqr where the absolute skewness is above 1, else sd."""
    if rule == "auto":
        rule = "iqr" if abs(df.agg(F.skewness(col)).first()[0] or 0) > 1 else "sd"
    if rule == "iqr":
        q1, q3 = quantiles(df, col, [0.25, 0.75])
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    if rule == "mad":
        med = quantiles(df, col, [0.5])[0]
        d = 3 * 1.4826 * quantiles(df, F.abs(F.col(col) - F.lit(med)), [0.5])[0]
        return med - d, med + d
    m, s = df.agg(F.avg(col), F.stddev_samp(col)).first()
    return m - 3 * s, m + 3 * s


def cap(df: DataFrame, col: str, bounds: tuple[float, float], to_null: bool = False) -> DataFrame:
    lo, hi = map(F.lit, bounds)
    inside = F.when(F.col(col).between(lo, hi), F.col(col)) if to_null else F.least(F.greatest(F.col(col), lo), hi)
    return df.withColumn(f"{col}_capped", F.when(F.col(col).isNotNull(), inside))


def out_of_range_share(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """``test`` with the share of columns whose values leave the training range; nulls don't."""
    ends = train.agg(*(F.min(c).alias(f"_lo_{c}") for c in cols), *(F.max(c).alias(f"_hi_{c}") for c in cols))
    out = sum(F.coalesce(((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))).cast("int"), F.lit(0)) for c in cols)
    return test.crossJoin(ends).withColumn("out_share", out / len(cols)).drop(*(f"_{e}_{c}" for e in ("lo", "hi") for c in cols))
