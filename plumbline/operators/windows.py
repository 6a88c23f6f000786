"""Per-entity windows. Every operator takes an explicit order; features of one call share one sort."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dominance import causal_rank  # noqa: F401  a rank along an entity


def named(g: pd.DataFrame, key: str, n: int = 1) -> pd.Series:
    """A group's key, ``n`` times; of type object, as Arrow can't take a column of pandas' own strings from a new frame here."""
    at = g[key].iloc[0]
    return pd.Series([None if pd.isna(at) else at] * n, dtype=object)


def by(entity: str | list[str], order: list[str]):
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*order)


#: Rows that a task sorts about, where partitions are made for that.
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as its rows need, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(8, df.count() // TASK_ROWS), *keys)


def shift_diff(df: DataFrame, entity: str, order: list[str], cols: list[str], lags: tuple[int, ...] = (1,)) -> DataFrame:
    """Values ``lags`` rows back and the differences from them; null in an entity's first rows."""
    w = by(entity, order)
    for c in cols:
        for n in lags:
            df = df.withColumn(f"{c}_lag{n}", F.lag(c, n).over(w)).withColumn(f"{c}_diff{'' if n == 1 else f'_lag{n}'}", F.col(c) - F.lag(c, n).over(w))
    return df


def average_rank(value: str | Column, groups: list[str], descending: bool = False) -> Column:
    """Rank from 1 with ties averaged."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*groups).orderBy(v.desc() if descending else v.asc())
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*groups, v)) - 1) / 2


def group_rank(df: DataFrame, entity: str, value: str, tiebreak: list[str]) -> DataFrame:
    """Average rank, its share of the group's size, and the ordinal rank with ties settled by ``tiebreak``."""
    n = F.count("*").over(Window.partitionBy(entity))
    return dealt(df, [entity]).withColumn("rank_avg", average_rank(value, [entity])).withColumn("rank_pct", F.col("rank_avg") / n).withColumn("rank_ord", F.row_number().over(by(entity, [value, *tiebreak])))


def cumulative_counts(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Counts forward and in reverse, and the running sum and maximum."""
    w = by(entity, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(entity))
    out = df.withColumn("cum_count", F.row_number().over(w)).withColumn("cum_count_reverse", (n - F.col("cum_count") + 1).cast("int"))
    return out.withColumn("cum_sum", F.sum(value).over(run)).withColumn("cum_max", F.max(value).over(run))


def rolling(df: DataFrame, entity: str, order: list[str], value: str, width: int, min_periods: int = 1, fns: tuple[str, ...] = ("mean", "sum", "std", "min", "max", "median")) -> DataFrame:
    """Rolling reductions that expand until the window is full; null below ``min_periods`` values."""
    w = by(entity, order).rowsBetween(-(width - 1), 0)
    of = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}

    def median() -> Column:  # Spark's own takes no frame; the frame's values are few
        v = F.array_sort(F.collect_list(value).over(w))
        n = F.size(v)
        return (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2

    for f in fns:
        stat = median() if f == "median" else of[f](value).over(w)
        df = df.withColumn(f"{value}_{f}_{width}", F.when(F.count(value).over(w) >= max(1, min_periods), stat))
    return df


def ma_crossover(df: DataFrame, entity: str, order: list[str], value: str, widths: tuple[int, ...], power: float = 0.0, lag: int = 1) -> DataFrame:
    """Differences of all pairs of moving averages, the weighted sum of their signs (no value: 0), and its change."""
    w = by(entity, order)
    for n in widths:
        df = df.withColumn(f"ma_{n}", F.avg(value).over(w.rowsBetween(-(n - 1), 0)))
    votes = F.lit(0.0)
    for i, s in enumerate(widths):
        for b in widths[i + 1 :]:
            df = df.withColumn(f"ma_diff_{s}_{b}", F.col(f"ma_{s}") - F.col(f"ma_{b}"))
            votes = votes + F.coalesce(F.signum(f"ma_diff_{s}_{b}"), F.lit(0.0)) * float(s) ** power
    df = df.withColumn("vote_sum", votes)
    return df.withColumn("vote_delta", F.col("vote_sum") - F.lag("vote_sum", lag).over(w))


def hull(df: DataFrame, entity: str, order: list[str], value: str, width: int) -> DataFrame:
    """Hull moving average, the mean over sqrt(width) rows of 2 * mean(width / 2) - mean(width), and the deviation from it."""
    w = by(entity, order)
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(-(n - 1), 0))
    raw = df.withColumn("_raw", 2 * mean(value, width // 2) - mean(value, width))
    return raw.withColumn("hull", mean("_raw", max(1, round(math.sqrt(width))))).withColumn("hull_dev", F.col(value) - F.col("hull")).drop("_raw")


def ewma(df: DataFrame, entity: str, order: list[str], value: str, alphas: tuple[float, ...], key: str) -> DataFrame:
    """(key, ewma_<alpha>...): out = alpha * value + (1 - alpha) * out, from an entity's first value on; null and non-finite values
    count as 0. A recursion along each entity: its rows are a stream in order, of which one number for each alpha is carried on, so
    an entity may be of any length."""
    names = [f"ewma_{a:g}".replace(".", "_") for a in alphas]

    def run(batches):
        last: list[float] = []
        for b in batches:
            v = b["_v"].to_numpy(float)
            first = b["_first"].to_numpy(bool)
            group = np.cumsum(first)
            out = {key: b[key]}
            for i, (n, a) in enumerate(zip(names, alphas, strict=True)):
                carried = [] if first[:1].all() else [last[i]]  # goes on with the entity of the batch before
                x, g = np.concatenate([carried, v]), np.concatenate([group[:1] if carried else [], group])
                out[n] = pd.Series(x).groupby(g).ewm(alpha=a, adjust=False).mean().to_numpy()[len(carried) :]
            if len(v):
                last = [float(out[n][-1]) for n in names]
                yield pd.DataFrame(out)

    v = F.col(value).cast("double")
    clean = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    first = F.row_number().over(by(entity, order)) == 1
    rows = df.select(*dict.fromkeys([entity, *order, key]), clean.alias("_v")).withColumn("_first", first).sortWithinPartitions(entity, *order)
    return rows.select(key, "_v", "_first").mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{n} double" for n in names))


def adaptive_ewma(df: DataFrame, entity: str, order: list[str], value: str, alphas: tuple[float, ...], tail: int = 20) -> DataFrame:
    """(entity, alpha, sse): the alpha whose smoothed value best foretells the next one, over an entity's last ``tail`` steps."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order, kind="stable")[value].astype(float).fillna(0.0)
        errors = [float(((v - v.ewm(alpha=a, adjust=False).mean().shift()).iloc[1:].tail(tail) ** 2).sum()) for a in alphas]
        best = int(np.argmin(errors))
        return pd.DataFrame({entity: named(g, entity), "alpha": [alphas[best]], "sse": [errors[best]]})

    return df.select(*dict.fromkeys([entity, *order, value])).groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, alpha double, sse double")


def state_duration(df: DataFrame, entity: str, order: list[str], state: Column) -> DataFrame:
    """Rows in a row with the state (possession), without it since it last held (cancellation), and the activations so far.
    Both are null before the first activation."""
    w = by(entity, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_s", F.coalesce(state.cast("int"), F.lit(0))).withColumn("_rn", F.row_number().over(w))
    s = s.withColumn("_was", F.coalesce(F.lag("_s").over(w), F.lit(0)))
    s = s.withColumn("activations", F.sum(((F.col("_s") == 1) & (F.col("_was") == 0)).cast("int")).over(run))
    s = s.withColumn("_off", F.max(F.when(F.col("_s") == 0, F.col("_rn"))).over(run)).withColumn("_on", F.max(F.when(F.col("_s") == 1, F.col("_rn"))).over(run))
    begun = F.col("activations") > 0
    out = s.withColumn("possession", F.when(begun, F.when(F.col("_s") == 1, F.col("_rn") - F.coalesce("_off", F.lit(0))).otherwise(0)))
    return out.withColumn("cancellation", F.when(begun, F.when(F.col("_s") == 0, F.col("_rn") - F.col("_on")).otherwise(0))).drop("_s", "_rn", "_was", "_off", "_on")


def state_history(df: DataFrame, entity: str, order: list[str], state: str, k: int = 2) -> DataFrame:
    """The last ``k`` completed states before a row's own run, and their lengths in rows; "-1" and 0 where there are none."""
    w = by(entity, order)
    new = (F.coalesce(F.lag(state).over(w) != F.col(state), F.lit(True))).cast("int")
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy(entity, "_run").agg(F.min(state).alias("_state"), F.count("*").alias("_len"))
    back = Window.partitionBy(entity).orderBy("_run")
    cols = [F.coalesce(F.lag("_state", i).over(back), F.lit("-1")).alias(f"state_{i}") for i in range(1, k + 1)]
    cols += [F.coalesce(F.lag("_len", i).over(back), F.lit(0)).alias(f"length_{i}") for i in range(1, k + 1)]
    return runs.join(each.select(entity, "_run", *cols), [entity, "_run"]).drop("_new", "_run")


def merge_short_states(df: DataFrame, entity: str, order: list[str], state: str, key: str, least: int = 2) -> DataFrame:
    """(key, state) with runs shorter than ``least`` rows, but for the first, taken into the run before them, the shortest and
    earliest first, until none is left."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        runs: list[list] = []
        for s in g[state]:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        while True:
            short = [(n, i) for i, (_, n) in enumerate(runs) if i and n < least]
            if not short:
                break
            _, i = min(short)
            runs[i - 1][1] += runs.pop(i)[1]
            if i < len(runs) and runs[i][0] == runs[i - 1][0]:
                runs[i - 1][1] += runs.pop(i)[1]
        return pd.DataFrame({key: g[key].astype(object), state: pd.Series([s for s, n in runs for _ in range(n)], index=g.index, dtype=object)})

    return df.select(*dict.fromkeys([entity, *order, state, key])).groupBy(entity).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {state} string")


def same_value_features(df: DataFrame, entity: str, order: list[str], value: str, time: str) -> DataFrame:
    """Whether a row has its entity's most frequent value (ties: the least), its occurrence index, and seconds since that value last came."""
    counts = df.groupBy(entity, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(entity).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("_mode"))
    w = by([entity, value], order)
    out = df.join(best, entity).withColumn("mode_match", (F.col(value) == F.col("_mode")).cast("int")).withColumn("occurrence", F.row_number().over(w) - 1)
    us = F.expr(f"unix_micros(cast({time} as timestamp))")
    return out.withColumn("gap", (us - F.lag(us).over(w)) / 1e6).drop("_mode")


def rolling_target_correlation(df: DataFrame, entity: str, order: list[str], features: list[str], target: str, width: int) -> DataFrame:
    """Trailing correlations of each feature's last value with the target's, and the feature of the largest absolute one."""
    w = by(entity, order)
    frame = w.rowsBetween(-(width - 1), 0)
    df = df.withColumn("_y", F.lag(target).over(w))
    for f in features:
        df = df.withColumn("_x", F.when(F.col("_y").isNotNull(), F.lag(f).over(w)))
        spread = F.stddev_pop("_x").over(frame) * F.stddev_pop(F.when(F.col("_x").isNotNull(), F.col("_y"))).over(frame)
        df = df.withColumn(f"corr_{f}", F.when(spread > 1e-12, F.covar_pop("_x", "_y").over(frame) / F.nullif(spread, F.lit(0.0))))
    size = F.array(*(F.coalesce(F.abs(f"corr_{f}"), F.lit(-1.0)) for f in features))
    names = F.array(*map(F.lit, features))
    return df.withColumn("best", F.when(F.array_max(size) >= 0, F.element_at(names, F.array_position(size, F.array_max(size)).cast("int")))).drop("_x", "_y")


def panel_pivot(df: DataFrame, entity: str, order: list[str], value: str, max_lags: int, time: str | None = None) -> DataFrame:
    """One row an entity: its latest ``max_lags`` values (lag 0 the last), gaps in days between them, and mean and count of the
    older ones. Conditional aggregates, so no pivot job and no collected names."""
    rn = F.row_number().over(Window.partitionBy(entity).orderBy(*(F.desc(c) for c in order))) - 1
    rows = df.withColumn("_lag", rn)
    cols = [F.max(F.when(F.col("_lag") == i, F.col(value))).alias(f"{value}_lag{i}") for i in range(max_lags)]
    cols += [F.avg(F.when(F.col("_lag") >= max_lags, F.col(value))).alias(f"{value}_older_mean"), F.count(F.when(F.col("_lag") >= max_lags, F.col(value))).alias(f"{value}_older_count")]
    if time:
        at = lambda i: F.max(F.when(F.col("_lag") == i, F.expr(f"unix_micros(cast({time} as timestamp))")))
        cols += [((at(i) - at(i + 1)) / 86400e6).alias(f"gap_{i}") for i in range(max_lags - 1)]
    return rows.groupBy(entity).agg(*cols)


def recency_weight(i: Column, d: Column, kind: str, param: float) -> Column:
    """Weight of the i-th newest (from 1) of d rows: poly ((d - i + 1) / d)^p, exp p^i, power i^-p."""
    p = F.lit(float(param))
    return {"poly": F.pow((d - i + 1) / d, p), "exp": F.pow(p, i), "power": F.pow(i, -p)}[kind]


def recency_aggregate(df: DataFrame, entity: str, order: list[str], value: str, kind: str = "poly", param: float = 1.0) -> DataFrame:
    """Weighted mean, the sum and extremes of weighted values, and the weighted spread (sample form) by recency."""
    i = F.row_number().over(Window.partitionBy(entity).orderBy(*(F.desc(c) for c in order)))
    rows = df.select(entity, value, i.alias("_i"), F.count("*").over(Window.partitionBy(entity)).alias("_d"))
    x = F.col(value) * recency_weight(F.col("_i"), F.col("_d"), kind, param)
    w = recency_weight(F.col("_i"), F.col("_d"), kind, param)
    rows = rows.select(entity, x.alias("_x"), w.alias("_w"))
    return rows.groupBy(entity).agg(
        (F.sum("_x") / F.sum("_w")).alias("wmean"), F.sum("_x").alias("wsum"), F.min("_x").alias("wmin"), F.max("_x").alias("wmax"), F.stddev_samp("_x").alias("wstd")
    )


def autocorrelation(df: DataFrame, entity: str, order: list[str], value: str, lags: int) -> DataFrame:
    """(entity, lag, acf, significant): biased autocorrelation against the band 1.96 / sqrt(n). One sort; sums of products with ``lag``."""
    w = by(entity, order)
    c = df.select(entity, *order, value).withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(entity)))
    for k in range(1, lags + 1):
        c = c.withColumn(f"_p{k}", F.col("_c") * F.lag("_c", k).over(w))
    sums = c.groupBy(entity).agg(F.count("*").alias("n"), F.sum(F.col("_c") ** 2).alias("v"), *(F.sum(f"_p{k}").alias(f"p{k}") for k in range(1, lags + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.nullif("v", F.lit(0.0))).alias("acf")) for k in range(1, lags + 1))))
    return sums.select(entity, "n", each.alias("e")).select(entity, "e.lag", "e.acf", (F.abs("e.acf") > 1.96 / F.sqrt("n")).cast("int").alias("significant"))


def partial_autocorrelation(acf: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion from autocorrelations at lags 1, 2, ..."""
    phi: list[float] = []
    out = []
    for k, r in enumerate(acf):
        top = r - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))
        bottom = 1 - sum(p * acf[j] for j, p in enumerate(phi))
        last = top / bottom if bottom else 0.0
        phi = [p - last * q for p, q in zip(phi, reversed(phi), strict=True)] + [last]
        out.append(last)
    return np.array(out)


def consensus_lags(df: DataFrame, entity: str, order: list[str], value: str, lags: int, share: float = 0.5) -> DataFrame:
    """(lag, share): lags that are significant for at least ``share`` of the entities."""
    found = autocorrelation(df, entity, order, value, lags)
    return found.groupBy("lag").agg(F.avg("significant").alias("share")).where(F.col("share") >= share)


def bin_smooth(df: DataFrame, value: str, edges: list[float], fn: str = "mean") -> DataFrame:
    """``value`` replaced by its bin's mean or median; a bin is the number of edges at or below the value."""
    b = sum((F.col(value) >= e).cast("int") for e in edges)
    binned = df.withColumn("bin", b)
    stat = binned.groupBy("bin").agg((F.avg if fn == "mean" else F.median)(value).alias("smoothed"))
    return binned.join(F.broadcast(stat), "bin")  # a row for each bin


def change_points(df: DataFrame, entity: str, order: list[str], value: str, penalty: float, least: int = 2, effect: float = 0.0) -> DataFrame:
    """(entity, at): starts of new segments by exact pruned dynamic programming of squared error plus ``penalty`` a segment. Rows with a
    null or NaN are in no segment; ``at`` counts all rows. With ``effect``, a start stays only if the means of the segments on its
    two sides differ by at least so many of the entity's deviations (of all its values); the segments aren't joined anew."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        every = g.sort_values(order, kind="stable")[value].to_numpy(float, na_value=np.nan)
        where = np.flatnonzero(~np.isnan(every))
        v = every[where]
        n = len(v)
        s, q = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
        best, came, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
        best[0] = -penalty
        for end in range(least, n + 1):
            use = open_[open_ <= end - least]
            size = end - use
            cost = best[use] + (q[end] - q[use]) - (s[end] - s[use]) ** 2 / size
            i = int(np.argmin(cost))
            best[end], came[end] = cost[i] + penalty, use[i]
            stay = np.concatenate([use[cost <= best[end]], open_[open_ > end - least]])
            open_ = np.append(stay, end)
        out, at = [], n if n >= least else 0
        while at and came[at]:
            out.append(int(came[at]))
            at = came[at]
        cuts = [0, *sorted(out), n]
        means = [(s[b] - s[a]) / (b - a) if b > a else 0.0 for a, b in zip(cuts, cuts[1:], strict=False)]
        out = [c for i, c in enumerate(cuts[1:-1]) if abs(means[i + 1] - means[i]) >= effect * v.std()]
        return pd.DataFrame({entity: named(g, entity, len(out)), "at": where[out].astype(int) if out else []})

    return df.select(*dict.fromkeys([entity, *order, value])).groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, at int")


def density_mode(df: DataFrame, entity: str, order: list[str], value: str, half_life: float = 10.0, grid: int = 64) -> DataFrame:
    """(entity, mode, peak): mode of a recency-weighted Gaussian density on a grid from least to largest value, Silverman's width."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(order, kind="stable")[value].dropna().to_numpy(float)
        mode = peak = None
        if len(v):
            w = 0.5 ** (np.arange(len(v))[::-1] / half_life)
            width = 1.06 * v.std() * len(v) ** -0.2
            if width <= 0:
                mode, peak = float(v[-1]), 1.0
            else:
                xs = np.linspace(v.min(), v.max(), grid)
                d = (w * np.exp(-0.5 * ((xs[:, None] - v) / width) ** 2)).sum(axis=1) / (w.sum() * width * np.sqrt(2 * np.pi))
                mode, peak = float(xs[d.argmax()]), float(d.max())
        return pd.DataFrame({entity: named(g, entity), "mode": [mode], "peak": [peak]})

    return df.select(*dict.fromkeys([entity, *order, value])).groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, mode double, peak double")


def cumsum_to_amount(df: DataFrame, entity: str, order: list[str], value: str, amount: float, use_abs: bool = False) -> DataFrame:
    """Position (from 0 in its entity) of the first row at which the sum from a row on reaches ``amount``; null if never.

    Sums of absolute or non-negative values never fall, so two pointers suffice; else a scan ahead. Grouped pandas."""
    kind = f"{df.schema.simpleString()[7:-1]},reaches:bigint".replace(":", " ")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        v = g[value].fillna(0).to_numpy(float)
        v = np.abs(v) if use_abs else v
        total, out = np.concatenate([[0], np.cumsum(v)]), []
        rising = bool((v >= 0).all())
        for i in range(len(v)):
            if rising:
                j = int(np.searchsorted(total[i + 1 :], total[i] + amount - 1e-9))
            else:
                hit = np.flatnonzero(total[i + 1 :] >= total[i] + amount - 1e-9)
                j = int(hit[0]) if len(hit) else len(v)
            out.append(i + j if i + j < len(v) else None)
        return g.assign(reaches=pd.array(out, dtype="Int64"))

    return df.groupBy(entity).applyInPandas(run, kind)


def best_positions(df: DataFrame, entity: str, order: list[str], price: str, fee: float = 0.0) -> DataFrame:
    """(entity, step, position, profit): positions -1, 0 or 1 for each step between prices with the largest total profit, a change
    of position costing ``fee`` of the price for each unit. Dynamic programming along each entity. Rows with a null or NaN price are
    passed over: a step goes from a known price to the next known one, and the steps from rows without a price are null."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        every = g.sort_values(order, kind="stable")[price].to_numpy(float, na_value=np.nan)
        where = np.flatnonzero(~np.isnan(every))
        p = every[where]
        moves, states = np.diff(p), np.array([0, 1, -1])
        worth, came = np.array([0.0, -np.inf, -np.inf]), []
        for i, m in enumerate(moves):
            to = worth[None, :] - fee * p[i] * np.abs(states[:, None] - states[None, :])
            came.append(to.argmax(axis=1))
            worth = to.max(axis=1) + states * m
        at, path = int(worth.argmax()) if len(moves) else 0, []
        for c in reversed(came):
            path.append(at)
            at = int(c[at])
        held = states[path[::-1]] if path else np.empty(0, int)
        steps = max(len(every) - 1, 0)
        position, profit = np.full(steps, None, object), np.full(steps, None, object)
        position[where[:-1]], profit[where[:-1]] = held, held * moves
        return pd.DataFrame({entity: named(g, entity, steps), "step": np.arange(steps), "position": position, "profit": profit})

    return df.select(*dict.fromkeys([entity, *order, price])).groupBy(entity).applyInPandas(run, f"{entity} {dict(df.dtypes)[entity]}, step int, position int, profit double")
