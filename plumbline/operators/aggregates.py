"""Grouped aggregates, drift and leak scans, and information measures over counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.shared import kept_table
from .quantiles import quantiles


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population variance and deviation, skewness and excess kurtosis (population forms)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def value_counts(df: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """For each key: number of distinct values, mean and largest of their counts, and the ``top`` values with their counts, most
    frequent first (ties: the least value)."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    pick = [F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{o}_{i}") for i in range(1, top + 1) for c, o in ((value, "value"), ("n", "count"))]
    return n.withColumn("r", rank).groupBy(key).agg(F.count("*").alias("n_distinct"), F.avg("n").alias("mean_count"), F.max("n").alias("max_count"), *pick)


def binned_unique(df: DataFrame, key: str, value: str, edges: list[float]) -> DataFrame:
    """Number of distinct bins that a key's values visit; a bin is the number of edges at or below the value, nulls have none."""
    b = F.when(F.col(value).isNotNull(), sum((F.col(value) >= e).cast("int") for e in edges))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(b).alias("bins"))


def edge_diff(df: DataFrame, entity: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of an entity's first n and last n values, their difference and ratio (null if the first is 0)."""
    up = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(entity).orderBy(*(F.desc(c) for c in order)))
    rows = df.select(entity, value, up.alias("_u"), down.alias("_d"))
    out = rows.groupBy(entity).agg(F.avg(F.when(F.col("_u") <= n, F.col(value))).alias("first"), F.avg(F.when(F.col("_d") <= n, F.col(value))).alias("last"))
    return out.withColumn("diff", F.col("last") - F.col("first")).withColumn("ratio", F.col("last") / F.nullif("first", F.lit(0.0)))


def group_bias(df: DataFrame, key: str, y: str, p: str, least: int = 20, shrink: float = 0.0, clip: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(key, ratio): mean target over mean prediction, drawn to the overall ratio by n / (n + shrink), clipped; 1 for small groups
    and predictions of mean 0."""
    a = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(y).alias("y"), F.avg(p).alias("p"))
    whole = df.agg((F.avg(y) / F.nullif(F.avg(p), F.lit(0.0))).alias("g"))
    raw = F.coalesce(F.col("y") / F.nullif("p", F.lit(0.0)), F.lit(1.0))
    drawn = (F.col("n") * raw + shrink * F.coalesce("g", F.lit(1.0))) / (F.col("n") + shrink) if shrink else raw
    return a.crossJoin(whole).select(key, F.when(F.col("n") < least, F.lit(1.0)).otherwise(F.least(F.greatest(drawn, F.lit(clip[0])), F.lit(clip[1]))).alias("ratio"))


def zero_sum(df: DataFrame, key: str, p: str, w: str | Column | None = None, target: float = 0.0) -> DataFrame:
    """Predictions shifted so that each group's weighted sum is ``target``; groups of no weight stay."""
    weight = F.lit(1.0) if w is None else F.col(w) if isinstance(w, str) else w
    g = Window.partitionBy(key)
    total = F.sum(weight).over(g).cast("double")
    shift = (F.sum(weight * F.col(p)).over(g) - target) / F.nullif(total, F.lit(0.0))
    return df.withColumn(f"{p}_adjusted", F.col(p) - F.coalesce(shift, F.lit(0.0)))


def zero_sums(df: DataFrame, keys: list[str], p: str, rounds: int = 100, tol: float = 1e-8) -> DataFrame:
    """Several groupings' sums brought to zero in turn, until the largest is within ``tol`` of the values' largest sum by all keys; an error if
    it isn't after ``rounds`` sweeps. Where all groupings but the largest have at most LEVELS groups together, the offsets that sweeps
    lead to are solved for: the largest grouping's follow from the others', for which a small system is left. A sweep is one job for
    each grouping; what is swept is one offset a group, so rows aren't shuffled: rows are summed by all keys together first."""
    cells = kept_table(df.groupBy(*keys).agg(F.sum(F.col(p).cast("double")).alias("_s"), F.count(p).alias("_n")))
    shifts = _solved(cells, keys) or {k: kept_table(cells.select(k).distinct().withColumn(f"_d_{i}", F.lit(0.0))) for i, k in enumerate(keys)}

    def with_shifts(t: DataFrame) -> DataFrame:
        for k, d in shifts.items():
            t = t.join(d.withColumnRenamed(k, f"_k_{k}"), F.col(k).eqNullSafe(F.col(f"_k_{k}")), "left").drop(f"_k_{k}")
        return t.withColumn("_shift", sum(F.coalesce(f"_d_{i}", F.lit(0.0)) for i in range(len(keys)))).drop(*(f"_d_{i}" for i in range(len(keys))))

    scale = 1 + (cells.agg(F.max(F.abs("_s"))).first()[0] or 0.0)
    for done in range(rounds + 1):
        left = [with_shifts(cells).groupBy(k).agg(F.sum(F.col("_s") - F.col("_n") * F.col("_shift")).alias("x")).agg(F.max(F.abs("x"))).first()[0] for k in keys]
        if max((x or 0.0 for x in left), default=0.0) < tol * scale:
            break
        for i, k in enumerate(keys if done < rounds else ()):
            off = with_shifts(cells).groupBy(k).agg((F.sum(F.col("_s") - F.col("_n") * F.col("_shift")) / F.nullif(F.sum("_n"), F.lit(0))).alias("_more"))
            old = shifts[k]
            shifts[k] = kept_table(old.join(off.withColumnRenamed(k, "_k"), F.col(k).eqNullSafe(F.col("_k")), "left").select(k, (F.col(f"_d_{i}") + F.coalesce("_more", F.lit(0.0))).alias(f"_d_{i}")))
    else:
        raise RuntimeError(f"sums are not within {tol} of zero after {rounds} sweeps")
    return with_shifts(df).withColumn(f"{p}_adjusted", F.col(p).cast("double") - F.col("_shift")).drop("_shift")


#: Groups of all groupings but the largest for which offsets are solved for on the driver.
LEVELS = 500


def _solved(cells: DataFrame, keys: list[str]) -> dict[str, DataFrame] | None:
    """Offsets {key: (key, _d_i)} that bring all sums of ``cells`` (keys, _s, _n) to zero, or None if there are too many small groups."""
    counts = cells.agg(*(F.count_distinct(F.struct(k)).alias(k) for k in keys)).first()
    big = max(keys, key=lambda k: counts[k])
    small = [k for k in keys if k != big]
    if not small or sum(counts[k] for k in small) > LEVELS:
        return None
    spark, placed, levels = cells.sparkSession, cells.withColumn("_s", F.coalesce("_s", F.lit(0.0))), []
    for k in small:
        values = [(r[0], len(levels) + i) for i, r in enumerate(cells.select(k).distinct().collect())]
        at = spark.createDataFrame(values, f"`_k` {dict(cells.dtypes)[k]}, `_i_{k}` int")
        placed = placed.join(F.broadcast(at), F.col(k).eqNullSafe(F.col("_k")), "left").drop("_k")  # at most LEVELS rows
        levels += [(k, v) for v, _ in values]
    placed = placed.withColumn("_is", F.array(*(f"_i_{k}" for k in small)))
    own = placed.groupBy(big).agg(F.sum("_s").alias("_bs"), F.sum("_n").alias("_bn"))
    parts = placed.select(F.col(big).alias("_b"), "_n", F.explode("_is").alias("i")).groupBy("_b", "i").agg(F.sum("_n").alias("n"))
    parts = kept_table(parts.join(own, F.col("_b").eqNullSafe(F.col(big))).select("_b", "i", "n", "_bs", "_bn").where("_bn > 0"))
    left, right, m = np.zeros((len(levels),) * 2), np.zeros(len(levels)), len(levels)
    both = placed.select("_n", F.explode("_is").alias("i"), "_is").select("_n", "i", F.explode("_is").alias("j")).groupBy("i", "j").agg(F.sum("_n").alias("n"))
    for i, j, n in both.collect():
        left[i, j] += n
    grouped = parts.groupBy("_b").agg(F.collect_list(F.struct("i", "n")).alias("l"), F.first("_bn").alias("_bn"))  # at most LEVELS entries
    met = grouped.select("_bn", F.explode("l").alias("a"), "l").select("_bn", "a", F.explode("l").alias("c"))
    for i, j, n in met.groupBy(F.col("a.i").alias("i"), F.col("c.i").alias("j")).agg(F.sum(F.col("a.n").cast("double") * F.col("c.n") / F.col("_bn")).alias("n")).collect():
        left[i, j] -= n
    for i, s in placed.select("_s", F.explode("_is").alias("i")).groupBy("i").agg(F.sum("_s")).collect():
        right[i] += s
    for i, s in parts.groupBy("i").agg(F.sum(F.col("n") * F.col("_bs") / F.col("_bn"))).collect():
        right[i] -= s
    d = np.linalg.lstsq(left, right, rcond=1e-12)[0]
    out = {k: spark.createDataFrame([(v, float(d[i])) for i, (c, v) in enumerate(levels) if c == k], f"`{k}` {dict(cells.dtypes)[k]}, `_d_{keys.index(k)}` double") for k in small}
    by_level = F.create_map(*(x for i in range(m) for x in (F.lit(i), F.lit(float(d[i])))))
    taken = parts.groupBy("_b").agg(((F.first("_bs") - F.sum(F.col("n") * by_level[F.col("i")])) / F.first("_bn")).alias("_d"))
    name = f"_d_{keys.index(big)}"
    out[big] = kept_table(own.join(taken, F.col(big).eqNullSafe(F.col("_b")), "left").select(big, F.coalesce("_d", F.lit(0.0)).alias(name)))
    return out


def geometric_median(df: DataFrame, cols: list[str], rounds: int = 200, tol: float = 1e-7) -> tuple[float, ...]:
    """The point of least summed Euclidean distance, by Newton's and Weiszfeld's steps from the means, of the length that lessens the sum
    most; two aggregates a round over distinct points. The point nearest to a place is tried itself: it is the median if its
    own weight outweighs the pull of all others. An error if it still moves by more than ``tol`` after ``rounds``.
    Rows with a null don't count; without rows all is null."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).na.drop()
    at = tuple(rows.agg(*(F.avg(c) for c in cols)).first())
    if at[0] is None:
        return at
    points, k, pairs = kept_table(rows.groupBy(*cols).agg(F.count("*").alias("_n"))), len(cols), [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def pull(x: tuple[float, ...]) -> list[Column]:
        """Of a place: rows on it, sum of distances, of their inverses, of unit vectors to it, and of their products over distances."""
        v = [F.col(c) * -1 + F.lit(a) for c, a in zip(cols, x, strict=True)]
        d = F.sqrt(sum((e * e for e in v), F.lit(0.0)))
        inverse = F.when(d > 0, F.col("_n") / d).otherwise(F.lit(0.0))
        square = F.when(d > 0, F.col("_n") / d / d / d).otherwise(F.lit(0.0))
        return [F.sum(F.when(d == 0, F.col("_n")).otherwise(F.lit(0))), F.sum(F.col("_n") * d), F.sum(inverse), *(F.sum(inverse * e) for e in v), *(F.sum(square * v[i] * v[j]) for i, j in pairs)]

    away = lambda x: F.sqrt(sum(((F.col(c) - F.lit(a)) * (F.col(c) - F.lit(a)) for c, a in zip(cols, x, strict=True)), F.lit(0.0)))
    size, tried, beside = 3 + k + len(pairs), set(), None
    for _ in range(rounds):
        got = points.agg(F.min_by(F.struct(*cols), away(at)), *pull(at), *(pull(beside) if beside else [])).first()
        nearest, here, there = tuple(got[0]), got[1 : 1 + size], got[1 + size :]
        if beside and np.linalg.norm(there[3 : 3 + k]) <= there[0] * (1 + 1e-12):
            return beside
        on, total, inverse = here[:3]
        g = np.array(here[3 : 3 + k])
        if np.linalg.norm(g) <= on:
            return at
        beside = None if nearest in tried else nearest
        tried.add(nearest)
        hessian = inverse * np.eye(k)
        for (i, j), v in zip(pairs, here[3 + k :], strict=True):
            hessian[i, j] -= v
            hessian[j, i] = hessian[i, j]
        slow, bends = -g / inverse * (1 - on / np.linalg.norm(g)), np.linalg.eigvalsh(hessian)
        newton = slow if on or bends[0] <= 1e-12 * bends[-1] else -np.linalg.solve(hessian, g)
        steps = [newton, *(newton * 2.0**i for i in range(-24, 4) if i), *(slow * 2.0**i for i in range(12))]
        places = [tuple(float(a + b) for a, b in zip(at, step, strict=True)) for step in steps]
        sums = points.agg(*(F.sum(F.col("_n") * away(x)) for x in places)).first()
        best = 0 if sums[0] <= min(sums) + 1e-13 * total else int(np.argmin(sums))  # near the end sums don't differ, the gradient does
        at = places[best]
        if np.linalg.norm(newton) <= tol:
            return at
    raise RuntimeError(f"the point still moves after {rounds} rounds")


def collapse(df: DataFrame, entity: str, p: str, q: float | None = None) -> DataFrame:
    """Every row's prediction replaced by its entity's mean or quantile. An aggregate joined back, which AQE can split."""
    stat = df.groupBy(entity).agg((F.avg(p) if q is None else F.percentile(p, F.lit(q))).alias(f"{p}_collapsed"))
    return df.join(stat, entity)


def weighted_quantile(df: DataFrame, entity: str, p: str, w: str, q: float) -> DataFrame:
    """(entity, quantile): linear interpolation at the mid-points (running weight - w / 2) / total."""
    o = Window.partitionBy(entity).orderBy(p, w)
    c = df.select(entity, p, w, ((F.sum(w).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col(w) / 2) / F.sum(w).over(Window.partitionBy(entity))).alias("_at"))
    c = c.withColumn("_n", F.lead("_at").over(Window.partitionBy(entity).orderBy("_at", p))).withColumn("_np", F.lead(p).over(Window.partitionBy(entity).orderBy("_at", p)))
    share = (q - F.col("_at")) / F.nullif(F.col("_n") - F.col("_at"), F.lit(0.0))
    inside = F.when((F.col("_at") <= q) & (F.col("_n") > q), F.col(p) + share * (F.col("_np") - F.col(p)))
    ends = c.groupBy(entity).agg(F.max(inside).alias("_in"), F.min("_at").alias("_first"), F.min(p).alias("_low"), F.max(p).alias("_high"))
    return ends.select(entity, F.when(F.col("_first") > q, F.col("_low")).otherwise(F.coalesce("_in", "_high")).alias("quantile"))


def prevalence_drift(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, ratio) of a value's shares, test over train, where both have it."""
    from .joins import count_shift

    out = None
    for c in cols:
        d = count_shift(test, train, c).where("ratio is not null").select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "ratio")
        out = d if out is None else out.unionByName(d)
    return out


def constant_group_scan(df: DataFrame, keys: list[str], y: str, least: int = 20, limit: float = 0.1) -> DataFrame:
    """(column, ratio, leak): least sample variance of the target in a group of ``least`` rows, over its variance in all rows."""
    whole = df.agg(F.var_samp(y).alias("v"))
    out = None
    for k in keys:
        g = df.groupBy(k).agg(F.count(y).alias("n"), F.var_samp(y).alias("g")).where(F.col("n") >= least).agg(F.min("g").alias("g"))
        d = g.crossJoin(whole).select(F.lit(k).alias("column"), (F.col("g") / F.nullif("v", F.lit(0.0))).alias("ratio"))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("leak", (F.col("ratio") < limit).cast("int"))


def quantile_codes(df: DataFrame, col: str, bins: int, name: str) -> DataFrame:
    """Codes 0 .. bins - 1 by interpolated percentiles, values at an edge going right. The edges are ``bins`` - 1 numbers."""
    edges = quantiles(df, col, [i / bins for i in range(1, bins)])
    return df.withColumn(name, sum((F.col(col) >= e).cast("int") for e in sorted(set(edges))))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Plug-in mutual information of two codes in nats, floored at 0. Counts of pairs; margins from these. Rows where a code is
    null don't count."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    nx, ny = n.groupBy(x).agg(F.sum("n").alias("nx")), n.groupBy(y).agg(F.sum("n").alias("ny"))
    total = n.agg(F.sum("n").alias("all"))
    t = n.join(nx, x).join(ny, y).crossJoin(total)
    return t.agg(F.greatest(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("mi"))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """I(X; Y | Z) in nats from three-way counts. Rows where a code is null don't count."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(x, y, z).agg(F.count("*").alias("n"))
    xz, yz, nz = (n.groupBy(*k).agg(F.sum("n").alias(a)) for k, a in (((x, z), "xz"), ((y, z), "yz"), ((z,), "nz")))
    t = n.join(xz, [x, z]).join(yz, [y, z]).join(nz, z).crossJoin(n.agg(F.sum("n").alias("all")))
    return t.agg(F.greatest(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("nz") / (F.col("xz") * F.col("yz")))), F.lit(0.0)).alias("cmi"))


def joint_mutual_information(df: DataFrame, x: str, z: str, y: str) -> DataFrame:
    """I((X, Z); Y) in nats. A null x or z is a value of the pair; rows with a null y don't count."""
    return mutual_information(df.withColumn("_xz", F.struct(F.col(x).alias("x"), F.col(z).alias("z"))), "_xz", y).withColumnRenamed("mi", "jmi")


def entropies(df: DataFrame, x: str) -> DataFrame:
    """Plug-in, Miller-Madow and Chao-Shen entropies of a code, in nats; the last divides by the chance of having been seen, with
    coverage 1 - singletons / n (1 / n short of that if all are singletons). Nulls don't count."""
    n = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"))
    t = n.crossJoin(n.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("long")).alias("f1")))
    p = F.col("n") / F.col("all")
    cover = 1 - F.when(F.col("f1") == F.col("all"), F.col("f1") - 1).otherwise(F.col("f1")) / F.col("all")
    c = cover * p
    return t.agg((-F.sum(p * F.log(p))).alias("plugin"), (-F.sum(p * F.log(p)) + (F.max("k") - 1) / (2 * F.max("all"))).alias("miller_madow"), (-F.sum(c * F.log(c) / (1 - F.pow(1 - c, F.col("all"))))).alias("chao_shen"))


def symmetric_uncertainty(df: DataFrame, x: str, y: str) -> DataFrame:
    """2 * I(X; Y) / (H(X) + H(Y)); 0 if both are constant. Rows where a code is null don't count."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    h = entropies(df, x).select(F.col("plugin").alias("hx")).crossJoin(entropies(df, y).select(F.col("plugin").alias("hy")))
    return mutual_information(df, x, y).crossJoin(h).select(F.coalesce(2 * F.col("mi") / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0)), F.lit(0.0)).alias("su"))


def screen(df: DataFrame, features: list[str], y: str, k: int) -> list[tuple[str, float]]:
    """Greedy choice of ``k`` code columns by relevance less mean redundancy. Each round is one job over all that are left: their
    pair counts are exploded to rows (feature, code, other code). Returns (feature, gain)."""

    def scores(against: str, left: list[str]) -> dict[str, float]:
        long = df.select(F.col(against).cast("string").alias("b"), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("a")) for f in left))).alias("e")).select("b", "e.f", "e.a")
        n = long.groupBy("f", "a", "b").agg(F.count("*").alias("n"))
        w = Window.partitionBy
        t = n.withColumn("na", F.sum("n").over(w("f", "a"))).withColumn("nb", F.sum("n").over(w("f", "b"))).withColumn("all", F.sum("n").over(w("f")))
        mi = t.groupBy("f").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
        return {r["f"]: r["mi"] for r in mi.collect()}

    relevance, redundancy, chosen = scores(y, features), dict.fromkeys(features, 0.0), []
    left = list(features)
    while left and len(chosen) < k:
        gain = {f: relevance[f] - redundancy[f] / max(1, len(chosen)) for f in left}
        best = max(left, key=lambda f: (round(gain[f], 12), f))
        chosen.append((best, gain[best]))
        left.remove(best)
        if left and len(chosen) < k:
            for f, s in scores(best, left).items():
                redundancy[f] += s
    return chosen


def robust_location(df: DataFrame, value: str, trim: float = 0.1) -> DataFrame:
    """Trimmed mean, winsorised mean and median, from the interpolated quantiles at ``trim`` and 1 - ``trim``."""
    lo, mid, hi = quantiles(df, value, [trim, 0.5, 1 - trim])
    v = F.col(value)
    return df.agg(F.avg(F.when(v.between(lo, hi), v)).alias("trimmed"), F.avg(F.least(F.greatest(v, F.lit(lo)), F.lit(hi))).alias("winsorised")).withColumn("median", F.lit(mid).cast("double"))


def m_estimate(df: DataFrame, value: str, k: float = 1.345, rounds: int = 200) -> float | None:
    """Huber's location by reweighting about the median, the scale being 1.4826 median deviations; one aggregate a round, until it
    moves by less than 1e-10 of itself; an error if it still does after ``rounds``. None without values."""
    med = quantiles(df, value, [0.5])[0]
    if med is None:
        return None
    scale = 1.4826 * quantiles(df, F.abs(F.col(value) - F.lit(med)), [0.5])[0] or 1.0
    at = med
    for _ in range(rounds):
        r = F.abs((F.col(value) - F.lit(at)) / F.lit(scale))
        w = F.when(r <= k, F.lit(1.0)).otherwise(k / F.nullif(r, F.lit(0.0)))
        new = df.agg(F.sum(w * F.col(value)) / F.sum(w)).first()[0]
        if abs(new - at) < 1e-10 * max(1, abs(at)):
            return new
        at = new
    raise RuntimeError(f"the location still moves after {rounds} rounds")


def xi_correlation(df: DataFrame, x: str, y: str, key: str, parts: int | None = None) -> DataFrame:
    """Chatterjee's xi: 1 - n * sum |r(i + 1) - r(i)| / (2 * sum l (n - l)), rows in order of x (ties by key), r(i) the number of y at or
    below, l at or above. Rows with a null x or y don't count. Ranks come from counts of distinct values, summed in two levels so that
    no task holds all rows; ranges of x meet at their ends only."""
    df = kept_table(df.select(key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    n = df.count()
    parts = parts or min(MOST_RANGES, max(8, n // RANGE_ROWS))
    order = F.struct(x, key)
    ranked = ranks_by_parts(df, y, parts).withColumn("_part", _part(order, _cuts(df, order, parts)))
    step = ranked.withColumn("_next", F.lead("_le").over(Window.partitionBy("_part").orderBy(x, key)))
    whole = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  sums of products pass 64 bits
    own = step.groupBy("_part").agg(
        F.sum(F.abs(F.col("_next") - F.col("_le"))).alias("d"), F.sum(whole("_ge") * (F.lit(n).cast("decimal(19,0)") - whole("_ge"))).alias("l"),
        F.min_by("_le", order).alias("first"), F.max_by("_le", order).alias("last"),
    )
    seams = own.withColumn("s", F.abs(F.lead("first").over(Window.orderBy("_part")) - F.col("last")))  # a row for each part
    return seams.agg((1 - float(n) * (F.coalesce(F.sum("d"), F.lit(0)) + F.coalesce(F.sum("s"), F.lit(0))) / (2 * F.sum("l").cast("double"))).alias("xi"))


#: Rows that a range of a global order holds about, and ranges at most, since each is a leaf of an expression and a number on the driver;
#: beyond both a range gets longer, and its sort spills. Results never hang on how many ranges there are.
RANGE_ROWS, MOST_RANGES = 500_000, 1024


def parts_of(df: DataFrame) -> int:
    return min(MOST_RANGES, max(8, df.count() // RANGE_ROWS))


def _cuts(df: DataFrame, col: str | Column, parts: int) -> list:
    """At most ``parts`` - 1 values that cut the column into ranges of about equal size; results never hang on where they lie."""
    if isinstance(col, str) and dict(df.dtypes)[col] in ("double", "float", "bigint", "int", "smallint", "tinyint"):
        return sorted(set(df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.2 / parts)))
    col = F.col(col) if isinstance(col, str) else col
    n = max(1, df.count())
    drawn = df.select(col.alias("c")).where("c is not null").sample(min(1.0, 50 * parts / n), 1).orderBy("c").limit(100 * parts).collect()
    found: list = []
    for i in range(1, parts) if drawn else ():
        c = drawn[len(drawn) * i // parts][0]
        if not found or found[-1] != c:
            found.append(c)
    return found


def _literal(x) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in x.asDict().items())) if isinstance(x, Row) else F.lit(x)


def _part(col: str | Column, cuts: list, kind: str | None = None) -> Column:
    """The number of cuts, as values of ``kind``, at or below a value (0 for null), found by halving."""
    col = F.col(col) if isinstance(col, str) else col

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = _literal(cuts[mid])
        return F.when(col >= (cut.cast(kind) if kind else cut), halve(mid + 1, hi)).otherwise(halve(lo, mid))

    return halve(0, len(cuts))


def ranks_by_parts(df: DataFrame, y: str, parts: int | None = None) -> DataFrame:
    """``df`` with _le and _ge, the numbers of values at or below and at or above each row's; both null for a null, which counts nowhere."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("_c"))
    parts = parts or parts_of(df)
    counts = counts.withColumn("_p", _part(y, _cuts(df, y, parts)))
    w = Window.partitionBy("_p").orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.groupBy("_p").agg(F.sum("_c").alias("_s"))
    before = whole.withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    t = counts.withColumn("_u", F.sum("_c").over(w)).join(F.broadcast(before), "_p").crossJoin(whole.agg(F.sum("_s").alias("_all")))
    t = t.select(y, (F.col("_b") + F.col("_u")).alias("_le"), (F.col("_all") - F.col("_b") - F.col("_u") + F.col("_c")).alias("_ge"))
    return df.join(t, y, "left")


def position_by_parts(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with _part, by ranges of the order columns together, and _pos, the position in that order (nulls first)."""
    key = F.struct(*order)
    p = df.withColumn("_part", _part(key, _cuts(df, key, parts or parts_of(df))))
    sizes = p.groupBy("_part").agg(F.count("*").alias("_s"))
    before = sizes.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each part
    return p.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part").withColumn("_pos", F.col("_b") + F.col("_r")).drop("_b", "_r")


def running_by_parts(df: DataFrame, order: str, sums: dict[str, str], parts: int | None = None, descending: bool = False) -> DataFrame:
    """``df`` with running sums {name: column} along ``order``, which must not repeat: within ranges, set off by their totals."""
    p = df.withColumn("_part", _part(order, _cuts(df, order, parts or parts_of(df))) * (-1 if descending else 1))
    key = F.desc(order) if descending else F.asc(order)
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = p.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    before = before.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(up), F.lit(0)).alias(f"_b_{n}") for n in sums))  # a row for each part
    out = p.withColumns({f"_r_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return out.select(*df.columns, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def two_sample_ks(a: DataFrame, b: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """Largest distance of the two distribution functions, and its asymptotic p-value (100 terms)."""
    t = a.groupBy(col).agg(F.count("*").alias("na")).join(b.groupBy(col).agg(F.count("*").alias("nb")), col, "full_outer").na.fill(0, ["na", "nb"]).where(F.col(col).isNotNull())
    t = t.withColumn("_p", _part(col, _cuts(a, col, parts or parts_of(a))))
    w = Window.partitionBy("_p").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("_p").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("sa").over(up), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(up), F.lit(0)).alias("bb"))  # a row for each part
    t = t.select("_p", F.sum("na").over(w).alias("ca"), F.sum("nb").over(w).alias("cb")).join(F.broadcast(before), "_p").crossJoin(sums.agg(F.sum("sa").alias("A"), F.sum("sb").alias("B")))
    d = t.agg(F.max(F.abs((F.col("ca") + F.col("ba")) / F.col("A") - (F.col("cb") + F.col("bb")) / F.col("B"))).alias("ks"), F.max("A").alias("A"), F.max("B").alias("B"))
    e = F.sqrt(F.col("A") * F.col("B") / (F.col("A") + F.col("B"))) * F.col("ks")
    p = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2 * k * k * e * e))
    return d.select("ks", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def bootstrap_mean(df: DataFrame, value: str, key: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(mean, low, high): percentile interval from Poisson-weighted replicates; nulls don't count. Weights hang on a seeded hash of the
    key, so a row's weights are the same in any partition. One pass: a partition gives two sums for each replicate."""
    import numpy as np
    import pyarrow as pa

    marks = np.array([0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676])  # Poisson(1)'s distribution function
    turns = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sums(batches):
        n, total = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            h, v = b["h"].to_numpy().view(np.uint64), b["v"].to_numpy()
            for i in range(0, len(h), 4096):
                x = h[i : i + 4096, None] + turns[None, :]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(marks, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                n += w.sum(axis=0)
                total += v[i : i + 4096] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(n), pa.array(total)], ["r", "n", "t"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(value).cast("double").alias("v"))
    each = rows.mapInArrow(sums, "r bigint, n double, t double").groupBy("r").agg((F.sum("t") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    lo, hi = F.percentile("m", F.lit((1 - level) / 2)), F.percentile("m", F.lit((1 + level) / 2))
    return df.agg(F.avg(value).alias("mean")).crossJoin(each.agg(lo.alias("low"), hi.alias("high")))


def permutation_test(df: DataFrame, stratum: str, x: str, y: str, key: str, permutations: int = 100, seed: int = 0) -> DataFrame:
    """(observed, p_value) of the absolute correlation under exchanges of y within strata: (1 + as large) / (permutations + 1).
    Nulls as in ``resampling.permutation_null``."""
    from .resampling import max_statistic_test

    return max_statistic_test(df, [x], y, key, stratum, permutations, seed=seed).select(F.col("corr").alias("observed"), "p_value")


def grouping_sets(df: DataFrame, keys: list[str], value: str, kind: str = "rollup") -> DataFrame:
    """Rows, sum and approximate number of distinct values for a rollup or cube of keys."""
    return getattr(df, kind)(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.approx_count_distinct(value).alias("about"))
