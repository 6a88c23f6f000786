"""Scores of predictions: every metric is a few aggregates or sorted windows, overall or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .windows import average_rank, dealt

EPS = 2.220446049250313e-16


def _safe(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def auc(df: DataFrame, y: str, s: str, keys: list[str]) -> DataFrame:
    """ROC AUC by average ranks and average precision at distinct scores, by group; null with a single class. Rows are first counted
    by score, so that ties and volume shrink before the sort; a group's scores are summed within ranges, set off by their totals."""
    from .aggregates import _cuts, _part, parts_of

    n = df.groupBy(*keys, s).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n")).withColumn("_part", _part(s, _cuts(df, s, parts_of(df))))
    w = Window.partitionBy(*keys, "_part")
    up, down = w.orderBy(s).rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, 0)
    parts = n.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_q")).agg(F.sum(F.col("_n") - F.col("_p")).alias("_sn"), F.sum("_p").alias("_sp"), F.sum("_n").alias("_sa"))
    v = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))))  # a row for each range
    lower, upper = v.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1), v.orderBy(F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)
    off = lambda c, o: F.coalesce(F.sum(c).over(o), F.lit(0))
    parts = parts.withColumns({"_below": off("_sn", lower), "_tp": off("_sp", upper), "_pp": off("_sa", upper)})
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    t = n.select(*keys, "_part", "_p", "_n", off(F.col("_n") - F.col("_p"), up).alias("below"), F.sum("_p").over(down).alias("tp"), F.sum("_n").over(down).alias("pp")).join(parts, same)
    t = t.select(*keys, "_p", "_n", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("below", "tp", "pp")))
    wins = F.sum(F.col("_p") * (F.col("below") + (F.col("_n") - F.col("_p")) / 2))
    pos, neg = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    ap = F.sum(F.col("_p") * F.col("tp") / F.col("pp"))
    both = (pos > 0) & (neg > 0)
    return t.groupBy(*keys).agg(F.when(both, _safe(wins, pos * neg)).alias("roc_auc"), F.when(both, _safe(ap, pos)).alias("pr_auc"))


def probability_scores(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """Brier score, log loss (null with one class) and separation (mean p of positives less that of negatives); all null if a p
    lies outside [0, 1]."""
    bad = F.max((~F.col(p).between(0, 1)).cast("int")) == 1
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    loss = -F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))
    of = lambda c: F.avg(F.when(F.col(y) == c, F.col(p)))
    return df.groupBy(*keys).agg(
        F.when(~bad, F.avg((F.col(p) - F.col(y)) ** 2)).alias("brier"), F.when(~bad & (F.min(y) != F.max(y)), loss).alias("log_loss"), F.when(~bad, of(1) - of(0)).alias("separation")
    )


def _placed(df: DataFrame, s: str, key: str, bins: int) -> DataFrame:
    """Rows with their place from 0 by falling score (ties by key) and the bin of floor(linspace(0, n, bins + 1)) that holds it. Places
    are counted within ranges of scores and set off by the ranges' sizes."""
    from .aggregates import position_by_parts

    n = df.count()
    placed = position_by_parts(df.withColumn("_s", -F.col(s)), ["_s", key]).withColumn("_i", F.col("_pos") - 1)
    return placed.withColumn("bin", sum((F.col("_i") >= (n * b) // bins).cast("int") for b in range(1, bins))).drop("_s", "_part", "_pos")


def gains_table(df: DataFrame, y: str, s: str, key: str, bins: int = 10) -> DataFrame:
    """By bin of falling score: rows, positives (y > 0.5), their running share and its lift."""
    t = _placed(df, s, key, bins).groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col(y) > 0.5).cast("long")).alias("positives"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
    every = Window.partitionBy()
    gain = _safe(F.sum("positives").over(up), F.sum("positives").over(every))
    return t.withColumn("gain", F.coalesce(gain, F.lit(0.0))).withColumn("lift", F.coalesce(F.col("gain") / (F.sum("n").over(up) / F.sum("n").over(every)), F.lit(0.0)))


def hosmer_lemeshow(df: DataFrame, y: str, p: str, key: str, groups: int = 10) -> DataFrame:
    """(statistic, dof): groups of equal count by rising p, the first taking the remainder; dof = max(1, used - 2)."""
    from .aggregates import position_by_parts

    n = df.count()
    size, extra = n // groups, n % groups
    t = position_by_parts(df, [p, key])
    g = F.greatest(F.floor((F.col("_pos") - 1 - extra) / max(1, size)), F.lit(0))
    t = t.withColumn("g", g).groupBy("g").agg(F.count("*").alias("n"), F.sum(y).alias("o"), F.sum(p).alias("e"))
    v = F.col("e") * (1 - F.col("e") / F.col("n"))
    return t.agg(F.sum(_safe((F.col("o") - F.col("e")) ** 2, v)).alias("statistic"), F.greatest(F.lit(1), F.count("*") - 2).cast("long").alias("dof"))


def accuracy_ratio(df: DataFrame, y: str, s: str) -> DataFrame:
    """2 * AUC - 1, ties averaged."""
    return auc(df.withColumn("_k", F.lit(1)), y, s, ["_k"]).select((2 * F.col("roc_auc") - 1).alias("accuracy_ratio"))


def best_threshold(df: DataFrame, y: str, s: str, metric: str = "f1") -> DataFrame:
    """(threshold, value): predict positive at or above it; the first best from all negative (null threshold) downward. Only a row for
    each distinct score is sorted."""
    n = df.groupBy(s).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    from .aggregates import running_by_parts

    n = n.withColumn("_q", F.col("_n") - F.col("_p")).where(F.col(s).isNotNull())
    tot = n.agg(F.sum("_p").alias("P"), F.sum(F.col("_n") - F.col("_p")).alias("N"))
    cuts = running_by_parts(n, s, {"tp": "_p", "fp": "_q"}, descending=True).select(F.col(s).alias("threshold"), "tp", "fp")
    start = df.sparkSession.createDataFrame([(None, 0, 0)], "threshold double, tp bigint, fp bigint")
    t = cuts.unionByName(start).crossJoin(tot).withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sens, spec = zero(_safe(tp, tp + fn)), zero(_safe(tn, tn + fp))
    value = {
        "f1": zero(_safe(2 * tp, 2 * tp + fp + fn)), "balanced_accuracy": (sens + spec) / 2, "youden": sens + spec - 1, "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "mcc": zero(_safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))),
    }[metric]
    return t.withColumn("value", value).orderBy(F.desc("value"), F.desc_nulls_first("threshold")).limit(1).select("threshold", "value")


def weighted_kappa(df: DataFrame, a: str, b: str, power: int = 2) -> DataFrame:
    """Kappa with weights |i - j| ** power; 1 if both are one class, 0 if nothing is expected."""
    n = df.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    ri, rj = n.groupBy("i").agg(F.sum("n").alias("ni")), n.groupBy("j").agg(F.sum("n").alias("nj"))
    w = lambda: F.pow(F.abs(F.col("i") - F.col("j")), F.lit(power))
    seen = n.agg(F.sum(w() * F.col("n")).alias("o"), F.sum("n").alias("all"))
    due = ri.crossJoin(rj).agg(F.sum(w() * F.col("ni") * F.col("nj")).alias("e"), F.count("*").alias("cells"))  # classes only
    return seen.crossJoin(due).select(F.when(F.col("cells") == 1, F.lit(1.0)).when(F.col("e") == 0, F.lit(0.0)).otherwise(1 - F.col("o") * F.col("all") / F.nullif("e", F.lit(0.0))).alias("kappa"))


def confusion(df: DataFrame, y: str, p: str, classes: list) -> DataFrame:
    """Counts by true class (rows) and predicted class (columns, stated, so that no job looks for them)."""
    return df.groupBy(y).agg(*(F.sum((F.col(p) == c).cast("long")).alias(f"pred_{c}") for c in classes))


def ordinal_codes(df: DataFrame, s: str, cuts: list[float]) -> DataFrame:
    return df.withColumn("code", sum((F.col(s) >= c).cast("int") for c in cuts))


def regression_scores(df: DataFrame, y: str, p: str, base: str, band: float) -> DataFrame:
    """Share within ``band``, error over that of ``base``, mean relative error against ``base``, share better than it, log-cosh, RMSE,
    RMSPE (zeros of y dropped) and RMSLE (negatives as 0)."""
    e, b = F.col(p) - F.col(y), F.col(base) - F.col(y)
    log_cosh = F.abs(e) + F.log1p(F.exp(-2 * F.abs(e))) - F.log(F.lit(2.0))
    pos = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    return df.agg(
        F.avg((F.abs(e) <= band).cast("double")).alias("within"), _safe(F.avg(F.abs(e)), F.avg(F.abs(b))).alias("rel_mae"), F.avg(_safe(F.abs(e), F.abs(b))).alias("mrae"),
        F.avg((F.abs(e) < F.abs(b)).cast("double")).alias("better"), F.avg(log_cosh).alias("log_cosh"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(F.pow(_safe(e, F.col(y)), F.lit(2)))).alias("rmspe"), F.sqrt(F.avg((pos(p) - pos(y)) ** 2)).alias("rmsle"),
    )


def deviances(df: DataFrame, y: str, p: str, power: float = 1.5) -> DataFrame:
    """Mean Poisson, gamma and Tweedie deviances; rows outside a deviance's domain add nothing but count."""
    a, m = F.col(y), F.col(p)
    ok = lambda c, v: F.sum(F.when(c, v).otherwise(0.0)) / F.count("*")
    ratio = F.log(F.nullif(_safe(a, m), F.lit(0.0)))
    poisson = 2 * (F.when(a > 0, a * ratio).otherwise(0.0) - a + m)
    gamma = 2 * (-ratio + _safe(a - m, m))
    tweedie = 2 * (F.pow(a, F.lit(2 - power)) / ((1 - power) * (2 - power)) - a * F.pow(m, F.lit(1 - power)) / (1 - power) + F.pow(m, F.lit(2 - power)) / (2 - power))
    return df.agg(ok((a >= 0) & (m > 0), poisson).alias("poisson"), ok((a > 0) & (m > 0), gamma).alias("gamma"), ok((a >= 0) & (m > 0), tweedie).alias("tweedie"))


def correlations(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson and Spearman (average ranks) by group; null where a column is constant."""
    rows = dealt(df.select(*dict.fromkeys([*keys, x, y])), keys)
    r = rows.withColumn("_rx", average_rank(x, keys)).withColumn("_ry", average_rank(y, keys))

    def corr(a: str, b: str) -> Column:
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))

    return r.groupBy(*keys).agg(corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a proportion."""
    p = successes / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def required_n(p: Column, half_width: float, z: float = 1.959963984540054) -> Column:
    """Rows that a proportion ``p`` needs for an interval of +- ``half_width``."""
    return F.ceil(z * z * p * (1 - p) / (half_width * half_width))


def two_proportion_z(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    p = (s1 + s2) / (n1 + n2)
    return _safe(s1 / n1 - s2 / n2, F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def decision_curve(df: DataFrame, y: str, p: str, cuts: list[float]) -> DataFrame:
    """(cut, net_benefit, treat_all): true positives less false ones at the cut's odds, a row."""
    rows = df.select(y, p, F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    hit = F.col(p) >= F.col("cut")
    odds = F.col("cut") / (1 - F.col("cut"))
    t = rows.groupBy("cut").agg(F.sum((hit & (F.col(y) == 1)).cast("long")).alias("tp"), F.sum((hit & (F.col(y) == 0)).cast("long")).alias("fp"), F.avg(y).alias("rate"), F.count("*").alias("n"))
    return t.select("cut", ((F.col("tp") - F.col("fp") * odds) / F.col("n")).alias("net_benefit"), (F.col("rate") - (1 - F.col("rate")) * odds).alias("treat_all"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """By equal-width bin of p: rows, mean p and rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Calibration error, its debiased square root form, and Murphy's reliability, resolution and uncertainty (REL - RES + UNC is the binned
    Brier score)."""
    t = reliability(df, y, p, bins).crossJoin(df.agg(F.count("*").alias("all"), F.avg(y).alias("base")))
    w, gap = F.col("n") / F.col("all"), F.col("mean_p") - F.col("rate")
    noise = F.col("rate") * (1 - F.col("rate")) / F.greatest(F.col("n") - 1, F.lit(1))
    return t.agg(
        F.sum(w * F.abs(gap)).alias("ece"), F.sqrt(F.greatest(F.sum(w * (gap**2 - noise)), F.lit(0.0))).alias("ece_debiased"),
        F.sum(w * gap**2).alias("rel"), F.sum(w * (F.col("rate") - F.col("base")) ** 2).alias("res"), (F.max("base") * (1 - F.max("base"))).alias("unc"),
    )


def ranking_scores(df: DataFrame, query: str, s: str, rel: str, key: str, k: int, largest: int = 4) -> DataFrame:
    """DCG@k and NDCG@k (gain 2 ** rel - 1), MAP@k over min(k, relevant), MRR, precision@k over min(k, rows), hit@k and ERR@k (grades above
    ``largest`` count as that) of each query, ties by key; NDCG and MAP are null without relevant rows."""
    if k <= 0:
        raise ValueError("k must be positive")
    by_s, by_r = Window.partitionBy(query).orderBy(F.desc(s), key), Window.partitionBy(query).orderBy(F.desc(rel), key)
    r = df.select(query, F.col(rel).alias("_rel"), F.row_number().over(by_s).alias("_i"), F.row_number().over(by_r).alias("_b"))
    up = Window.partitionBy(query).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("_rel") > 0).cast("int")
    stop = (F.pow(F.lit(2.0), F.least(F.col("_rel"), F.lit(largest))) - 1) / 2.0**largest
    r = r.withColumn("_hits", F.sum(hit).over(up)).withColumn("_go", F.exp(F.coalesce(F.sum(F.log(1 - stop)).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    gain = F.pow(F.lit(2.0), F.col("_rel")) - 1
    top = F.col("_i") <= k
    return r.groupBy(query).agg(
        F.sum(F.when(top, gain / F.log2(F.col("_i") + 1))).alias("dcg"),
        _safe(F.sum(F.when(top, gain / F.log2(F.col("_i") + 1))), F.sum(F.when(F.col("_b") <= k, gain / F.log2(F.col("_b") + 1)))).alias("ndcg"),
        _safe(F.coalesce(F.sum(F.when(top & (hit == 1), F.col("_hits") / F.col("_i"))), F.lit(0.0)), F.least(F.lit(k), F.sum(hit))).alias("map"),
        F.coalesce(1 / F.min(F.when(hit == 1, F.col("_i"))), F.lit(0.0)).alias("mrr"), (F.sum(F.when(top, hit)) / F.least(F.lit(k), F.count("*"))).alias("precision"),
        F.max(F.when(top, hit)).alias("hit"), F.sum(F.when(top, F.col("_go") * stop / F.col("_i"))).alias("err"),
    )


def distribution_drift(a: DataFrame, b: DataFrame, col: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """PSI, KL and Jensen-Shannon of ``b`` against ``a`` over ``a``'s percentile bins (shares below ``floor`` raised to it), and Wasserstein-1
    from the exact distribution functions."""
    edges = sorted({e for e in quantiles(a, col, [i / bins for i in range(1, bins)]) if e is not None})
    code = sum(((F.col(col) >= e).cast("int") for e in edges), F.lit(0))
    na, nb = (d.where(F.col(col).isNotNull()).groupBy(code.alias("bin")).agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    t = na.join(nb, "bin", "full_outer").na.fill(0, ["na", "nb"])
    t = t.crossJoin(t.agg(F.sum("na").alias("A"), F.sum("nb").alias("B")))
    p, q = F.greatest(F.col("na") / F.col("A"), F.lit(floor)), F.greatest(F.col("nb") / F.col("B"), F.lit(floor))
    m = (p + q) / 2
    return t.agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.sum(q * F.log(q / p)).alias("kl"), F.sum((p * F.log(p / m) + q * F.log(q / m)) / 2).alias("js"))


def wasserstein(a: DataFrame, b: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """Wasserstein-1 distance: the area between the two distribution functions. Distinct values are summed in ranges, set off by the
    ranges' totals."""
    from .aggregates import _cuts, _part, parts_of

    t = a.groupBy(col).agg(F.count("*").alias("na")).join(b.groupBy(col).agg(F.count("*").alias("nb")), col, "full_outer").na.fill(0, ["na", "nb"]).where(F.col(col).isNotNull())
    t = t.withColumn("_p", _part(col, _cuts(a, col, parts or parts_of(a))))
    sums = t.groupBy("_p").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.min(col).alias("lo"))
    over = Window.orderBy("_p")
    up = over.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("sa").over(up), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(up), F.lit(0)).alias("bb"), F.lead("lo").over(over).alias("next"))  # a row for each part
    w = Window.partitionBy("_p").orderBy(col)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("_p", F.col(col).alias("v"), F.sum("na").over(run).alias("ca"), F.sum("nb").over(run).alias("cb"), F.lead(col).over(w).alias("n"))
    t = t.join(F.broadcast(before), "_p").crossJoin(sums.agg(F.sum("sa").alias("A"), F.sum("sb").alias("B")))
    gap = F.abs((F.col("ca") + F.col("ba")) / F.col("A") - (F.col("cb") + F.col("bb")) / F.col("B"))
    return t.agg(F.sum(gap * (F.coalesce("n", "next") - F.col("v"))).alias("wasserstein"))


def quantile_scores(df: DataFrame, y: str, lo: str, mid: str, hi: str, alpha: float = 0.1) -> DataFrame:
    """Pinball losses, coverage (ends included), mean width, Winkler score and the mean of twice the pinball losses (a CRPS estimate) for
    quantiles alpha / 2, 0.5 and 1 - alpha / 2."""
    def pinball(q: float, c: str) -> Column:
        return F.greatest(q * (F.col(y) - F.col(c)), (q - 1) * (F.col(y) - F.col(c)))

    losses = {lo: pinball(alpha / 2, lo), mid: pinball(0.5, mid), hi: pinball(1 - alpha / 2, hi)}
    outside = F.greatest(F.col(lo) - F.col(y), F.lit(0.0)) + F.greatest(F.col(y) - F.col(hi), F.lit(0.0))
    return df.agg(
        *(F.avg(v).alias(f"pinball_{c}") for c, v in losses.items()), F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("width"),
        F.avg(F.col(hi) - F.col(lo) + 2 / alpha * outside).alias("winkler"), F.avg(2 * sum(losses.values()) / 3).alias("crps"),
    )


def multilabel_scores(df: DataFrame, key: str, truth: str, score: str) -> DataFrame:
    """LRAP, coverage error, ranking loss, one-error, Hamming loss (score >= 0.5) and subset accuracy from label and score arrays; rows without
    positives or without negatives have LRAP 1 and ranking loss 0."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(score).alias("s"))).alias("i", "z")).select(key, "i", "z.t", "z.s")
    w = Window.partitionBy(key)
    ge = F.count("*").over(w.orderBy(F.desc("s")))
    ge_pos = F.sum("t").over(w.orderBy(F.desc("s")))
    r = rows.withColumn("ge", ge).withColumn("gp", ge_pos).withColumn("P", F.sum("t").over(w)).withColumn("N", F.sum(1 - F.col("t")).over(w)).withColumn("top", F.max("s").over(w))
    pos, wrong = F.col("t") == 1, (F.col("s") >= 0.5).cast("int") != F.col("t")
    each = r.groupBy(key).agg(
        F.coalesce(F.avg(F.when(pos, F.col("gp") / F.col("ge"))), F.lit(1.0)).alias("lrap"), F.coalesce(F.max(F.when(pos, F.col("ge"))), F.lit(0)).alias("coverage"),
        F.coalesce(F.sum(F.when(pos, F.col("ge") - F.col("gp"))) / F.nullif((F.max("P") * F.max("N")).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("ranking_loss"),
        (1 - F.max(F.when(F.col("s") == F.col("top"), F.col("t")))).alias("one_error"), F.avg(wrong.cast("double")).alias("hamming"), (F.max(wrong.cast("int")) == 0).cast("int").alias("subset"),
    )
    return each.agg(*(F.avg(c).alias(c) for c in ("lrap", "coverage", "ranking_loss", "one_error", "hamming", "subset")))


def multilabel_f1(df: DataFrame, key: str, truth: str, score: str) -> DataFrame:
    """F1 macro, micro and weighted by support, and Jaccard macro, over labels at score >= 0.5."""
    rows = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(score).alias("s"))).alias("i", "z")).select("i", F.col("z.t").alias("t"), (F.col("z.s") >= 0.5).cast("int").alias("p"))
    c = rows.groupBy("i").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(_safe(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    cols = [F.col(x) for x in ("tp", "fp", "fn")]
    support = F.col("tp") + F.col("fn")
    return c.agg(
        F.avg(f1(*cols)).alias("f1_macro"), f1(*map(F.sum, ("tp", "fp", "fn"))).alias("f1_micro"), _safe(F.sum(f1(*cols) * support), F.sum(support)).alias("f1_weighted"),
        F.avg(F.coalesce(_safe(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).alias("jaccard_macro"),
    )


def class_grid(df: DataFrame, group: str, time: Column, y: str) -> DataFrame:
    """Rows and rate by group and period."""
    return df.groupBy(group, time.alias("period")).agg(F.count("*").alias("n"), F.avg(y).alias("rate"))
