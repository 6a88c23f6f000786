"""Column expressions: arithmetic with guarded divisors, row-wise statistics over columns, fuzzy memberships, bases and dates.

Missing values are nulls; an expression is null where an input that it needs is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def boolean_pairs(a: str, b: str) -> dict[str, Column]:
    """and, or and xor of two 0/1 columns as tiny integers; null if either is."""
    x, y = F.col(a).cast("tinyint"), F.col(b).cast("tinyint")
    return {f"{a}__and__{b}": x.bitwiseAND(y), f"{a}__or__{b}": x.bitwiseOR(y), f"{a}__xor__{b}": x.bitwiseXOR(y)}


def safe_ratio(a: Column, b: Column, eps: float) -> Column:
    """a / b, the divisor at least ``eps`` away from 0 on its side."""
    return a / F.when(F.abs(b) >= eps, b).when(b < 0, F.lit(-eps)).otherwise(F.lit(eps))


def log_ratio(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.log1p(F.abs(a) + eps) - F.log1p(F.abs(b) + eps)


def interactions(a: str, b: str, floor: float) -> dict[str, Column]:
    """Product, guarded quotient, sum and difference; ``floor`` is fitted, 1e-6 of the divisor's median size."""
    x, y = F.col(a), F.col(b)
    return {f"{a}__mul__{b}": x * y, f"{a}__div__{b}": safe_ratio(x, y, floor), f"{a}__add__{b}": x + y, f"{a}__sub__{b}": x - y}


def nested_mean(m_long: Column, n_long: int, m_short: Column, n_short: int) -> Column:
    """Mean of the older rows of a long window, from the window's mean and that of its newer rows."""
    return (m_long * n_long - m_short * n_short) / (n_long - n_short)


def proximity(day: Column, event: Column, cap_before: float, cap_after: float) -> Column:
    """max(0, cap - days between), the cap depending on the side of the event."""
    d = F.floor((F.unix_micros(day.cast("timestamp")) - F.unix_micros(event.cast("timestamp"))) / 86400e6)
    return F.greatest(F.lit(0.0), F.when(d < 0, F.lit(float(cap_before))).otherwise(F.lit(float(cap_after))) - F.abs(d))


def sentinel_count(cols: list[str], values: list) -> Column:
    return sum((F.coalesce(F.col(c).isin(*values), F.lit(False)).cast("int") for c in cols), F.lit(0))


def missing_pattern(cols: list[str]) -> tuple[Column, Column]:
    """Number of nulls, and their pattern as bits, the first column lowest."""
    return sum(F.isnull(c).cast("int") for c in cols), sum(F.shiftleft(F.isnull(c).cast("long"), i) for i, c in enumerate(cols))


def row_stats(cols: list[str], quantiles: tuple[float, ...] = (0.25, 0.75)) -> dict[str, Column]:
    """Mean, population deviation, extremes, median and interpolated quantiles across columns, nulls left out; null if all are."""
    own = [F.col(c).cast("double") for c in cols]
    v = F.sort_array(F.array_compact(F.array(*own)))
    n = sum((x.isNotNull().cast("int") for x in own), F.lit(0))
    mean = sum((F.coalesce(x, F.lit(0.0)) for x in own), F.lit(0.0)) / F.nullif(n, F.lit(0))
    spread = sum((F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in own), F.lit(0.0))

    def quantile(q: float) -> Column:
        at = (n - 1) * F.lit(q)
        lo = F.floor(at)
        get = lambda i: F.get(v, F.least(i, n - 1).cast("int"))
        return F.when(n > 0, get(lo) + (at - lo) * (get(lo + 1) - get(lo)))

    out = {"mean": mean, "std": F.sqrt(spread / F.nullif(n, F.lit(0))), "min": F.get(v, F.lit(0)), "max": F.get(v, n - 1), "median": quantile(0.5)}
    return out | {f"q{round(q * 100)}": quantile(q) for q in quantiles}


def band_scale(p: Column, lo: float, hi: float, factor: float) -> Column:
    """Predictions in (lo, hi] times ``factor``."""
    return F.when((p > lo) & (p <= hi), p * factor).otherwise(p)


def signed_rescale(p: Column, factor: float) -> Column:
    """Negative values times ``factor``, others divided by it."""
    return F.when(p < 0, p * factor).otherwise(p / factor)


def clip(p: Column, lo: float, hi: float) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(lo)), F.lit(hi)))


def override(p: Column, known: Column, weight: float) -> Column:
    """weight * known + (1 - weight) * p where known."""
    return F.when(known.isNotNull(), weight * known + (1 - weight) * p).otherwise(p)


def sticky_floor(probs: Column, active: Column, floor: float) -> Column:
    """An array's entry at ``active`` (from 0) raised to ``floor``, the others scaled so that the sum stays 1."""
    p = F.get(probs, active)
    scale = (1 - floor) / F.nullif(1 - p, F.lit(0.0))
    return F.when(p < floor, F.transform(probs, lambda v, i: F.when(i == active, F.lit(float(floor))).otherwise(v * scale))).otherwise(probs)


def step_weight(time: Column, cutoff, boost: float) -> Column:
    return F.when(time >= F.lit(cutoff), F.lit(float(boost))).otherwise(F.lit(1.0))


def triangular(x: Column, centres: list[float]) -> list[Column]:
    """Memberships in neighbouring centres that sum to 1, flat beyond the ends; all 0 for null."""
    out = []
    for i, c in enumerate(centres):
        m = F.lit(1.0)
        if i:
            m = F.when(x <= centres[i - 1], 0.0).when(x < c, (x - centres[i - 1]) / (c - centres[i - 1])).otherwise(m)
        if i + 1 < len(centres):
            m = F.when(x >= centres[i + 1], 0.0).when(x > c, (centres[i + 1] - x) / (centres[i + 1] - c)).otherwise(m)
        out.append(F.when(x.isNull(), 0.0).otherwise(m))
    return out


def gaussian_memberships(x: Column, centres: list[float], width: float) -> list[Column]:
    raw = [F.exp(-0.5 * F.pow((x - c) / width, F.lit(2))) for c in centres]
    return [F.coalesce(r / F.nullif(sum(raw), F.lit(0.0)), F.lit(0.0)) for r in raw]


def fitting_grid(grid: Column, residual, tolerance: float) -> dict[str, Column]:
    """Least, greatest, mean, median and number of the grid's values v with \\|residual(v)\\| <= tolerance."""
    v = F.array_sort(F.filter(grid, lambda x: F.abs(residual(x)) <= tolerance))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    median = F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)
    return {"fit_min": F.array_min(v), "fit_max": F.array_max(v), "fit_mean": mean, "fit_median": median, "fit_count": n}


def gate(c: Column, tau: float, a: Column, b: Column) -> Column:
    return F.when(c > tau, a).otherwise(b)


def row_argmax(cols: list[str]) -> Column:
    """Index from 0 of the first largest column; null if all are null."""
    v = F.array(*map(F.col, cols))
    return F.when(F.array_max(v).isNotNull(), F.array_position(v, F.array_max(v)).cast("int") - 1)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of non-negative longs: 92 Euclidean steps suffice for any."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lattice(a: Column, b: Column) -> dict[str, Column]:
    g = gcd(a, b)
    return {"gcd": g, "lcm": F.coalesce((a * b / F.nullif(g, F.lit(0))).cast("long"), F.lit(0)), "and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}


def chebyshev(x: Column, degree: int) -> list[Column]:
    out = [F.lit(1.0), x]
    for _ in range(degree - 1):
        out.append(2 * x * out[-1] - out[-2])
    return out[: degree + 1]


def legendre(x: Column, degree: int) -> list[Column]:
    out = [F.lit(1.0), x]
    for n in range(1, degree):
        out.append(((2 * n + 1) * x * out[-1] - n * out[-2]) / (n + 1))
    return out[: degree + 1]


def bernstein(x: Column, degree: int) -> list[Column]:
    return [math.comb(degree, k) * F.pow(x, F.lit(k)) * F.pow(1 - x, F.lit(degree - k)) for k in range(degree + 1)]


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def combined_odds(ps: list[Column], prior: float) -> Column:
    """Probability whose log odds are the prior's plus each p's distance from it."""
    base = math.log(prior / (1 - prior))
    logit = lambda p: F.log(p / (1 - p))
    return sigmoid(base + sum((logit(clip(p, 1e-9, 1 - 1e-9)) - base) for p in ps))


def date_parts(d: Column) -> dict[str, Column]:
    """Calendar parts, Monday being weekday 0, and sine and cosine of month and weekday."""
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "weekday": F.weekday(d), "quarter": F.quarter(d), "week": F.weekofyear(d), "yearday": F.dayofyear(d), "weekend": (F.weekday(d) >= 5).cast("int")}
    for c, n in (("month", 12), ("weekday", 7)):
        parts |= {f"{c}_sin": F.sin(2 * math.pi * parts[c] / n), f"{c}_cos": F.cos(2 * math.pi * parts[c] / n)}
    return parts


def uncross(quantiles: Column) -> Column:
    """A row's quantiles in order, nulls last."""
    known = F.array_compact(quantiles)
    return F.concat(F.sort_array(known), F.array_repeat(F.lit(None), F.size(quantiles) - F.size(known)))


def set_similarities(a: Column, b: Column, alpha: float = 0.5, beta: float = 0.5) -> dict[str, Column]:
    """Similarities of two arrays as sets; two empty sets are alike (1)."""
    both, na, nb = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    over = lambda d: F.when((na == 0) & (nb == 0), 1.0).otherwise(F.coalesce(both / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0)))
    half = F.when((na == 0) & (nb == 0), 1.0).otherwise(F.coalesce((both / F.nullif(na, F.lit(0)) + both / F.nullif(nb, F.lit(0))) / 2, F.lit(0.0)))
    return {
        "jaccard": over(na + nb - both), "dice": over((na + nb) / 2), "overlap": over(F.least(na, nb)), "braun_blanquet": over(F.greatest(na, nb)),
        "ochiai": over(F.sqrt(na * nb)), "kulczynski": half, "tversky": over(both + alpha * (na - both) + beta * (nb - both)),
    }
