"""Exact percentiles of all of a table's rows, of whose values no task holds more than a bounded number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values between bounds up to which they are counted on the driver, and the error that bounds are searched with.
FEW, ERROR = 20_000, 1e-3


def quantiles(df: DataFrame, col: str | Column, shares: list[float], few: int = FEW) -> list[float | None]:
    """Interpolated percentiles at ``shares``, as ``F.percentile`` gives them (NaN above all numbers, nulls don't count); None without values.

    Approximate percentiles only say where to look: rows below such bounds are counted, so bounds are always on both sides of the
    rank that is sought, and are narrowed until ``few`` distinct values are between them. A round reads the rows three times, and
    leaves about a 250th of them, so the number of rounds hardly grows; give rows that are costly to compute as a kept table.
    """
    rows = df.select((F.col(col) if isinstance(col, str) else col).cast("double").alias("v")).where("v is not null")
    every, n = rows.agg(F.count("*"), F.count_if(~F.isnan("v"))).first()
    if not every:
        return [None] * len(shares)
    rows = rows.where(~F.isnan("v"))
    places = [p * (every - 1) for p in shares]
    wanted = sorted({k for x in places for k in (math.floor(x), math.ceil(x)) if k < n})
    found = _at(rows, n, wanted, few)
    at = lambda k: found[k] if k < n else math.nan
    out = []
    for x in places:
        low, high = math.floor(x), math.ceil(x)
        a, b = at(low), at(high)
        out.append(a if low == high or a == b else (high - x) * a + (x - low) * b)
    return out


def _at(rows: DataFrame, n: int, ranks: list[int], few: int) -> dict[int, float]:
    """{rank from 0: value} of rows (v) without nulls and NaN."""
    open_ = {k: (None, None, 0, n) for k in ranks}  # bounds (both inside), rows below, rows inside
    found: dict[int, float] = {}
    while open_:
        bands = sorted({(lo, hi) for lo, hi, _, _ in open_.values()}, key=repr)
        near = [_between(lo, hi) for lo, hi in bands]
        if bands != [(None, None)] or n <= few:
            inside = near[0]
            for c in near[1:]:
                inside = inside | c
            most = few * len(bands)
            counts = sorted((r["v"], r["n"]) for r in rows.where(inside).groupBy("v").agg(F.count("*").alias("n")).limit(most + 1).collect())
            if len(counts) <= most:
                for k, (lo, hi, below, _) in open_.items():
                    for v, c in counts:
                        if (lo is None or v >= lo) and (hi is None or v <= hi):
                            below += c
                            if below > k:
                                found[k] = v
                                break
                return found
        bounds = {}
        for (lo, hi), c in zip(bands, near, strict=True):
            own = {k: x for k, x in open_.items() if x[:2] == (lo, hi)}
            asked = sorted({min(1.0, max(0.0, (k - below) / inside + d * ERROR)) for k, (_, _, below, inside) in own.items() for d in (-2, 2)})
            bounds[lo, hi] = sorted(set(rows.where(c).approxQuantile("v", asked, ERROR)))
        cuts = sorted({b for x in bounds.values() for b in x})
        got = rows.agg(*(F.count_if(F.col("v") < b) for b in cuts), *(F.count_if(F.col("v") <= b) for b in cuts)).first()
        under, upto = dict(zip(cuts, got, strict=False)), dict(zip(cuts, got[len(cuts) :], strict=True))
        fresh = {}
        for k, (lo, hi, below, inside) in open_.items():
            low = max((b for b in bounds[lo, hi] if under[b] <= k), default=lo)
            high = min((b for b in bounds[lo, hi] if upto[b] > k), default=hi)
            start = under[low] if low in under else below
            end = upto[high] if high in upto else below + inside
            if low is not None and low == high:
                found[k] = low
            else:
                fresh[k] = (low, high, start, end - start)
        if fresh == open_:  # bounds that nothing narrows: the values between them are halved
            fresh = {k: _halved(rows, k, *x) for k, x in open_.items()}
        open_ = fresh
    return found


def _between(lo: float | None, hi: float | None) -> Column:
    return (F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") <= hi)


def _halved(rows: DataFrame, k: int, lo: float | None, hi: float | None, below: int, inside: int) -> tuple:
    """Bounds on one side of the middle of the values between the old ones."""
    least, most = rows.where(_between(lo, hi)).agg(F.min("v"), F.max("v")).first()
    middle = least / 2 + most / 2
    upto, last, first = rows.agg(F.count_if(F.col("v") <= middle), F.max(F.when(F.col("v") <= middle, F.col("v"))), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
    return (least, last, below, upto - below) if upto > k else (first, most, upto, below + inside - upto)
