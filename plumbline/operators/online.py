"""Bayesian linear regression along an entity: each row is predicted from the entity's earlier rows, then learned."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Window, by

#: Rows whose matrices are solved at once.
BLOCK = 4096


def prior(k: int, prior_precision: float) -> tuple[np.ndarray, np.ndarray]:
    """Precision matrix and precision-weighted mean before any row: coefficients around 0, independent, of equal precision."""
    if not prior_precision > 0:
        raise ValueError("prior_precision must be above 0")
    return prior_precision * np.eye(k), np.zeros(k)


def predict(x: np.ndarray, precision: np.ndarray, weighted: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of each row's y, given its own posterior (precision[i], weighted[i]); nan where a feature is."""
    known = np.isfinite(x).all(axis=1)
    mean, var = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if known.any():
        x, p = x[known], precision[known]
        if x.shape[1] == 2:  # by determinants, so that sums alike in SQL give the same last digit
            a, b, d, (u, v) = p[:, 0, 0], p[:, 0, 1], p[:, 1, 1], weighted[known].T
            one, other = x.T
            whole = a * d - b * b
            mean[known] = (one * (d * u - b * v) + other * (a * v - b * u)) / whole
            var[known] = (one * one * d - 2 * b * one * other + a * other * other) / whole + noise * noise
            return mean, var
        mean[known] = (x * np.linalg.solve(p, weighted[known][:, :, None])[:, :, 0]).sum(axis=1)
        var[known] = (x * np.linalg.solve(p, x[:, :, None])[:, :, 0]).sum(axis=1) + noise * noise
    return mean, var


def evidence(y: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log density of y under its prediction; nan where either is missing."""
    return -0.5 * (np.log(2 * np.pi * var) + (y - mean) ** 2 / var)


def along(x: np.ndarray, y: np.ndarray, precision: np.ndarray, weighted: np.ndarray, noise: float):
    """(mean, var, evidence, precision, weighted) of rows in order from a posterior: predictions, and the posterior after the rows.
    Rows without y or without a feature are not learned."""
    means, variances = [], []
    for i in range(0, len(x), BLOCK):
        a, b = x[i : i + BLOCK], y[i : i + BLOCK]
        learned = np.isfinite(b) & np.isfinite(a).all(axis=1)
        own, value = np.where(learned[:, None], a, 0.0), np.where(learned, b, 0.0)
        outer, cross = own[:, :, None] * own[:, None, :] / noise**2, own * value[:, None] / noise**2
        before_p, before_w = precision + np.cumsum(outer, axis=0) - outer, weighted + np.cumsum(cross, axis=0) - cross
        mean, var = predict(a, before_p, before_w, noise)
        means.append(mean)
        variances.append(var)
        precision, weighted = precision + outer.sum(axis=0), weighted + cross.sum(axis=0)
    mean, var = np.concatenate(means) if means else np.empty(0), np.concatenate(variances) if variances else np.empty(0)
    return mean, var, evidence(y, mean, var), precision, weighted


def online_regression(df: DataFrame, entity: str, order: list[str], y: str, xs: list[str], prior_precision: float = 1.0, noise: float = 1.0) -> DataFrame:
    """``df`` with pred_mean, pred_var and log_evidence of ``y`` ~ ``xs`` (add a column of ones for an intercept), noise of a known
    deviation.

    A posterior's precision is the prior's plus a sum over earlier rows, so running sums in one window give each row's
    matrices, and small systems are solved in Arrow batches: no entity is gathered in Python. A row with a null feature has null
    predictions, a row with a null y no evidence; neither is learned. Rows of equal order are taken as the sort leaves them, so
    give a unique order.
    """
    k = len(xs)
    start, _ = prior(k, prior_precision)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x, t = [F.col(c).cast("double") for c in xs], F.col(y).cast("double")
    learned = t.isNotNull()
    for c in x:
        learned = learned & c.isNotNull()
    w = by(entity, order).rowsBetween(Window.unboundedPreceding, -1)
    running = [F.coalesce(F.sum(F.when(learned, v)).over(w), F.lit(0.0)) for v in (*(x[i] * x[j] for i, j in pairs), *(c * t for c in x))]

    def solve(xs: pd.Series, sums: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, s = np.array(xs.tolist(), float).reshape(-1, k), np.array(sums.tolist(), float).reshape(-1, len(pairs) + k)
        out = []
        for lo in range(0, len(a), BLOCK):
            own = s[lo : lo + BLOCK]
            p = np.empty((len(own), k, k))
            for n, (i, j) in enumerate(pairs):
                p[:, i, j] = p[:, j, i] = own[:, n] / noise**2
            mean, var = predict(a[lo : lo + BLOCK], p + start, own[:, len(pairs) :] / noise**2, noise)
            out.append(np.stack([mean, var, evidence(y.to_numpy(float)[lo : lo + BLOCK], mean, var)]))
        mean, var, log = np.concatenate(out, axis=1) if out else np.empty((3, 0))
        return pd.DataFrame({"pred_mean": mean, "pred_var": var, "log_evidence": log})

    solved = F.pandas_udf(solve, "pred_mean double, pred_var double, log_evidence double")
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    out = df.withColumn("_x", F.array(*map(nan, x))).withColumn("_s", F.array(*running)).withColumn("_o", solved("_x", "_s", nan(t)))
    shown = [F.when(~F.isnan(f"_o.{c}"), F.col(f"_o.{c}")).alias(c) for c in ("pred_mean", "pred_var", "log_evidence")]
    return out.select(*df.columns, *shown)
