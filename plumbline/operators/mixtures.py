"""Shrunk-covariance distances and Gaussian mixtures, fitted from sums over partitions and applied as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept_table

#: Rows of the sample in which a mixture looks for a start.
SAMPLE = 4000


def quadratic(cols: list[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    """(x - mean)' precision (x - mean); null if a column is."""
    d = [F.col(c).cast("double") - float(m) for c, m in zip(cols, mean, strict=True)]
    terms = [d[i] * d[j] * float(precision[i, j] * (1 if i == j else 2)) for i in range(len(d)) for j in range(i, len(d))]
    return sum(terms[1:], terms[0])


@dataclass(frozen=True)
class Mahalanobis:
    cols: tuple[str, ...]
    mean: np.ndarray
    covariance: np.ndarray
    shrinkage: float

    def distance(self) -> Column:
        """Of a row to the mean; null if a column is null, or if nothing was learned."""
        if not len(self.mean):
            return F.lit(None).cast("double")
        square = quadratic(list(self.cols), self.mean, np.linalg.inv(self.covariance))
        return F.when(square.isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))))


def fit_mahalanobis(df: DataFrame, cols: list[str]) -> Mahalanobis:
    """Mean and covariance shrunk towards a multiple of the identity by Ledoit and Wolf's intensity, from the rows' second and fourth
    moments: two aggregates, the first for the means. Rows with a null don't count. Where all is constant, a variance of 1 is taken."""
    p = len(cols)
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).na.drop()
    n, *means = rows.agg(F.count("*"), *(F.avg(f"x{i}") for i in range(p))).first()
    if not n:
        return Mahalanobis(tuple(cols), np.empty(0), np.empty((0, 0)), 0.0)
    d = [F.col(f"x{i}") - float(m) for i, m in enumerate(means)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    norm = sum((x * x for x in d[1:]), d[0] * d[0])
    fourth, *sums = rows.agg(F.sum(norm * norm), *(F.sum(d[i] * d[j]) for i, j in pairs)).first()
    s = np.zeros((p, p))
    for (i, j), v in zip(pairs, sums, strict=True):
        s[i, j] = s[j, i] = v / n
    scale = np.trace(s) / p
    spread = ((s - scale * np.eye(p)) ** 2).sum() / p
    noise = min(max((fourth / n - (s**2).sum()) / (n * p), 0.0), spread)
    shrinkage = noise / spread if spread > 0 else 0.0
    covariance = (1 - shrinkage) * s + shrinkage * scale * np.eye(p)
    if scale <= 0:
        covariance = np.eye(p)
    return Mahalanobis(tuple(cols), np.array(means, float), covariance, float(shrinkage))


@dataclass(frozen=True)
class Mixture:
    """``scores`` has (components, log likelihood, BIC) of each number of components that was tried."""

    cols: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    scores: tuple[tuple[int, float, float], ...]

    def log_densities(self) -> list[Column]:
        p = len(self.cols)
        out = []
        for w, m, s in zip(self.weights, self.means, self.covariances, strict=True):
            rest = math.log(max(w, 1e-300)) - 0.5 * (p * math.log(2 * math.pi) + np.linalg.slogdet(s)[1])
            out.append(F.lit(float(rest)) - quadratic(list(self.cols), m, np.linalg.inv(s)) / 2)
        return out

    def memberships(self) -> Column:
        """array<double> of the components' posterior shares, heaviest component first; null if a column is null."""
        logs = self.log_densities()
        if not logs:
            return F.lit(None).cast("array<double>")
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        weights = [F.exp(x - top) for x in logs]
        return F.when(top.isNotNull(), F.array(*(w / sum(weights[1:], weights[0]) for w in weights)))


def _responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x components shares, log density of each row)."""
    logs = []
    for w, m, s in zip(weights, means, covariances, strict=True):
        half = np.linalg.solve(np.linalg.cholesky(s), (x - m).T)
        logs.append(math.log(max(w, 1e-300)) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + (half**2).sum(axis=0)))
    logs = np.stack(logs, axis=1)
    top = logs.max(axis=1, keepdims=True)
    total = np.exp(logs - top).sum(axis=1, keepdims=True)
    return np.exp(logs - top) / total, (top + np.log(total))[:, 0]


def _sums(x: np.ndarray, model: tuple) -> np.ndarray:
    """What the next model needs of some rows: for each component its weight, sums and sums of products; and the log likelihood."""
    share, log = _responsibilities(x, *model)
    products = np.einsum("nk,ni,nj->kij", share, x, x).reshape(share.shape[1], -1)
    return np.append(np.concatenate([share.sum(axis=0)[:, None], share.T @ x, products], axis=1).ravel(), log.sum())


def _next(sums: np.ndarray, k: int, p: int, floor: np.ndarray) -> tuple[tuple, float]:
    body = sums[:-1].reshape(k, 1 + p + p * p)
    n = np.maximum(body[:, 0], 1e-10)
    means = body[:, 1 : 1 + p] / n[:, None]
    covariances = body[:, 1 + p :].reshape(k, p, p) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return (n / n.sum(), means, (covariances + covariances.transpose(0, 2, 1)) / 2 + np.diag(floor)), float(sums[-1])


def _start(sample: np.ndarray, k: int, floor: np.ndarray, rng: np.random.Generator) -> tuple:
    """Centres drawn far from each other (by squared distance in units of each column's deviation), then steps on the sample."""
    unit = sample / np.sqrt(sample.var(axis=0) + 1e-300)
    at = [int(rng.integers(len(sample)))]
    while len(at) < k:
        far = ((unit[:, None] - unit[at][None]) ** 2).sum(axis=2).min(axis=1)
        at.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
    model = (np.full(k, 1 / k), sample[at], np.repeat(np.diag(sample.var(axis=0) / k + floor)[None], k, axis=0))
    for _ in range(50):
        model, _ = _next(_sums(sample, model), k, sample.shape[1], floor)
    return model


def fit_mixture(df: DataFrame, cols: list[str], components: range = range(1, 5), starts: int = 3, rounds: int = 200, tol: float = 1e-6, seed: int = 0) -> Mixture:
    """The Gaussian mixture of full covariances, with as many components as give the least BIC.

    Each number's start is the likeliest of ``starts`` seeded ones on a sample of at most SAMPLE rows, drawn by a hash of their
    values; all rows then take part in expectation-maximisation, a pass for each round, to which a partition gives one vector of
    sums. A fit ends when the mean log likelihood gains less than ``tol`` and is an error if it doesn't within ``rounds``. Rows with
    a null don't count; without rows there are no components.
    """
    p = len(cols)
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).na.drop()
    xs = [f"x{i}" for i in range(p)]
    rows = kept_table(rows)
    sample = rows.orderBy(F.xxhash64(F.lit(seed), *xs), *xs).limit(SAMPLE).toPandas().to_numpy(float)
    if not len(sample):
        return Mixture(tuple(cols), np.empty(0), np.empty((0, p)), np.empty((0, p, p)), ())
    n, *moments = rows.agg(F.count("*"), *(F.avg(c) for c in xs), *(F.var_pop(c) for c in xs)).first()
    centre, unit = np.array(moments[:p]), np.sqrt(np.array(moments[p:])) + 1e-300
    unit = np.where(unit > 1e-150, unit, 1.0)
    floor, best, scores = np.full(p, 1e-6), None, []
    sample = (sample - centre) / unit  # all is fitted in units of the columns' deviations

    def step(model: tuple) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model[0]) * (1 + p + p * p) + 1)
            for b in batches:
                x = (np.stack([b[c].to_numpy() for c in xs], axis=1) - centre) / unit
                for i in range(0, len(x), 4096):
                    total += _sums(x[i : i + 4096], model)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        return rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()

    for k in components:
        rng = np.random.default_rng([seed, k])
        model = max((_start(sample, k, floor, rng) for _ in range(starts)), key=lambda m: _responsibilities(sample, *m)[1].sum())
        before = -math.inf
        for _ in range(rounds):
            after, log = _next(step(model), k, p, floor)
            if log - before < tol * n:
                break
            model, before = after, log
        else:
            raise RuntimeError(f"{k} components still gain after {rounds} rounds")
        log -= n * float(np.log(unit).sum())  # in the columns' own units
        bic = (k - 1 + k * p + k * p * (p + 1) // 2) * math.log(n) - 2 * log
        scores.append((k, log, bic))
        if best is None or bic < best[0]:
            best = (bic, model)
    weights, means, covariances = best[1]
    order = np.lexsort([means[:, 0], -weights])
    return Mixture(tuple(cols), weights[order], means[order] * unit + centre, covariances[order] * np.outer(unit, unit), tuple(scores))
