"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, small_batches

#: Labelled rows of each class that the fit draws at most, its parts and its random features.
PER_CLASS, PARTS, FEATURES = 6000, 16, 256
N_STATS = 22


def _ratio_of_bytes(data: np.ndarray) -> np.ndarray:
    """Shares of upper case, lower case, digits, white space, line ends, other ASCII, commas and stops, and bytes beyond ASCII."""
    n = np.bincount(data, minlength=256)
    parts = (n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[32] + n[9], n[10], n[33:44].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum(), n[44] + n[46], n[124], n[128:].sum())
    return np.array(parts, float) / max(1, len(data))


def statistics(text: str | None) -> list[float]:
    """Statistics of the whole text; null and empty texts give those of no words. Language and source play no part."""
    text = text or ""
    shares = _ratio_of_bytes(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (N_STATS - len(shares)) + shares.tolist()
    sizes = np.fromiter(map(len, words), np.int64, n)
    codes: dict = {}
    code = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    same = (code[1:] == code[:-1]).mean() if n > 1 else 0.0
    counts = np.bincount(code)
    pairs = np.unique(code[1:] * np.int64(len(codes)) + code[:-1]).size / max(1, n - 1)
    kinds = list(codes)
    marked = np.fromiter((not w.isalpha() for w in kinds), bool, len(kinds))
    upper = np.fromiter((w.isupper() for w in kinds), bool, len(kinds))
    tail = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:" for w in kinds), bool, len(kinds))
    weigh = lambda m: float((counts * m).sum() / n)
    lines = text.count("\n") + 1
    return [
        np.log1p(n) / 10, sizes.mean() / 10, sizes.std() / 10, sizes.max() / 50, float((sizes > 20).mean()), len(codes) / n / np.sqrt(n) * 10, counts.max() / n,
        float(same), pairs, weigh(marked), weigh(upper), weigh(tail), np.log1p(n / lines) / 5, *shares.tolist(),
    ]


def _matrix(text: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in text], float).reshape(-1, N_STATS)


@dataclass(frozen=True)
class Model:
    """A fitted classifier, a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features: inner products approximate the Gaussian kernel of the standardised statistics."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / self.omega.shape[1]) * np.cos(z @ self.omega + self.phase)
        return np.hstack([wave, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.beta, self.steps, self.values)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising steps (score, mean label), each mean drawn a little toward the overall rate."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        pools.append([s, s, t, 1.0])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, t2, n2 = pools.pop()
            lo, _, t1, n1 = pools.pop()
            pools.append([lo, hi, t1 + t2, n1 + n2])
    rate = float(y.mean()) if len(y) else 0.5
    xs, vs = [], []
    for lo, hi, t, n in pools:
        v = (t + 2 * rate) / (n + 2)
        xs += [lo, hi]
        vs += [v, v]
    return np.array(xs), np.maximum.accumulate(np.array(vs))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, ridge: float = 1e-3, width: float = 4.0, seed: int = 3) -> Model | None:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold; None without both classes.

    Each of PARTS partitions sums its share of the normal equations, weighted to the classes' true rates; a fifth of the
    rows takes no part in the ridge fit and calibrates it. Sums are added in a fixed order, so reruns agree.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rates = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(rates) < 2:
        return None
    to_stats = F.pandas_udf(lambda t: pd.Series(list(_matrix(t))), "array<double>")
    rows = labelled(documents, labels, label, per_class).select("doc_id", "y", to_stats("text").alias("x"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    rows = rows.repartition(PARTS, "part").persist()  # at most 2 * per_class rows of N_STATS numbers
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not sums:
        return None
    rng = np.random.default_rng(seed)
    mean, scale = np.round([r["m"] for r in sums], 9), np.round([r["s"] for r in sums], 9)
    omega, phase = rng.normal(size=(N_STATS, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES)
    blank = Model(mean, np.where(scale > 1e-6, scale, 1.0), omega, phase, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    had = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(had) < 2:
        return None
    weight = {c: rates[c] / sum(rates.values()) / (had[c] / sum(had.values())) for c in had}
    weight = {c: w**0.5 for c, w in weight.items()}  # half way between the drawn and the true rates
    kept_out = lambda ids: np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 == 0 for i in ids])

    def equations(batches):
        by_part: dict = {}
        for b in batches:
            b = b.sort_values("doc_id")
            for p, g in b.groupby("part"):
                z = blank.features(np.array(g["x"].tolist(), float))
                w = g["y"].map(weight).to_numpy() * ~kept_out(g["doc_id"])
                a, c = z.T @ (z * w[:, None]), z.T @ (w * g["y"].to_numpy())
                old = by_part.get(p, (0, 0))
                by_part[p] = (old[0] + a, old[1] + c)
        for p, (a, c) in sorted(by_part.items()):
            yield pd.DataFrame({"part": [p], "a": [a.ravel()], "c": [c]})

    parts = sorted(rows.mapInPandas(equations, "part int, a array<double>, c array<double>").collect(), key=lambda r: r["part"])
    a = sum(np.array(r["a"]).reshape(FEATURES + 1, -1) for r in parts)
    c = sum(np.array(r["c"]) for r in parts)
    beta = np.linalg.solve(a + ridge * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), c)
    held = rows.select("doc_id", "y", "x").toPandas().sort_values("doc_id")
    rows.unpersist()
    out = kept_out(held["doc_id"])
    out = out if len(set(held["y"][out])) == 2 else np.ones(len(held), bool)
    score = blank.features(np.array(held["x"].tolist(), float)) @ beta
    steps, values = isotonic(score[out], held["y"].to_numpy(float)[out])
    return Model(blank.mean, blank.scale, omega, phase, beta, steps, values)


def score_documents(documents: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Null texts score as empty ones. Without a model (no labels of both classes) every score is 0.5. Null ids are never
    held out. Repeated rows score alike; clashing columns are replaced. ``spark`` ships the model with the function.
    """

    small_batches(documents.sparkSession)

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(np.full(len(text), 0.5) if model is None else model.score(_matrix(text)))

    keep = [c for c in documents.columns if c not in ("held_out", "score", "predicted")]
    scored = documents.select(*keep, held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(run, "double")(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
