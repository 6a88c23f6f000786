"""Near-duplicates by ProbMinHash.

Each distinct shingle of a document is an element with a weight (1 + ln of its count). An element's arrivals
form a Poisson process of that rate, seeded by the element's hash; each arrival falls on a random component,
and a component keeps the element of its earliest arrival. An element stops as soon as its next arrival is
later than every component's. Two documents agree on a component with a chance that is their probability
Jaccard similarity. Bands of components give candidates, which are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_lists
from .linking import link
from .shingles import GOLDEN, mix, shingles

BANDS, ROWS = 32, 6
CHUNK_CHARS = 500_000


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights."""
    found, counts = np.unique(shingles(text), return_counts=True)
    return found, 1 + np.log(counts)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """The elements that hold each of ``m`` components, one row for each set; empty sets give zeros."""
    n = len(sets)
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    h = np.concatenate([h for h, _ in sets]) if n else np.empty(0, np.uint64)
    w = np.concatenate([w for _, w in sets]) if n else np.empty(0)
    first, holder, time = np.full(n * m, np.inf), np.zeros(n * m, np.uint64), np.zeros(len(h))
    active, j = np.arange(len(h)), 0
    while len(active):
        run = int(np.clip(20_000 // len(active), 1, 64))  # arrivals drawn at once, when few elements are left
        steps = np.arange(j + 1, j + run + 1, dtype=np.uint64) * GOLDEN
        bits = mix(h[active][:, None] + steps[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / w[active][:, None]
        arrive = np.cumsum(np.concatenate([time[active][:, None], gaps], axis=1), axis=1)[:, 1:]
        cell = doc[active][:, None] * m + (mix(bits ^ GOLDEN) % np.uint64(m)).astype(np.int64)
        early = arrive < first[cell]
        at, when = cell[early], arrive[early]
        np.minimum.at(first, at, when)
        won = first[at] == when
        holder[at[won]] = np.broadcast_to(h[active][:, None], cell.shape)[early][won]
        time[active] = arrive[:, -1]
        j += run
        open_docs = np.unique(doc[active])
        last = np.zeros(n)
        last[open_docs] = first.reshape(n, m)[open_docs].max(axis=1)
        active = active[time[active] < last[doc[active]]]
    return holder.reshape(n, m)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` components, unlike from band to band."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signatures), bands)).copy()
    for r in range(rows):
        out = mix(out + parts[:, :, r])
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    With elements by falling ratio x / y, the maximum is the x term up to i and the y term after it.
    """
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(-np.where(y > 0, x / np.where(y > 0, y, 1), np.inf), kind="stable")
    x, y = x[order], y[order]
    above, below = np.cumsum(x), y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    return float((1 / (above[both] / x[both] + below[both] / y[both])).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two shingle multisets; the plain Jaccard where no shingle repeats. Without shingles 0."""
    (ha, ca), (hb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    if not len(ha) or not len(hb):
        return 0.0
    if ca.max() == cb.max() == 1:
        both = len(np.intersect1d(ha, hb, assume_unique=True))
        return both / (len(ha) + len(hb) - both)
    return probability_jaccard((ha, 1 + np.log(ca)), (hb, 1 + np.log(cb)))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _bands(text: pa.Array) -> pa.Array:
    out, part, size = [], [], 0
    for texts in text_lists(text):
        for t in texts:
            part.append(weighted(t))
            size += len(t)
            if size > CHUNK_CHARS:
                out += _banded(part)
                part, size = [], 0
    return pa.array(out + _banded(part), pa.list_(pa.int64()))


def _banded(part: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of the sets' bands; none for an empty set."""
    found = bands_of(prob_minhash(part), BANDS, ROWS)
    return [b if len(h) else b[:0] for b, (h, _) in zip(found, part, strict=True)]


def classes(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, key, kept): the near-duplicate class of every row, named by the least doc_id in it.

    Equal texts are one class; texts with a probability Jaccard of ``threshold`` or more are linked, and linked texts are one
    class. A null text is like no other row: its class is its own id. Empty texts equal each other only. A text of fewer
    than five words is one shingle. Null ids count last; a class of null ids only has a null name. ``kept`` marks the rows
    with the class's least (doc_id, key); repeated rows are all marked. Clashing columns play no part.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    real = documents.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), "text")
    rows = scratch.keep(real.select("doc_id", "key", F.arrow_udf(_bands, "array<bigint>")(F.col("text")).alias("bands")), "rows")

    def unpack(text: pa.Array) -> pa.Array:
        return pa.array([np.sort(shingles(x)).view(np.int64) for texts in text_lists(text) for x in texts], pa.list_(pa.int64()))

    found = link(rows.select("key", "bands"), real.select("key", "text"), unpack, similarity, threshold)
    ids = rows.select("doc_id", "key").join(found, "key", "left").select("doc_id", "key", F.coalesce("class", "key").alias("class"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    ids = scratch.keep(ids, "ids")
    scratch.drop(rows)
    named = ids.join(scratch.keep(ids.groupBy("class").agg(least), "least"), "class")
    kept = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.key") == F.col("key"))
    out = named.select("doc_id", F.col("least.doc_id").alias("class_id"), "key", kept.alias("kept"))
    lone = documents.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("key"), F.lit(True).alias("kept"))
    return out.unionByName(lone)


def one_of_each(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``documents`` that stay: one for each class; rows with a null text all stay."""
    kept = classes(documents, threshold).where("kept and key is not null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_of")).distinct()
    real = documents.where("text is not null").withColumn("_key", text_key(F.col("text")))
    same = (F.col("_key") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    stay = real.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
    return stay.unionByName(documents.where("text is null"))
