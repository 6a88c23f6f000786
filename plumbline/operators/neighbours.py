"""Nearest rows by vector: exact in blocks, exact among earlier rows, and approximate by random projections with several probes.

All three are one search: queries and rows are dealt into cells, a cell's rows and queries into blocks of bounded size, and each
pair of blocks of a cell is one task's matrix product, which keeps each query's nearest. No vector goes through the driver but
for a bounded sample from which the approximate index learns how far it must probe.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept_table

#: Rows and queries of a block; rows whose vectors the approximate index is fitted on, and of them those taken as queries.
ROWS, QUERIES, SAMPLE, ASKED = 1 << 15, 1 << 13, 20_000, 256
METRICS = ("euclidean", "manhattan", "cosine")
FOUND = "query bigint, neighbour bigint, distance double"


def usable(df: DataFrame, vec: str, key: str) -> Column:
    """Rows whose key and vector are known and whose components are all finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, term by term."""
    if metric == "manhattan":
        return np.abs(v - q).sum(axis=1)
    if metric == "cosine":
        return 1 - (q * v).sum(axis=1) / (np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1))
    return np.sqrt(((v - q) ** 2).sum(axis=1))


def _rough(q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """What orders all pairs as the distance does, but for rounding errors up to the second value."""
    if metric == "manhattan":
        out = np.zeros((len(q), len(v)))
        for i in range(q.shape[1]):
            out += np.abs(q[:, i, None] - v[None, :, i])
        return out, 1e-9 * (1 + float(out.max(initial=0)))
    if metric == "cosine":
        return -(q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 1e-9
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    return qq[:, None] + vv[None, :] - 2 * (q @ v.T), 1e-9 * (1 + float(qq.max(initial=0) + vv.max(initial=0)))


def _top(ids, q, asked, at, v, known, k: int, metric: str) -> pd.DataFrame:
    """Each query's ``k`` nearest of a block; ``asked`` and ``known`` are times, if only earlier rows count."""
    if metric == "cosine":  # a vector of length 0 has no direction
        long_q, long_v = np.linalg.norm(q, axis=1) > 0, np.linalg.norm(v, axis=1) > 0
        ids, q, asked = ids[long_q], q[long_q], None if asked is None else asked[long_q]
        at, v, known = at[long_v], v[long_v], None if known is None else known[long_v]
    out = []
    for a in range(0, len(ids), 512):
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        own, some = ids[a : a + 512], q[a : a + 512]
        for b in range(0, len(at), 2048):
            rough, slack = _rough(some, v[b : b + 2048], metric)
            hidden = own[:, None] == at[None, b : b + 2048]
            if asked is not None:
                hidden |= known[None, b : b + 2048] >= asked[a : a + 512, None]
            rough[hidden] = np.inf
            m = min(k, rough.shape[1])
            near, col = np.nonzero((rough <= np.partition(rough, m - 1, axis=1)[:, m - 1 : m] + slack) & np.isfinite(rough))
            merged = [np.concatenate(x) for x in zip(best, (near, at[b + col], _distances(some[near], v[b + col], metric)), strict=True)]
            order = np.lexsort([merged[1], merged[2], merged[0]])
            merged = [x[order] for x in merged]
            place = np.arange(len(order)) - np.searchsorted(merged[0], merged[0])
            best = [x[place < k] for x in merged]
        out.append(pd.DataFrame({"query": own[best[0]], "neighbour": best[1], "distance": best[2]}))
    return pd.concat(out) if out else pd.DataFrame({"query": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "distance": np.empty(0)})


def _search(q: DataFrame, r: DataFrame, k: int, metric: str, past: bool = False) -> DataFrame:
    """(query, neighbour, distance) of q (cell, id, v, t) among the rows r (cell, id, v, t) of the same cell and length of vector."""
    if metric not in METRICS:
        raise ValueError(f"the metric is one of {', '.join(METRICS)}")
    q, r = (x.select("cell", F.size("v").alias("width"), "id", "v", "t") for x in (q, r))
    on = ["cell", "width"]
    sizes = [x.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias(name)) for x, most, name in ((q, QUERIES, "qs"), (r, ROWS, "rs"))]
    sizes = kept_table(sizes[0].join(sizes[1], on))  # a row for each cell that has both
    salt = F.xxhash64("id", F.monotonically_increasing_id())  # an id may repeat
    q = q.withColumn("_h", salt).join(sizes, on).withColumn("qb", F.pmod("_h", "qs").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    r = r.withColumn("_h", salt).join(sizes, on).withColumn("rb", F.pmod("_h", "rs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    keys = [*on, "qb", "rb"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "distance": np.empty(0)})
        if b["id_r"].duplicated().any():  # repeated rows are one
            b = b[~pd.Series([(i, t, np.asarray(v).tobytes()) for i, t, v in zip(b["id_r"], b["t_r"], b["v_r"], strict=True)], index=b.index).duplicated()]
        times = (a["t"].to_numpy(), b["t_r"].to_numpy()) if past else (None, None)
        return _top(a["id"].to_numpy(np.int64), np.array(a["v"].tolist(), float), times[0], b["id_r"].to_numpy(np.int64), np.array(b["v_r"].tolist(), float), times[1], k, metric)

    r = r.select(*(F.col(c).alias(f"{c}_r") for c in (*keys, "id", "v", "t")))  # both may come from one table
    return q.select(*keys, "id", "v", "t").groupBy(*keys).cogroup(r.groupBy(*(f"{c}_r" for c in keys))).applyInPandas(meet, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("weight", 1 / (1 + F.col("distance")))


def _plain(df: DataFrame, vec: str, key: str, time: str | None = None) -> DataFrame:
    t = F.col(time).cast("double") if time else F.lit(0.0)
    known = usable(df, vec, key) & (t.isNotNull() & ~F.isnan(t))
    return df.where(known).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), t.alias("t"))


def nearest_rows(queries: DataFrame, rows: DataFrame, vec: str, key: str, k: int, metric: str = "euclidean", cell: Column | None = None) -> DataFrame:
    """(query, neighbour, distance, rank, weight): the ``k`` rows nearest to each query, rows of its own key left out, with weight
    1 / (1 + distance). Ties go to the smaller key. ``cell``, a column of both, keeps the search within equal values (a snapshot).

    Rows with a null key, a null or empty vector or a component that is null or not finite take no part, nor do vectors of
    another length than the query's; for ``cosine``, vectors of zeros. A repeated row is one neighbour.
    """
    both = []
    for df in (queries, rows):
        known = df.withColumn("_cell", cell if cell is not None else F.lit(0))
        both.append(known.where(usable(known, vec, key) & F.col("_cell").isNotNull()).select(F.col("_cell").alias("cell"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.lit(0.0).alias("t")))
    return _ranked(_search(*both, k, metric), k)


def time_blocks(df: DataFrame, levels: int) -> list[float]:
    """At most 2 ** levels - 1 cuts of column t into blocks of about as many rows; equal times are in one block."""
    if df.isEmpty():
        return []
    return sorted(set(df.approxQuantile("t", [i / 2**levels for i in range(1, 2**levels)], 0.25 / 2**levels)))


def nearest_earlier(df: DataFrame, vec: str, key: str, time: str, k: int, metric: str = "euclidean", levels: int = 4) -> DataFrame:
    """As ``nearest_rows``, of each row among the rows of an earlier time; equal times are not earlier, and a row without a time takes no
    part. Rows are cut into blocks of time, which halves the work: a block is met by itself and by later blocks only."""
    from .aggregates import _part

    rows = _plain(df, vec, key, time)
    cuts = time_blocks(rows, levels)
    rows = kept_table(rows.withColumn("block", _part("t", cuts)))
    q = rows.withColumn("cell", F.col("block"))
    r = rows.withColumn("cell", F.explode(F.sequence(F.col("block"), F.lit(len(cuts)))))
    return _ranked(_search(q, r, k, metric, past=True), k)


@dataclass
class Index:
    """Random projections: a table's code has a bit for each projection above the sample's median. ``probes`` codes a table are looked
    up, nearest first by the squared distance of the query to the medians that it would have to be on the other side of.
    ``recall`` is the share of the sample's nearest pairs that so many probes find."""

    directions: np.ndarray  # tables x bits x components
    medians: np.ndarray
    masks: np.ndarray  # codes to be probed differ from the query's by one of these
    probes: int
    recall: float

    @property
    def bits(self) -> int:
        return self.directions.shape[1]

    def project(self, v: np.ndarray) -> np.ndarray:
        return np.einsum("nc,tbc->ntb", v, self.directions) - self.medians

    def codes(self, p: np.ndarray) -> np.ndarray:
        return ((p > 0) << np.arange(self.bits)).sum(axis=2)

    def ordered_masks(self, p: np.ndarray) -> np.ndarray:
        """For each row and table, all masks from the cheapest on."""
        own = (self.masks[:, None] >> np.arange(self.bits)) & 1
        return self.masks[np.argsort((p * p) @ own.T, axis=2, kind="stable")]

    def lookups(self, v: np.ndarray) -> np.ndarray:
        """rows x tables x probes codes."""
        p = self.project(v)
        return self.codes(p)[:, :, None] ^ self.ordered_masks(p)[:, :, : self.probes]


def fit_index(sample: np.ndarray, rows: int, k: int, tables: int = 8, recall: float = 0.95, seed: int = 0, bucket: int = 256) -> Index:
    """The finest index that finds ``recall`` of the nearest pairs of a sample at up to half of all probes: buckets of about ``bucket``
    of the ``rows`` rows, or coarser. Pairs of the sample are farther apart than those of all rows, so the whole's recall is
    no lower than what the sample promises, as far as the sample stands for the rows."""
    rng = np.random.default_rng(seed)
    unit = sample - sample.mean(axis=0)
    asked = unit[rng.permutation(len(unit))[:ASKED]]
    square = (asked**2).sum(axis=1)[:, None] + (unit**2).sum(axis=1)[None] - 2 * asked @ unit.T
    square[square <= 1e-12 * (1 + square.max(initial=0))] = np.inf  # itself and its copies, which share all codes
    near = np.argsort(square, axis=1)[:, : max(1, min(k, len(unit) - 1))]
    for bits in range(max(0, min(20, round(math.log2(max(1, rows / bucket))))), 0, -1):
        directions = rng.standard_normal((tables, bits, sample.shape[1]))
        medians = np.median(np.einsum("nc,tbc->ntb", sample, directions), axis=0)
        masks = range(1 << bits) if bits <= 10 else [sum(1 << i for i in c) for n in range(4) for c in combinations(range(bits), n)]
        index = Index(directions, medians, np.array(masks), 1, 1.0)
        codes, p = index.codes(index.project(sample)), index.project(asked + sample.mean(axis=0))
        order = index.ordered_masks(p)
        wanted = (index.codes(p)[:, None, :] ^ codes[near]).reshape(len(asked), near.shape[1], tables)
        place = np.full(wanted.shape[:2], len(masks))
        for t in range(tables):
            rank = np.full((len(asked), 1 << bits), len(masks)) if bits <= 16 else None
            for i in range(len(asked)):
                if rank is not None:
                    rank[i, order[i, t]] = np.arange(len(masks))
                    place[i] = np.minimum(place[i], rank[i, wanted[i, :, t]])
                else:
                    at = {m: n for n, m in enumerate(order[i, t].tolist())}
                    place[i] = np.minimum(place[i], [at.get(m, len(masks)) for m in wanted[i, :, t].tolist()])
        ranks = np.sort(place.ravel())
        probes = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1
        if probes <= max(1, len(masks) // 2):
            index.probes, index.recall = probes, float((ranks < probes).mean())
            return index
    return Index(np.zeros((1, 0, sample.shape[1])), np.zeros((1, 0)), np.zeros(1, np.int64), 1, 1.0)  # one bucket: exact


def _sample(rows: DataFrame, seed: int) -> np.ndarray:
    """At most SAMPLE vectors of the commonest length, by a seeded hash of the id."""
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return np.empty((0, 0))
    got = rows.where(F.size("v") == width["w"]).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").toPandas()
    return np.array(got["v"].tolist(), float)


def approximate_neighbours(queries: DataFrame, rows: DataFrame, vec: str, key: str, k: int, tables: int = 8, recall: float = 0.95, seed: int = 0) -> DataFrame:
    """As ``nearest_rows`` by Euclidean distance, but a query meets only rows of the buckets that it probes, in any of ``tables`` tables.
    Every row is indexed. What is returned is at its exact distance; about ``recall`` of the nearest are found. Vectors of another
    length than the sample's are searched exactly. However full a bucket is, its blocks are of bounded size."""
    q, r = _plain(queries, vec, key), _plain(rows, vec, key)
    sample = _sample(r, seed)
    index = fit_index(sample, r.count(), k, tables, recall, seed) if len(sample) else None
    width = sample.shape[1] if len(sample) else 0

    def cells(df: DataFrame, asked: bool) -> DataFrame:
        def of(v: pd.Series) -> pd.Series:
            out: list = [[-1]] * len(v)  # all rows of another length share a cell
            own = [i for i, x in enumerate(v) if len(x) == width]
            for lo in range(0, len(own), 1024):
                some = own[lo : lo + 1024]
                a = np.array([v.iloc[i] for i in some], float)
                codes = index.lookups(a) if asked else index.codes(index.project(a))[:, :, None]
                coded = codes + (np.arange(codes.shape[1]) << 32)[None, :, None]
                for i, c in zip(some, coded.reshape(len(some), -1).tolist(), strict=True):
                    out[i] = c
            return pd.Series(out)

        return df.withColumn("cell", F.explode(F.pandas_udf(of, "array<bigint>")("v")))

    if index is None:
        return _ranked(_search(q.withColumn("cell", F.lit(0)), r.withColumn("cell", F.lit(0)), k, "euclidean"), k)
    return _ranked(_search(cells(q, True), cells(r, False), k, "euclidean"), k)


def snapshot_neighbours(df: DataFrame, snapshot: str, features: list[str], k: int = 10) -> DataFrame:
    """(snapshot, <feature>_mean, <feature>_std, distance_ratio): for each snapshot, whose vector is its rows' mean, statistics of the
    ``k`` nearest other snapshots' vectors, and the ratio of the nearest distance to the k-th (1 if that is 0 or there are fewer).
    A snapshot with a feature that is never known, or without a name, takes no part. The deviation is the population's."""
    means = df.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in features))
    means = kept_table(means.na.drop().withColumn("id", F.xxhash64(F.col(snapshot).cast("string"))).withColumn("v", F.array(*features)))
    near = nearest_rows(means, means, "v", "id", k)
    values = means.select(F.col("id").alias("neighbour"), *features)
    stats = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    first, last = F.min("distance"), F.max(F.when(F.col("rank") == k, F.col("distance")))
    out = near.join(values, "neighbour").groupBy(F.col("query").alias("id")).agg(*stats, F.when(last > 0, first / F.nullif(last, F.lit(0.0))).otherwise(1.0).alias("distance_ratio"))
    return means.select("id", snapshot).join(out, "id").drop("id")
