"""Graphs as edge tables (src, dst), undirected: structure, neighbours, link prediction and bipartite embeddings."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept_table
from .windows import named

#: Of Shapley values: distances that a task holds at once; pairs of rows that make a task, and a task where few; training rows of a piece.
HELD, PAIRS, SMALL, SLAB = 1 << 24, 1 << 28, 1 << 23, 512


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways once, without loops."""
    e = edges.select("src", "dst").where("src != dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def structure(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering). Edges point from the lower (degree, node) to the higher, so that a hub's pairs don't
    blow up; each triangle is found once and counted for its three nodes."""
    both = undirected(edges)
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    a, b = deg.select(F.col("node").alias("src"), F.col("degree").alias("da")), deg.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    out = both.join(a, "src").join(b, "dst").where("da < db or (da = db and src < dst)").select("src", "dst")
    x, y = out.select("src", F.col("dst").alias("p")), out.select("src", F.col("dst").alias("q"))
    wedges = x.join(y, "src").where("p != q")
    tri = wedges.join(out.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    n = tri.select(F.explode(F.array("src", "p", "q")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = deg.join(n, "node", "left").na.fill(0, ["triangles"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return t.withColumn("clustering", F.coalesce(F.col("triangles") / F.nullif(pairs, F.lit(0.0)), F.lit(0.0)))


def neighbour_aggregate(edges: DataFrame, nodes: DataFrame, node: str, value: str, fill: float = 0.0) -> DataFrame:
    """(node, count, mean) of neighbours' values; ``fill`` for isolated nodes."""
    v = nodes.select(F.col(node).alias("dst"), F.col(value).alias("_v"))
    a = undirected(edges).join(v, "dst").groupBy(F.col("src").alias(node)).agg(F.count("*").alias("neighbours"), F.avg("_v").alias("neighbour_mean"))
    return nodes.select(node).join(a, node, "left").na.fill({"neighbours": 0, "neighbour_mean": fill})


def link_prediction(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): common neighbours, Jaccard, preferential attachment, Adamic-Adar (sum of 1 / ln degree) and resource
    allocation (sum of 1 / degree)."""
    both = undirected(edges)
    deg = both.groupBy(F.col("src").alias("z")).agg(F.count("*").alias("d"))
    na, nb = both.select(F.col("src").alias("a"), F.col("dst").alias("z")), both.select(F.col("src").alias("b"), F.col("dst").alias("z"))
    common = pairs.join(na, "a").join(nb, ["b", "z"]).join(deg, "z")
    s = common.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(1 / F.log(F.when(F.col("d") > 1, F.col("d")))).alias("adamic_adar"), F.sum(1 / F.col("d")).alias("allocation"))
    out = pairs.join(s, ["a", "b"], "left").join(deg.select(F.col("z").alias("a"), F.col("d").alias("da")), "a", "left").join(deg.select(F.col("z").alias("b"), F.col("d").alias("db")), "b", "left")
    out = out.na.fill(0, ["common", "da", "db"]).na.fill(0.0, ["adamic_adar", "allocation"])
    return out.select("a", "b", "common", F.coalesce(F.col("common") / F.nullif(F.col("da") + F.col("db") - F.col("common"), F.lit(0)), F.lit(0.0)).alias("jaccard"), (F.col("da") * F.col("db")).alias("attachment"), "adamic_adar", "allocation")


def tf_idf(df: DataFrame, entity: str, item: str, weight: str | None = None) -> DataFrame:
    """(entity, item, w): share of an entity's (weighted) rows times ln(entities / entities with the item) + 1."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    n = df.groupBy(entity, item).agg(w.alias("c"))
    total, entities = n.groupBy(entity).agg(F.sum("c").alias("t")), n.select(entity).distinct().agg(F.count("*").alias("all"))
    dfq = n.groupBy(item).agg(F.count("*").alias("df"))
    return n.join(total, entity).join(dfq, item).crossJoin(entities).select(entity, item, (F.col("c") / F.col("t") * (F.log(F.col("all") / F.col("df")) + 1)).alias("w"))


def decayed_weights(df: DataFrame, entity: str, item: str, time: str, half_life: float, now: Column | None = None) -> DataFrame:
    """(entity, item, w): the sum over a pair's rows of 0.5 ** (age in days / half_life), the age counted from ``now`` or from the latest
    time of all. Rows without entity, item or time don't count, nor do rows after ``now``."""
    if not half_life > 0:
        raise ValueError("half_life must be above 0")
    known = df.select(entity, item, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).na.drop()
    end = F.unix_micros(now.cast("timestamp")) if now is not None else F.lit(known.agg(F.max("_t")).first()[0])
    age = (end - F.col("_t")) / (86400 * 1e6)
    return known.where(age >= 0).groupBy(entity, item).agg(F.sum(F.pow(F.lit(0.5), age / half_life)).alias("w"))


def embed(weights: DataFrame, entity: str, item: str, rank: int = 4, rounds: int | None = None, seed: int = 0, tol: float = 1e-6, most: int = 200) -> DataFrame:
    """(entity, vector): leading singular directions of the entity x item matrix by subspace iteration. A round is a join with the items'
    ``rank`` numbers and two sums, kept as tables; only rank x rank matrices reach the driver. It goes on until no singular value
    moves by more than ``tol`` of the largest, which is an error after ``most`` rounds, or for ``rounds`` rounds if they are given."""
    cols = [f"q{i}" for i in range(rank)]
    u = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed + i), item), 11) / float(1 << 53) - 0.5
    w = kept_table(weights)
    items = w.select(item).distinct().select(item, *(u(i).alias(c) for i, c in enumerate(cols)))

    def gram(df: DataFrame) -> np.ndarray:
        g = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in cols for b in cols)).first()
        return np.array([[g[f"{a}_{b}"] or 0.0 for b in cols] for a in cols])

    def orthogonal(df: DataFrame, key: str, m: np.ndarray) -> DataFrame:
        t = np.linalg.inv(np.linalg.cholesky(m + (1e-12 * np.trace(m) + 1e-300) * np.eye(rank))).T
        return df.select(key, *(sum(F.col(c) * float(t[j, i]) for j, c in enumerate(cols)).alias(cols[i]) for i in range(rank)))

    before, done = None, 0
    while rounds is None or done < rounds:
        left = kept_table(w.join(items, item).groupBy(entity).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in cols)))
        m = gram(left)
        values = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0))
        if rounds is None and before is not None and np.abs(values - before).max() <= tol * max(values.max(), 1e-300):
            break
        if rounds is None and done >= most:
            raise RuntimeError(f"singular values still move after {most} rounds")
        back = kept_table(w.join(orthogonal(left, entity, m), entity).groupBy(item).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in cols)))
        items, before, done = orthogonal(back, item, gram(back)), values if done else None, done + 1  # the first items weren't orthogonal
    return w.join(items, item).groupBy(entity).agg(F.array(*(F.sum(F.col("w") * F.col(c)) for c in cols)).alias("vector"))


def out_of_fold_neighbours(df: DataFrame, key: str, vec: str, y: str, folds: int = 5, k: int = 5) -> DataFrame:
    """(key, fold, guess): mean target of the ``k`` nearest rows of other folds; folds come from a hash of the key."""
    from .neighbours import _plain, _ranked, _search

    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    f = df.withColumn("_id", F.col(key).cast("long"))
    rows = _plain(f, vec, "_id").join(f.select(F.col("_id").alias("id"), fold.alias("cell")).distinct(), "id")
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("cell"))
    near = _ranked(_search(rows, rows.withColumn("cell", F.explode(others)), k, "euclidean"), k)
    got = near.join(df.select(F.col(key).alias("neighbour"), y), "neighbour").groupBy(F.col("query").alias(key)).agg(F.avg(y).alias("guess"))
    return got.withColumn("fold", fold).select(key, "fold", "guess")


def _dense(v: pa.ListArray, width: int, odd: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows of ``width`` components, lacking ones as 0; and if some may lack, which are known."""
    flat = v.flatten()
    if not odd:
        return flat.to_numpy(zero_copy_only=False).reshape(len(v), width), None
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, starts = np.repeat(np.arange(len(v)), sizes), np.cumsum(sizes) - sizes
    at = row, np.arange(len(flat)) - np.repeat(starts, sizes)
    out, known = np.zeros((len(v), width), flat.type.to_pandas_dtype()), np.zeros((len(v), width), bool)
    out[at], known[at] = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return out, known


class _Slabs:
    """Rows of numbers in a file of the task, SLAB rows a piece, components first."""

    def __init__(self, width: int):
        self.file, self.width, self.n, self.rest = tempfile.TemporaryFile(), width, 0, None

    def add(self, rows: np.ndarray) -> None:
        rows = rows if self.rest is None else np.concatenate([self.rest, rows])
        whole = len(rows) - len(rows) % SLAB
        for i in range(0, whole, SLAB):
            self.file.write(np.ascontiguousarray(rows[i : i + SLAB].T))
        self.n, self.rest = self.n + whole, rows[whole:].copy()

    def read(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first row, its piece)."""
        self.file.flush()
        if self.n and self.width:
            pieces = np.memmap(self.file, self.rest.dtype, "r", shape=(self.n // SLAB, self.width, SLAB))
            yield from ((i * SLAB, x) for i, x in enumerate(pieces))
        elif self.n:
            yield 0, np.empty((0, self.n), self.rest.dtype)
        if len(self.rest):
            yield self.n, self.rest.T

    def some(self, at: np.ndarray) -> np.ndarray:
        """These rows, components first."""
        out = np.empty((self.width, len(at)))
        for lo, piece in self.read():
            own = (at >= lo) & (at < lo + piece.shape[1])
            if own.any():
                out[:, own] = piece[:, at[own] - lo]
        return out


def _distances(slabs: _Slabs, known: _Slabs, q: np.ndarray, q_known: np.ndarray | None, n: int) -> np.ndarray:
    """Squared distances of each row of ``q`` to all rows, summed in the order of components as in SQL; nan if no component is known in both."""
    out = np.empty((len(q), n))
    for (lo, piece), (_, own) in zip(slabs.read(), slabs.read() if q_known is None else known.read(), strict=True):
        m = piece.shape[1]
        piece = np.pad(piece.astype(float), [(0, 0), (0, m == 1)])  # of one column, numpy adds the halves
        room = np.empty(piece.shape)
        for i, row in enumerate(q):
            np.subtract(piece, row[:, None], out=room)
            np.multiply(room, room, out=room)
            if q_known is not None:
                both = own & q_known[i][:, None]
                room[:, :m][~both] = 0
            out[i, lo : lo + m] = np.add.reduce(room, axis=0)[:m]
            if q_known is not None:
                out[i, lo : lo + m][~both.any(axis=0)] = np.nan
    return out


def _nearest_first(d: np.ndarray) -> np.ndarray:
    """The order of distances, equal ones as they stand; unknown ones last."""
    order = np.argsort(d)
    near = d[order]
    if (near[1:] > near[:-1]).all():
        return order
    run = np.cumsum(np.append(False, (near[1:] != near[:-1]) & ~np.isnan(near[:-1])))
    return np.sort(run * len(d) + order) % len(d)


def _rough_orders(slabs: _Slabs, q: np.ndarray, by_key: np.ndarray) -> tuple[list[np.ndarray | None], float]:
    """For each row of ``q`` the order of all rows, from products of matrices; rows that these can't tell apart are ordered by their distances
    as ``_distances`` gives them. None if that would be many. And the share that is None."""
    n = len(by_key)
    d, squares, long = np.empty((len(q), n)), np.empty(n), (q * q).sum(axis=1)
    for lo, piece in slabs.read():
        piece = piece.astype(float)
        hi = lo + piece.shape[1]
        np.matmul(q, piece, out=d[:, lo:hi])
        squares[lo:hi] = (piece * piece).sum(axis=0)
    d *= -2
    d += squares
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (long + squares.max())  # of the difference of two
    orders: list[np.ndarray | None] = []
    doubts = []
    for i in range(len(q)):
        own = d[i, by_key]
        order = np.argsort(own)
        near = own[order]
        close = ~(near[1:] - near[:-1] > slack[i])
        at = np.flatnonzero(np.append(close, False) | np.append(False, close))
        orders.append(order if len(at) <= n >> 8 else None)
        if 0 < len(at) <= n >> 8:
            doubts.append((i, at, np.cumsum(np.append(False, ~close))[at], order[at]))
    if doubts:
        found = slabs.some(by_key[np.concatenate([x[3] for x in doubts])])
        lo = 0
        for i, at, run, rows in doubts:
            exact = np.zeros(len(rows))
            for component, x in zip(found[:, lo : lo + len(rows)], q[i], strict=True):
                exact += (component - x) * (component - x)
            orders[i][at] = rows[np.lexsort((rows, exact, run))]
            lo += len(rows)
    return orders, sum(x is None for x in orders) / len(orders)


def knn_shapley(train: DataFrame, test: DataFrame, key: str, vec: str, y: str, k: int = 5) -> DataFrame:
    """(key, value): each training row's exact Shapley value of a k-nearest classifier, averaged over test rows. For a test row the
    training rows stand by distance, then key; values follow from the farthest inwards.

    Every test row ranks every training row, so the work is the product of their numbers. A task takes a share of the test rows; training
    rows come to it as a stream that it lays down in a file of its own and reads piece by piece, HELD distances at a time. It
    holds a few numbers for each training row, and no vectors; no pair leaves it, only sums by training row.
    Components that are null or lacking in either vector are passed over; rows at no known distance stand last.
    """
    null = F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    kind = dict(train.dtypes)[vec] if dict(train.dtypes)[vec] == dict(test.dtypes)[vec] == "array<float>" else "array<double>"
    size = F.greatest(F.coalesce(F.size(vec), F.lit(0)), F.lit(0))
    known, asked = (x.agg(F.count("*").alias("n"), F.max(size).alias("most"), F.min(size).alias("least"), F.max(null).alias("null"), F.max(F.col(y).isNull()).alias("blind")).first() for x in (train, test))
    out = train.select(key).schema
    if not known["n"] or not asked["n"]:
        return train.limit(0).select(key, F.lit(None).cast("double").alias("value"))
    n, width = known["n"], max(known["most"], asked["most"])
    odd, blind = known["null"] or asked["null"] or min(known["least"], asked["least"]) < width, known["blind"] or asked["blind"]
    pairs, cores = n * asked["n"], train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(asked["n"], max(math.ceil(pairs / PAIRS), min(3 * cores, math.ceil(pairs / SMALL)))))
    columns = [F.col(key).alias("id"), F.col(vec).cast(kind).alias("v"), F.col(y).alias("y")]
    a = test.select(*columns, F.lit(False).alias("known"), F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int").alias("part"))
    b = train.select(*columns, F.lit(True).alias("known"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
    rows = b.unionByName(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs, marks = _Slabs(width), _Slabs(width)
        ids, labels, asks, parts = [], [], [], set()
        for batch in batches:
            parts.update(batch["part"].unique().to_pylist())
            b, a = batch.filter(batch["known"]), batch.filter(pc.invert(batch["known"]))
            if len(b):
                v, own = _dense(b["v"], width, odd)
                slabs.add(v)
                if odd:
                    marks.add(own)
                ids.append(b["id"])
                labels.append(b["y"])
            if len(a):
                asks.append(a)
        if len(parts) > 1:
            raise ValueError("training rows of two shares of the test rows meet in a partition")
        if not asks or not ids:
            return
        ids, a = pa.concat_arrays(ids), pa.Table.from_batches(asks).combine_chunks()
        by_key = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        both = pa.concat_arrays([*labels, *a["y"].chunks]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        label, wanted = both[: len(ids)][by_key], both[len(ids) :]
        q, q_known = _dense(a["v"].chunk(0), width, odd)
        q = q.astype(float)
        lists: dict = {}
        for i, t in enumerate(a["id"].to_pylist()):  # a key that test rows share has one list
            lists.setdefault(t, []).append(i)
        total, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        keys, block = list(lists.values()), max(1, HELD // len(ids))
        plain = not odd and all(len(x) == 1 for x in keys)

        def learn(x: list[int], order: np.ndarray) -> None:
            nonlocal total, count
            hit = (label[:, None] == wanted[x]).astype(float)
            if blind:
                hit[(label[:, None] < 0) | (wanted[x] < 0)] = np.nan
            s, told = _values(hit.ravel()[order], n, k, blind)
            place = order // len(x)
            total += np.bincount(place, s, len(ids))
            count += 1 if told is None and len(x) == 1 else np.bincount(place if told is None else place[told], minlength=len(ids))

        for lo in range(0, len(keys), block):
            now = keys[lo : lo + block]
            if plain:
                orders, unclear = _rough_orders(slabs, q[[x[0] for x in now]], by_key)
                for x, order in zip(now, orders, strict=True):
                    if order is not None:
                        learn(x, order)
                now, plain = [x for x, order in zip(now, orders, strict=True) if order is None], unclear < 0.5
            some, at = [i for x in now for i in x], 0
            d = _distances(slabs, marks, q[some], q_known[some] if odd else None, len(ids)) if some else None
            for x in now:
                learn(x, _nearest_first(d[at : at + len(x), by_key].T.ravel()))
                at += len(x)
        yield from pa.Table.from_arrays([ids.take(pa.array(by_key)), pa.array(total), pa.array(count)], ["id", "total", "n"]).to_batches(1 << 16)

    sums = rows.repartitionById(tasks, F.col("part")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, total double, n bigint")
    return sums.groupBy("id").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value")).select(F.col("id").cast(out[key].dataType).alias(key), "value")


def _values(hit: np.ndarray, n: int, k: int, blind: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Values along a test row's list, from whether each training row's label is the test row's (nan: unknown); and which are known."""
    i = np.arange(1, len(hit) + 1)
    after = np.append(hit[1:], np.nan)
    step = (hit - after) / k * np.minimum(k, i) / i
    step[-1] = hit[-1] / n
    if not blind:
        return np.cumsum(step[::-1])[::-1], None
    step = np.where(np.isnan(after), hit / n, step)
    told = ~np.isnan(step)
    return np.cumsum(np.where(told, step, 0)[::-1])[::-1], np.cumsum(told[::-1])[::-1] > 0


def adversarial_auc(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(column, auc): how well one column alone tells the frames apart, 0.5 meaning not at all."""
    from .metrics import auc

    both = a.select(*cols).withColumn("_y", F.lit(0)).unionByName(b.select(*cols).withColumn("_y", F.lit(1)))
    long = both.select("_y", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))).alias("e")).select("_y", "e.column", "e.v")
    return auc(long, "_y", "v", ["column"]).select("column", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))


def spectral(edges: DataFrame, component: str, most: int = 2000) -> DataFrame:
    """(component, n, gap): the second smallest eigenvalue of each component's Laplacian; null for a single node. A component is a dense
    matrix in one task, so one of more than ``most`` nodes is an error."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = {v: i for i, v in enumerate(sorted({*g["src"], *g["dst"]}))}
        gap = None
        if len(names) > most:
            raise ValueError(f"component {g[component].iloc[0]} has {len(names)} nodes, more than {most}")
        if len(names) > 1:
            m = np.zeros((len(names),) * 2)
            for s, d in zip(g["src"], g["dst"], strict=True):
                m[names[s], names[d]] = m[names[d], names[s]] = -1
            np.fill_diagonal(m, 0)
            gap = float(np.sort(np.linalg.eigvalsh(m - np.diag(m.sum(axis=1))))[1])
        return pd.DataFrame({component: named(g, component), "n": [len(names)], "gap": [gap]})

    return edges.groupBy(component).applyInPandas(run, f"{component} {dict(edges.dtypes)[component]}, n bigint, gap double")
