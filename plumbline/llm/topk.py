"""Exact top-k by inner product with block-at-a-time pruning.

A vector's components are the weights of its terms. Rows are range-partitioned by id. In a partition documents are numbered
anew, by the signs of its heaviest terms and then by id, so that ranges of documents are alike; each range of ``block`` numbers is
a block, for which the largest and smallest weight of every term is kept. A query's bound for a block is the sum, over terms, of
its weight times the block's extreme of the matching sign. Blocks are taken in order of falling bound and scored through their
forward index (the rows' weights) until the next bound is below the query's k-th score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

EXACT = float(1 << 53)


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double; rows with null parts or non-finite components go."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width; missing components count as 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, block: int):
    """(place of the query, id, score) of the k best of these rows for each query, of those that reach its floor; ties to the smaller id."""
    big = max(int(np.abs(rows).max(initial=0)), int(np.abs(queries).max(initial=0)))
    exact = np.float64 if float(big) ** 2 * max(1, rows.shape[1]) < EXACT else np.int64
    # rows of the same leading signs stand together, which makes the blocks' extremes tight
    lead = np.argsort(-np.abs(rows.astype(np.float64)).sum(0), kind="stable")[:12]
    order = np.lexsort([ids, *(rows[:, j] > 0 for j in lead[::-1])])
    ids, rows, queries = ids[order], rows[order].astype(exact), queries.astype(exact)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    out = []
    for at in range(len(q_ids)):
        q = queries[at]
        bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
        best_s, best_i, kth = np.empty(0, exact), np.empty(0, np.int64), floor[at]
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < kth:
                break
            part = slice(starts[b], starts[b] + block)
            score = rows[part] @ q
            keep = (score >= kth) & (ids[part] != q_ids[at])
            best_s, best_i = np.concatenate([best_s, score[keep]]), np.concatenate([best_i, ids[part][keep]])
            if len(best_s) > k:
                top = np.lexsort([best_i, -best_s])[:k]
                best_s, best_i = best_s[top], best_i[top]
                kth = max(kth, best_s[-1])
        out.append((np.full(len(best_i), at), best_i, best_s.astype(np.int64)))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    block: int = 256,
    partition_rows: int = 65536,
    chunk: int = 4096,
    seed_rows: int = 2048,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, v) for each row of ``queries``, never the query's own id.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Repeated ids or vectors are ordinary rows;
    a query that is repeated is one query, an id with several vectors several; no rows give no result; vectors of unequal length
    are padded with zeros; null ids and vectors take no part; other columns are ignored; scores must fit a long. Queries travel in chunks of ``chunk`` vectors, each met by all rows in blocks. A first
    ``seed_rows`` rows, scored on the driver, give each query a k-th score from which pruning starts; it
    saves work and changes no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    known = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    vectors = scratch.keep(vectors.where(known).select("vec_id", "v"), "vectors")
    queries = scratch.keep(queries.where(known).select("vec_id", "v").dropDuplicates(["vec_id", "v"]), "queries")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(1, math.ceil(n / partition_rows), min(spark.sparkContext.defaultParallelism, n // 4096))
    seeds = vectors.limit(seed_rows).collect()
    seed_ids, seed = np.array([r[0] for r in seeds], np.int64), _matrix([r[1] for r in seeds], width)
    dealt = vectors.repartitionByRange(parts, "vec_id")
    n_chunks = max(1, math.ceil(queries.count() / chunk))
    chunks = queries.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)))
    found = None
    for c in range(n_chunks):
        own = sorted((r["vec_id"], tuple(r["v"])) for r in chunks.where(F.col("c") == c).collect())
        q_ids, q = np.array([i for i, _ in own], np.int64), _matrix([v for _, v in own], width)
        floor = np.full(len(q_ids), -np.inf)
        if len(seed_ids) > k and len(q_ids):
            score = (q.astype(np.float64) @ seed.T.astype(np.float64))
            score[q_ids[:, None] == seed_ids[None, :]] = -np.inf
            floor = np.partition(score, -k, axis=1)[:, -k]
            floor -= 1e-9 * np.abs(floor)  # scores beyond 2**53 are rounded
        shipped = spark.sparkContext.broadcast((q_ids, q, floor))

        def part(batches, shipped=shipped, width=width, c=c):
            ids, rows = [], []
            for b in batches:
                ids.append(b["vec_id"].to_numpy(np.int64))
                rows.append(_matrix(list(b["v"]), width))
            q_ids, q, floor = shipped.value
            if ids and len(q_ids):
                at, vec, score = _search(np.concatenate(ids), np.concatenate(rows), q_ids, q, floor, k, block)
                yield pd.DataFrame({"query_id": q_ids[at], "q": c << 32 | at, "vec_id": vec, "score": score})

        more = dealt.mapInPandas(part, "query_id bigint, q bigint, vec_id bigint, score bigint")
        found = more if found is None else found.unionByName(more)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
