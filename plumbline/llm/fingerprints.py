"""Document fingerprints by MinHash, and near-duplicate links from bands of them.

A fingerprint keeps, for each of 128 universal hash functions a * x + b over 64-bit shingle hashes, sixteen bits of
the least value; the share of equal places estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_lists
from .linking import link
from .near_dedup import bands_of, text_key
from .shingles import WORDS, shingles

PLACES = 128
_rng = np.random.default_rng(20)
A = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
#: Bands and their rows; a pair of Jaccard 0.8 shares a band with a chance of 0.998.
BANDS, ROWS = 21, 6
#: Text bytes of a range of ids, and the most ranges. A range is a stream, so neither bounds memory nor changes results.
RANGE_BYTES, MOST_RANGES, PER_RANGE = 8 << 20, 20_000, 16


_rows = np.empty((256, PLACES), np.uint64)  # a worker's own; new memory for each text costs more than the products


def least_hashes(x: np.ndarray) -> np.ndarray:
    """For each hash function its least value over shingle hashes; the largest number of all without any."""
    least, x = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64), np.unique(x)
    for i in range(0, len(x), len(_rows)):
        part = x[i : i + len(_rows), None]
        values = np.multiply(part, A, out=_rows[: len(part)])
        values += B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def places_of(least: np.ndarray, found: bool) -> np.ndarray:
    """128 16-bit places; a text without words has 0 in all, and other texts' zeros become 1."""
    return np.maximum((least >> np.uint64(20)).astype(np.uint16), 1) if found else np.zeros(PLACES, np.uint16)


def signature(text: str | None) -> np.ndarray:
    x = shingles(text)
    return places_of(least_hashes(x), len(x) > 0)


def common_start(text: str, cut: int) -> int:
    """How many first shingles of a text any text has that begins with its first ``cut`` code points: those of words that end before."""
    return max(0, len(text[:cut].split()) - 1 - (WORDS - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprint(documents: DataFrame) -> DataFrame:
    """``documents`` with fingerprint: 512 hex digits. A null text counts as empty; a clashing column is replaced."""
    run = F.pandas_udf(lambda t: pd.Series([written(signature(x)) for x in t.fillna("")], dtype="object"), "string")
    return documents.withColumn("fingerprint", run(F.col("text")))


def near_classes(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, h, class_id): the class of documents whose shingle sets have a Jaccard similarity of ``threshold`` or more, linked
    through others or not, named by its least id. Bands of the signatures are joined and every link is verified.

    ``h`` is the text's hash. A null text counts as empty; texts without words are like equal texts only; a text of fewer
    than five words is one shingle. Null ids count last. Repeated rows are repeated; clashing columns play no part.
    """
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "prints")
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))

    def places(text: pa.Array) -> pa.Array:
        marks = [signature(t) for texts in text_lists(text) for t in texts]
        found = bands_of(np.array(marks, np.uint64).reshape(-1, PLACES), BANDS, ROWS)
        return pa.array([b if m.any() else b[:0] for b, m in zip(found, marks, strict=True)], pa.list_(pa.int64()))

    def unpack(text: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingles(t)).view(np.int64) for texts in text_lists(text) for t in texts], pa.list_(pa.int64()))

    def jaccard(a: np.ndarray, b: np.ndarray) -> float:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(1, len(a) + len(b) - both)

    rows = scratch.keep(own.select("doc_id", F.xxhash64("text").alias("h"), "key", F.arrow_udf(places, "array<bigint>")(F.col("text")).alias("bands")), "rows")
    found = link(rows.select("key", "bands"), own.select("key", "text"), unpack, jaccard, threshold)
    ids = scratch.keep(rows.select("doc_id", "h", "key").join(found, "key", "left").withColumn("class", F.coalesce("class", "key")), "ids")
    scratch.drop(rows)
    least = scratch.keep(ids.groupBy("class").agg(F.min("doc_id").alias("class_id")), "least")
    return ids.join(least, "class").select("doc_id", "h", "class_id")


def _order(none: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes in the order of (none, id, hash)."""
    parts = np.stack([none.astype(np.int64), ids.astype(np.int64), h.astype(np.int64)], axis=1)
    return np.ascontiguousarray((parts.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view("S24").ravel()


def compare_edits(documents: DataFrame, classes: bool = True) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id; after the last comes the first, and a lone document follows itself. Null ids come
    last, equal ids in order of their texts' hashes. A null text counts as empty; empty texts are like each other (1.0)
    and like no other text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and class_id, the least id of the near-duplicates' class (null if not ``classes``).

    Ranges of (id, hash) are streams; each range's stream also gets the first row of the next range. So a text is shuffled
    once, and to the driver go a bounded sample of keys and one row for each range. Identical rows share a range.
    """
    spark = documents.sparkSession
    small_batches(spark)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
    n, size = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], schema)
    keyed = lambda df: df.withColumn("none", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    rows = keyed(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
    n_ranges = min(MOST_RANGES, max(8, size // RANGE_BYTES))
    u = F.pmod(F.xxhash64(F.lit(31), "id", "h"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(u < min(1.0, PER_RANGE * n_ranges / n)).select("none", "id", "h").distinct().toPandas()
    sample = np.sort(_order(*(some[c].to_numpy() for c in ("none", "id", "h"))))
    cuts = np.unique(sample[np.arange(1, n_ranges) * len(sample) // n_ranges]) if len(sample) else sample
    of = F.arrow_udf(lambda none, i, h: pa.array(np.searchsorted(cuts, _order(*(x.to_numpy(zero_copy_only=False) for x in (none, i, h))), side="right"), pa.int32()), "int")
    rows = rows.withColumn("range", of("none", "id", "h"))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min(F.struct("none", "id", "h")).alias("first")).collect()}
    order = sorted(firsts)
    before = [(r, order[i - 1], firsts[r]["none"], firsts[r]["id"], firsts[r]["h"]) for i, r in enumerate(order)]
    heads = F.broadcast(spark.createDataFrame(before, "range int, back int, f_none boolean, f_id bigint, f_h bigint"))  # a row for each range
    head = (F.col("none") == F.col("f_none")) & (F.col("id") == F.col("f_id")) & (F.col("h") == F.col("f_h"))
    place = lambda to, guest: F.struct(F.col(to).alias("to"), F.lit(guest).alias("guest"))
    spots = F.explode(F.when(head, F.array(place("range", 0), place("back", 1))).otherwise(F.array(place("range", 0))))
    columns = ["doc_id", "text", "h", "none", "id", "s.to", "s.guest", "class_id"]
    dealt = rows.join(heads, "range").withColumn("class_id", F.lit(None).cast("bigint")).withColumn("s", spots).select(*columns)
    if classes:  # small rows that come just before the texts of their (id, hash)
        named = keyed(near_classes(documents).where(~F.col("class_id").eqNullSafe(F.col("doc_id"))).distinct()).withColumn("text", F.lit(None).cast("string"))
        dealt = dealt.unionByName(named.withColumn("range", of("none", "id", "h")).withColumn("s", place("range", 0)).select(*columns))
    dealt = dealt.repartition(n_ranges, "to").sortWithinPartitions("to", "guest", "none", "id", "h", F.col("text").isNotNull())
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def walk(batches):
        held = named = None
        for batch in batches:
            for i in range(0, len(batch), 500):
                b, out = batch.slice(i, 500).to_pydict(), []
                for doc, text, h, to, guest, class_id in zip(b["doc_id"], b["text"], b["h"], b["to"], b["guest"], b["class_id"], strict=True):
                    if text is None:
                        named = doc, h, class_id
                        continue
                    if held and held[2] != to:
                        raise RuntimeError("a range of ids has no follower")
                    # a text and its edited text share the shingles before the cut, whose least values are taken once
                    x = shingles(text) if held or not guest else None
                    shared = common_start(text, len(text) - len(text) // 2) if x is not None else 0
                    head = least_hashes(x[:shared]) if x is not None else None
                    mark = places_of(np.minimum(head, least_hashes(x[shared:])), len(x) > 0) if x is not None else None
                    if held:
                        old, before_text, _, own, group, start, before_head = held
                        half = len(before_text) // 2
                        edited = before_text[: len(before_text) - half] + text[:half]
                        y = shingles(edited)
                        other = places_of(np.minimum(before_head, least_hashes(y[start:])), len(y) > 0)
                        out.append((old, len(before_text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, mark), group))
                    group = (named[2] if named and named[:2] == (doc, h) else doc) if classes else None
                    held = None if guest else (doc, text, to, mark, group, shared, head)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.select("doc_id", "text", "h", "to", "guest", "class_id").mapInArrow(walk, schema)
