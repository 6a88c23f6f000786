"""Phrases whose words stand together more often than their parts would by chance.

Texts are dealt into shards of a bounded number of words. A shard's word ids are sorted as suffixes by prefix doubling; runs of
suffixes with a common prefix of n words (LCP intervals) are the shard's n-grams and their counts, which Spark adds by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_lists
from .shingles import GOLDEN, mix

#: Words of a shard; a longer text is cut between words, each cut followed by the words that n-grams beginning before it need.
SHARD_WORDS = 1 << 19
#: Bits of the map that tells frequent phrases: 16 MB. A full one lets all longer phrases through and loses none.
BITS = 1 << 27
#: What ends a piece, by UTF-8 byte. A-Z are put in lower case; the ends become full stops.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(ord(".") if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
UNKNOWN_LANG = "und"


class _Ids(dict):
    """Ids from 1 for words, in order of appearance; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def word_ids(text: str, ids: dict) -> np.ndarray:
    """A text's words as ids, with 0 at the end of each piece."""
    tokens = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()  # what is left to split at is blank or tab
    return np.fromiter(map(ids.__getitem__, tokens + [b"."]), np.int64, len(tokens) + 1)


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``a`` in order of their first ``depth`` ids at least, by prefix doubling: a suffix's rank by 2k ids is the rank
    of the pair (rank by k of its first half, rank by k of its second half)."""
    n, k = len(a), 1
    order = np.argsort(a, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(np.diff(a[order]) != 0)
    while k < depth and n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        k *= 2
    return order


def lcp_intervals(a: np.ndarray, most: int, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``most``: (first place, count) of each n-gram that holds no 0 and begins before ``starts``."""
    order = suffix_array(a, most)
    padded = np.concatenate([a, np.zeros(most, np.int64)])
    whole = order < starts  # suffixes that begin here and have n words before a piece ends
    same = np.ones(max(len(order) - 1, 0), bool)
    for n in range(1, most + 1):
        column = padded[order + n - 1]
        whole = whole & (column > 0)
        same = same & (column[1:] == column[:-1])  # LCP of neighbours is n or more
        run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.empty(0, np.int64)
        at, runs = order[whole], run[whole]
        first = np.flatnonzero(np.concatenate([[True], np.diff(runs) != 0])) if len(at) else np.empty(0, np.int64)
        yield at[first], np.diff(np.append(first, len(at)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` of a row's word hashes (any leading axes)."""
    m = words.shape[-1] - n + 1
    out = np.zeros((*words.shape[:-1], max(m, 0)), np.uint64)
    for j in range(n):
        out = (out + words[..., j : j + max(m, 0)]) * GOLDEN
    return mix(out)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def shard_counts(lang: str, a: np.ndarray, words: list[bytes], lengths: range, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of one shard's phrases of these lengths; the phrase of no words, with those of one, counts all words.

    ``bits`` marks hashes of phrases that are one word shorter and stand often enough: a phrase of which one part isn't marked can't
    do so itself and is left out.
    """
    vocabulary, most = pa.array(words, pa.binary()), lengths[-1]
    hashes = np.fromiter((word_hash(lang, w) for w in words), np.uint64, len(words)) if bits is not None else None

    def batch(phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(f), np.int64))), phrases, pa.array(f)], names=["lang", "phrase", "f"])

    for lo in range(0, len(a), SHARD_WORDS):
        part = a[lo : lo + SHARD_WORDS + most - 1]
        starts = min(SHARD_WORDS, len(part))
        if 1 in lengths:
            yield batch(pa.array([""]), np.array([(part[:starts] > 0).sum()], np.int64))
        for n, (at, count) in enumerate(lcp_intervals(part, most, starts), 1):
            if n not in lengths:
                continue
            if bits is not None and len(at):
                spot = gram_hashes(hashes[part[at[:, None] + np.arange(n)]], n - 1) & np.uint64(8 * len(bits) - 1)
                often = ((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                at, count = at[often], count[often]
            for i in range(0, len(at), 50_000):
                own = at[i : i + 50_000]
                columns = [vocabulary.take(pa.array(part[own + j])) for j in range(n)]
                yield batch((pc.binary_join_element_wise(*columns, b" ") if n > 1 else columns[0]).cast(pa.string()), count[i : i + 50_000])


def _count_shards(lengths: range, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        ids, held, size = _Ids(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(ids)
            for lang, parts in held.items():
                yield from shard_counts(lang, np.concatenate(parts), words, lengths, bits)

        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in text_lists(batch.column("text")):
                for text in texts:
                    a = word_ids(text, ids)
                    held.setdefault(langs[at], []).append(a)
                    size, at = size + len(a), at + 1
                    if size >= SHARD_WORDS:
                        yield from flush()
                        ids, held, size = _Ids(), {}, 0
        yield from flush()

    return run


def ngram_counts(documents: DataFrame, lengths: range, shared=None) -> DataFrame:
    """(lang, phrase, f): how often each phrase of these lengths stands within a piece, over all texts of a language; the phrase of no
    words has the number of all words. A null lang is ``und``, a null text empty."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text")
    counts = rows.mapInArrow(_count_shards(lengths, shared), "lang string, phrase string, f long")
    # A shard has one row for a phrase, so an aggregate before the shuffle would find little to add.
    return counts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _marks(phrases: DataFrame, n: int) -> np.ndarray:
    """A map of BITS bits in which the hashes of (lang, phrase) of ``n`` words are set: a page for each range of bits reaches the driver."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)
            words = np.array([[word_hash(lang, w.encode("utf-8")) for w in phrase.split(" ")] for lang, phrase in rows], np.uint64).reshape(-1, n)
            spot = (gram_hashes(words, n)[:, 0] & np.uint64(BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 15), pa.array(spot & 32767)], names=["page", "bit"])

    pages = phrases.select("lang", "phrase").mapInArrow(spots, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pages.collect():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def frequent(documents: DataFrame, least: int, most: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, words, f) of phrases that stand ``least`` times or more, and of the phrase of no words.

    Words and pairs are counted in one pass; longer phrases in a pass each, in which only those are sent whose parts of one word less
    are frequent, as far as a map of bounded size can tell: it may let others through, which the count then leaves out.
    """
    spark, out, lengths, shared = documents.sparkSession, None, range(1, min(most, 2) + 1), None
    while True:
        spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
        found = ngram_counts(documents, lengths, shared).where((F.col("f") >= least) | (F.col("phrase") == ""))
        found = scratch.keep(found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).alias("words"), "f"), f"counts-{lengths[-1]}")
        out = found if out is None else out.unionByName(found)
        if shared is not None:
            shared.unpersist()
        if lengths[-1] >= most:
            return out
        if len(lengths) > 1:
            scratch.only(found)  # the pairs' shuffle can go
        shared = spark.sparkContext.broadcast(_marks(found.where(F.col("words") == lengths[-1]), lengths[-1]).tobytes())
        lengths = range(lengths[-1] + 1, lengths[-1] + 2)


def _join_words(words: Column, start, length) -> Column:
    return F.concat_ws(" ", F.slice(words, start, length))


def collocations(documents: DataFrame, least: int = 10, most: int = 3, inside: int = 50, scale: int = 1_000_000, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of 2 to ``most`` words.

    A candidate stands ``least`` times or more. Its score is the least over its cuts into two parts of
    floor(scale * a * a / (l * r)), ties to the earlier cut. A candidate goes if a longer one that holds its words in a row has
    ``inside`` percent of its count or more. Order: score and a descending, phrase ascending by UTF-8 byte.

    Parts of a candidate stand as often as it does at least, so counts below ``least`` are of no use after they are added.
    Products are decimals of 38 digits. No texts or no candidates: no rows. Repeated rows count each time.
    """
    scratch = Scratch(documents.sparkSession, "collocations")
    counts = frequent(documents, least, most, scratch)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def of(name: str, value: str) -> DataFrame:
        return counts.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(value))

    cuts = candidates.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _join_words("w", 1, F.col("k")).alias("left"), _join_words("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"cast(cast({scale} as decimal(9,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0)) as decimal(38,0)) div cast(l * r as decimal(38,0))")
    cuts = cuts.select("lang", "phrase", "a", "k", whole("l").alias("l"), whole("r").alias("r")).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("s"))

    within = candidates.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    within = within.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    within = within.select("lang", _join_words("w", F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < inside * F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "s", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", F.col("s.score").cast("long").alias("score"))
