"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least k-gram hash of each window of ``window`` words: whoever shares a whole window shares its
fingerprint, so no shared window is missed. Documents' and items' fingerprints are joined, and each hit is extended from its
k-gram to the window around it: the words must agree, so what is returned is exact whatever the hashes do.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a window and of a k-gram; a window holds WINDOW - KGRAM + 1 k-grams.
WINDOW, KGRAM = 10, 5
#: Bits of the map that spares fingerprints which no item has the shuffle: at most BITS / 64 rows of 16 bytes are broadcast. A full
#: map spares none and loses none.
BITS = 1 << 24
#: Fixed value: what separates words, once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null. Only A-Z are put in lower case."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS, -1), "")


def _each(n: Column, f) -> Column:
    """f(i) for i from 1 to n; none if n is below 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), f)).otherwise(F.transform(F.slice(F.array(F.lit(1)), 1, 0), f))


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """Distinct (item_id, win, len, fp): an item's windows as words joined by a space. An item of fewer words, but not none, is one
    window, and its fingerprint is its own hash."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.select("item_id", F.explode(_each(F.greatest(F.size("w") - window + 1, F.lit(1)), lambda i: F.slice("w", i, window))).alias("w"))
    least = F.array_min(_each(F.lit(window - k + 1), lambda i: F.xxhash64(F.slice("w", i, k))))
    fp = F.when(F.size("w") == window, least).otherwise(F.xxhash64("w"))
    return w.select("item_id", F.concat_ws(" ", "w").alias("win"), F.size("w").alias("len"), fp.alias("fp")).distinct()


def _bitmap(named: DataFrame) -> DataFrame:
    """(_word, _bits) of the items' fingerprints: at most BITS / 64 rows."""
    spot = F.col("fp").bitwiseAND(F.lit(BITS - 1))
    rows = named.select(F.floor(spot / 64).cast("long").alias("_word"), (spot % 64).cast("int").alias("b")).distinct()
    return rows.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("_bits"))


def _scan(documents: DataFrame, named: DataFrame, lens: list[int], window: int, k: int) -> DataFrame:
    """One pass over the texts. For each row one (row, doc_id, n_words, pos 0) and one (row, pos, len, fp, win) for each window
    whose fingerprint may be an item's."""
    docs = documents.select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    docs = docs.withColumn("grams", _each(F.when(F.col("n") >= window, F.col("n") - k + 1).otherwise(0) if window in lens else F.lit(0), lambda i: F.xxhash64(F.slice("w", i, k))))

    def prints(m: int) -> Column:
        return _each(F.col("n") - m + 1, (lambda i: F.array_min(F.slice("grams", i, window - k + 1))) if m == window else (lambda i: F.xxhash64(F.slice("w", i, m))))

    # A plain array of hashes in a column of its own: the explosion then runs in generated code, which copies no words. Outer, as
    # a filter on the array's size would be inferred else, and its expressions repeated there.
    docs = docs.select("row", "doc_id", "n", "w", F.concat(F.array(F.lit(0).cast("long")), *map(prints, lens)).alias("fps"))
    rows = docs.select("row", "doc_id", "n", "w", F.posexplode_outer("fps").alias("at", "fp"))
    pos, length, before = F.lit(0), F.lit(0), F.lit(0)
    for m in lens:  # windows of one length follow those of another
        pos, length = F.when(F.col("at") > before, F.col("at") - before).otherwise(pos), F.when(F.col("at") > before, m).otherwise(length)
        before = before + F.greatest(F.col("n") - m + 1, F.lit(0))
    spot = F.col("fp").bitwiseAND(F.lit(BITS - 1))
    rows = rows.withColumn("_at", F.when(F.col("at") > 0, F.shiftright(spot, 6))).join(F.broadcast(_bitmap(named)), F.col("_at") == F.col("_word"), "left")
    rows = rows.where((F.col("at") == 0) | (F.getbit("_bits", (spot % 64).cast("int")) == 1)).withColumn("pos", pos).withColumn("len", length)
    first = F.col("pos") == 0
    return rows.select(
        "row", "pos", "len", "fp", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n").cast("long")).alias("n_words"), F.when(~first, F.concat_ws(" ", F.slice("w", F.greatest("pos", F.lit(1)), F.col("len")))).alias("win")
    )


def hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, n_words long, spans array<struct<start, end>> (ranges of words, from
    1, the end inclusive, that lie inside an occurrence of an item's window, runs joined), items array<string> (ids with an
    occurring window, sorted as strings).

    Null and empty texts have no words; repeated rows and null doc_ids are rows of their own; rows of an item_id are one item;
    a null item_id is in no list, but its windows occur. Other columns change nothing. Windows are taken by the words' characters,
    so hash collisions only add candidates. What one task groups is a single document's hits.
    """
    if not 0 < k <= window:
        raise ValueError("a k-gram has from 1 to window words")
    scratch = Scratch(documents.sparkSession, "decontaminate")
    named = scratch.keep(item_windows(items, window, k), "windows")
    lens = sorted(r["len"] for r in named.select("len").distinct().collect())  # at most ``window`` numbers
    found = scratch.keep(_scan(documents, named, lens, window, k), "found")
    met = found.where("pos > 0").select("row", "pos", "len", "fp", "win").join(named.select("fp", "win", "item_id"), ["fp", "win"])
    met = met.groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))))
    met = met.select("row", "items", hit.alias("hit"))
    starts, ends = F.array_except("hit", F.transform("hit", lambda x: x + 1)), F.array_except("hit", F.transform("hit", lambda x: x - 1))
    met = met.select("row", "items", F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("spans"))
    none = {"spans": "cast(array() as array<struct<start:int,end:int>>)", "items": "cast(array() as array<string>)"}
    rows = found.where("pos = 0").select("row", "doc_id", "n_words").join(met, "row", "left")
    return rows.select("doc_id", "n_words", *(F.coalesce(c, F.expr(e)).alias(c) for c, e in none.items()))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans of hit words as start-end, comma-joined."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1)
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), shown.alias("spans")
    )
