"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are emitted."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_lists
from .stores import Store, kept
from .vocabulary import WORDS, Vocabulary, byte_path, load, spans, units

#: Bytes of stretches and their counts that a worker keeps from one text to the next.
STORE = 120_000_000


class MergeCounter:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.after_space = vocabulary, Store(STORE)

    def count_word(self, word: bytes) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair is merged again and again, the leftmost first.

        The heap holds rank << 32 | position; links to the next and previous symbol make a linked list. An
        entry counts only if the pair at its position still has that rank.
        """
        rank, made = self.v.rank, self.v.made
        symbols = list(map(self.v.byte_ids.__getitem__, word))
        n = len(symbols)
        heap, i = [], 0
        for a, b in zip(symbols, symbols[1:], strict=False):
            if (r := rank.get(a << 32 | b)) is not None:
                heap.append(r << 32 | i)
            i += 1
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        symbols.append(-1)
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            a, b = symbols[i], symbols[j]
            if a < 0 or b < 0 or rank.get(a << 32 | b) != r:
                continue
            merges += 1
            m = symbols[i] = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(m << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] << 32 | m)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def _stretch(self, text: str) -> int:
        return sum(self.count_word(w.encode()) for w in WORDS.findall(text))

    def count(self, text: str) -> int:
        total = 0
        for special, part in self.v.pieces(text):
            if special is not None:
                total += 1
                continue
            for span in spans(part):
                cut = units(span)
                if cut[0]:
                    total += self._stretch(cut[0])
                del cut[0]
                total += sum(map(self.after_space.ready(set(cut), lambda lack: [self._stretch(" " + u) for u in lack]), cut))
        return total


def count_tokens(documents: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """All columns of ``documents`` but text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes and tokens. A text's special strings count as one token, as is the
    library's default. Rows are independent: null ids, repeated rows and other columns change nothing,
    and columns that clash with the results' names are replaced.
    """
    path = path or byte_path()
    small_batches(documents.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        own = kept(("counts", path), lambda: MergeCounter(load(path)))
        return pa.array([own.count(t) for texts in text_lists(text) for t in texts], pa.int64())

    keep = [c for c in documents.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    return documents.select(
        *keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.arrow_udf(run, "bigint")(F.col("text")).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
