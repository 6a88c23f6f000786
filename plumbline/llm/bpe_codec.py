"""BPE encoding by traversal of a trie of distinct words, and decoding.

A batch's distinct words go into a trie of bytes. A depth-first walk gives every node its last-token
state: the last token of the encoding of the prefix that ends there. It is the one token t, ending at the
node, whose left neighbour (the state of the node len(t) bytes above) and t stay apart when their bytes are
merged by rank. Words that share a prefix share its states, so each prefix is encoded once; a word's
encoding is read off by stepping back from its end through the states.
"""

from __future__ import annotations

import hashlib
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_lists
from .stores import Store, kept
from .vocabulary import WORDS, Vocabulary, byte_path, chunks, load, spans, units

#: Bytes of stretches and their ids that a worker keeps from one batch to the next; pairs of tokens that it remembers.
STORE, PAIRS = 100_000_000, 200_000
SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.apart = vocabulary, {}
        self.whole: dict[int, int | None] = {}
        self.tokens = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            self.tokens.add_word(piece.decode("latin-1"), (i, len(piece)))
        self.tokens.make_automaton()
        self.edges: tuple[dict, dict] = {}, {}
        self.after_space, self.alone = Store(STORE), Store(STORE // 8)

    def _edge(self, token: int, right: int) -> tuple[list[int], list[float]]:
        """What stands at a token's edge while it is merged: bottom-up symbols, and the rank at which each is replaced."""
        if token not in self.edges[right]:
            symbols, ranks, t = [token], [float("inf")], token
            while t in self.v.split:
                *parts, r = self.v.split[t]
                t = parts[right]
                symbols.append(t)
                ranks.append(r)
            self.edges[right][token] = symbols[::-1], ranks[::-1]
        return self.edges[right][token]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b: at no time is the pair at their border due before both edges' own merges."""
        left, ends = self._edge(a, 1)
        right, begins = self._edge(b, 0)
        i = j = 0
        while True:
            cross = self.v.rank.get(left[i] << 32 | right[j])
            if cross is not None and cross < ends[i] and cross <= begins[j]:
                ok = False
                break
            if ends[i] == begins[j] == float("inf"):
                ok = True
                break
            if ends[i] <= begins[j]:
                i += 1
            else:
                j += 1
        self.apart[a << 32 | b] = ok
        return ok

    def _token(self, i: int) -> int | None:
        """The token, if its bytes merge to it."""
        ids = [self.v.byte_ids[x] for x in self.v.bytes_of[i]]
        while len(ids) > 1:
            r, at = min((self.v.rank.get(x << 32 | y, 1 << 60), n) for n, (x, y) in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 60:
                break
            ids[at : at + 2] = [self.v.made[r]]
        self.whole[i] = i if ids == [i] else None
        return self.whole[i]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Sorted order visits the trie depth first: the stack holds the path's states.

        The tokens that end at a node come from an automaton over the vocabulary, the longest first.
        """
        out: list = [None] * len(words)
        path, states = b"", []
        whole, apart, ends = self.whole, self.apart, self.tokens.iter
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared:]
            done = shared
            for last, (piece, n) in ends(word.decode("latin-1")):
                if last < done:  # the state of this node is known
                    continue
                token = whole[piece] if piece in whole else self._token(piece)
                if token is None:
                    continue
                if n <= last:
                    left = states[last - n]
                    ok = apart.get(left << 32 | token)
                    if not (self._stay_apart(left, token) if ok is None else ok):
                        continue
                states.append(token)
                done += 1
            path = word
            got, end = [], len(word)
            while end:
                t = states[end - 1]
                got.append(t)
                end -= len(self.v.bytes_of[t])
            out[at] = got[::-1]
        return out

    def _learn(self, fresh: list[str], space: str) -> list[bytes]:
        """The ids of stretches; of their words, those that are no known stretch go through the trie."""
        known, old = self.after_space.young, self.after_space.old
        done: dict[str, bytes | None] = {}
        split = [WORDS.findall(space + u) for u in fresh]
        for parts in split:
            for w in parts:
                if w not in done:
                    done[w] = known.get(w[1:]) or old.get(w[1:]) if w[0] == " " else None
        new = [w for w, got in done.items() if got is None]
        done.update(zip(new, (array("I", ids).tobytes() for ids in self.encode_words([w.encode() for w in new])), strict=True))
        return [done[parts[0]] if len(parts) == 1 else b"".join([done[w] for w in parts]) for parts in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Long texts are taken part by part."""
        out = []
        for part in chunks(texts):
            if len(part) > 1:
                out += self._encode(part)
            else:
                pieces = [x for special, p in self.v.pieces(part[0]) for x in ([special] if special is not None else spans(p))]
                out.append(b"".join(i for x in pieces for i in self._encode([x])))
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.apart) > PAIRS:
            self.apart.clear()
        plans, inner, alone = [], set(), set()
        for text in texts:
            plan = []
            for special, part in self.v.pieces(text):
                if special is not None:
                    plan.append(array("I", [self.v.special[special]]).tobytes())
                else:
                    plan.append(units(part))
                    alone.add(plan[-1][0])
                    inner.update(plan[-1][1:])
            plans.append(plan)
        first = self.alone.ready(alone, lambda u: self._learn(u, ""))
        later = self.after_space.ready(inner, lambda u: self._learn(u, " "))
        return [b"".join([x if x.__class__ is bytes else first(x[0]) + b"".join(map(later, x[1:])) for x in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


def encoder(path: str) -> TrieEncoder:
    """A worker's encoder; it is kept from task to task."""
    return kept(("codec", path), lambda: TrieEncoder(load(path)))


def encode_table(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """All columns of ``documents`` but text, with n_tokens, ids_sha256 (ids as little-endian 32-bit) and decoded_sha256.

    ``with_ids`` adds ids array<int> and decoded string. A null text counts as empty: no ids. Rows are independent, so null
    ids, repeated rows and other columns change nothing; columns that clash with the results' names are
    replaced. A map without shuffle: a lost task is simply run again.
    """
    path = path or byte_path()
    small_batches(documents.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        own = encoder(path)
        out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
        for texts in text_lists(text):
            for ids in own.encode(texts):
                decoded = own.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    out["ids"].append(list(array("I", ids)))
                    out["decoded"].append(decoded)
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.StructArray.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], list(out))

    kind = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    made = [x.split()[0] for x in kind.split(", ")]
    keep = [c for c in documents.columns if c not in ("text", *made)]
    got = F.arrow_udf(run, kind)(F.col("text"))
    return documents.select(*keep, got.alias("_e")).select(*keep, "_e.*")
