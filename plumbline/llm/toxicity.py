"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of two learned embeddings: that of the word, and the mean of its characters' runs (three to
five bytes, with marks at the word's ends). Gates run over a window of words in both directions; attention
weighs the states and a linear layer scores the window. A text's score is that of its highest window; windows overlap
and cover the whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, labelled, small_batches
from .stores import kept

#: Bounds of the training sample: documents of each class, and words of them all; a document takes an eighth of the words at most.
PER_CLASS, MOST_WORDS = 1500, 1_200_000
WINDOW, STRIDE = 64, 48
DIM, HIDDEN, ATTEND = 16, 12, 12
BUCKETS = 1 << 14
#: Words whose gate inputs a worker keeps, and windows that it runs at a time.
STORE, SLAB = 250_000, 2048
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def char_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word's own embedding, rows of its character runs one word after the other, their number)."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    own = np.array([BUCKETS + zlib.crc32(b) % BUCKETS for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(b) for b in raw], np.int64)
    word, end = np.repeat(np.arange(len(raw)), sizes), np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    rows, whose = [], []
    for n in (3, 4, 5):
        fits = at[at + n <= end]
        h = np.full(len(fits), n, np.uint64)
        for i in range(n):
            h = (h ^ data[fits + i]) * np.uint64(0x100000001B3)
        rows.append(((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(word[fits])
    rows, whose = np.concatenate(rows), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return own, rows[order], np.bincount(whose, minlength=len(raw))


def _segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; every count is at least 1."""
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def normal(word: str) -> str:
    return word.strip(_TRIM) or word[:1]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover ``n`` words; one window for none."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": (rng.normal(size=(2 * BUCKETS, DIM)) * 0.1).astype(np.float32), "W": draw(DIM, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32)}
        p |= {f"U{d}": draw(HIDDEN, 3 * HIDDEN) for d in (0, 1)}
        p |= {"Wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        return Network(p)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Each word's input vector."""
        own, rows, counts = char_runs(words)
        return self.p["E"][own] + _segment_sum(self.p["E"][rows], counts) / counts[:, None].astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["W"] + self.p["b"]

    def forward(self, g: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at`` (windows, WINDOW) points into the gate inputs ``g``, ``mask`` is 0 beyond a window's words."""
        n, t = at.shape
        states = np.empty((t, n, 2 * HIDDEN), np.float32)
        saved = []
        for d in (0, 1):
            u, h = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            part = g[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                x, y = part[at[:, i]], h @ u
                rz = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])))
                r, z, yn = rz[:, :HIDDEN], rz[:, HIDDEN:], y[:, 2 * HIDDEN :]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * yn)
                if keep is not None:
                    saved.append((d, i, h, r, z, new, yn))
                h = h + mask[:, i : i + 1] * (1 - z) * (new - h)
                states[i, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        s = np.where(mask.T > 0, a @ self.p["v"], np.float32(-1e4))
        e = np.exp(s - s.max(axis=0)) * mask.T
        soft = e / np.maximum(e.sum(axis=0), 1e-9)
        c = np.einsum("tn,tnh->nh", soft, states)
        if keep is not None:
            keep.update(states=states, a=a, soft=soft, c=c, saved=saved)
        return c @ self.p["w"] + self.p["c"][0]

    def backward(self, dlogit: np.ndarray, g: np.ndarray, x: np.ndarray, at: np.ndarray, mask: np.ndarray, k: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the words' input vectors."""
        p, states, soft = self.p, k["states"], k["soft"]
        grad = {"w": k["c"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dc = dlogit[:, None] * p["w"]
        da = np.einsum("nh,tnh->tn", dc, states)
        ds = soft * (da - (soft * da).sum(axis=0))
        dh_all = soft[:, :, None] * dc[None]
        grad["v"] = np.einsum("tn,tnk->k", ds, k["a"])
        dpre = ds[:, :, None] * p["v"] * (1 - k["a"] ** 2)
        grad["Wa"], grad["ba"] = np.einsum("tnh,tnk->hk", states, dpre, optimize=True), dpre.sum(axis=(0, 1))
        dh_all = dh_all + dpre @ p["Wa"].T
        dg = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
        for d in (0, 1):
            u, du, dh = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(at), HIDDEN), np.float32)
            for way, i, h, r, z, new, yn in reversed(k["saved"]):
                if way != d:
                    continue
                dh = dh + dh_all[i, :, d * HIDDEN : (d + 1) * HIDDEN]
                out = dh * mask[:, i : i + 1]
                dn = out * (1 - z) * (1 - new**2)
                dr, dz = dn * yn * r * (1 - r), out * (h - new) * z * (1 - z)
                dy = np.concatenate([dr, dz, dn * r], axis=1)
                du += h.T @ dy
                dh = dh - out * (1 - z) + dy @ u.T
                dg[:, i, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = np.concatenate([dr, dz, dn], axis=1)
            grad[f"U{d}"] = du
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        dwords = np.zeros_like(g)
        dwords[seen] = np.add.reduceat(dg.reshape(len(flat), -1)[order], first, axis=0)
        grad["W"], grad["b"] = x.T @ dwords, dwords.sum(axis=0)
        return grad, dwords @ p["W"].T


def _pool(logits: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' logits as the log of their windows' mean odds, and each window's share in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, logits)
    e = np.exp(logits - top[doc])
    total = np.bincount(doc, e, n)
    return top + np.log(total / np.bincount(doc, minlength=n)), e / total[doc]


def train(rows: list[tuple[int, list[str], int]], prior: float, epochs: int = 8, batch: int = 40, rate: float = 4e-3, seed: int = 1) -> Network:
    """Train on (document, words of a window, label) rows. A document's label is held against its windows together, since the
    words that earned it may stand in few of them. A fifth of the documents sets the shift of the logits, at ``prior``."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    docs: dict[int, list[list[str]]] = {}
    y_of: dict[int, int] = {}
    for d, w, y in rows:
        docs.setdefault(d, []).append([normal(x) for x in w])
        y_of[d] = y
    table: dict[str, int] = {}
    coded = {d: [np.array([table.setdefault(w, len(table)) for w in ws], np.int64) for ws in wins] for d, wins in docs.items()}
    own, runs, counts = char_runs(list(table)) if table else (np.empty(0, np.int64),) * 3
    ends = np.cumsum(counts)
    kept = [d for d in sorted(docs) if zlib.crc32(f"shift {d}".encode()) % 5]
    apart = [d for d in sorted(docs) if not zlib.crc32(f"shift {d}".encode()) % 5]

    def windows(ids: list[int]):
        wins = [(i, w) for i, d in enumerate(ids) for w in coded[d]]
        at, mask = np.zeros((len(wins), WINDOW), np.int64), np.zeros((len(wins), WINDOW), np.float32)
        for j, (_, w) in enumerate(wins):
            at[j, : len(w)], mask[j, : len(w)] = w, 1
        used, inverse = np.unique(at, return_inverse=True)
        return used, inverse.reshape(at.shape), mask, np.array([i for i, _ in wins])

    def rows_of(used: np.ndarray):
        n = counts[used]
        start = np.repeat(ends[used] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r = runs[start]
        return r, n, net.p["E"][own[used]] + _segment_sum(net.p["E"][r], n) / n[:, None].astype(np.float32)

    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, min(40, 8000 // max(1, len(kept)))) if kept else 0
    for epoch in range(epochs):
        ids = [kept[i] for i in rng.permutation(len(kept))]
        for lo in range(0, len(ids), batch):
            part = ids[lo : lo + batch]
            used, at, mask, doc = windows(part)
            r, n, x = rows_of(used)
            g, keep = net.gates(x), {}
            logits = net.forward(g, at, mask, keep).astype(np.float64)
            y = np.array([y_of[d] for d in part], float)
            if epoch == 0:  # every window carries its document's label at first
                dl = (1 / (1 + np.exp(-logits)) - y[doc]) / np.bincount(doc)[doc] / len(part)
            else:
                z, share = _pool(logits, doc, len(part))
                dl = (1 / (1 + np.exp(-z)) - y)[doc] * share / len(part)
            grad, dx = net.backward(dl.astype(np.float32), g, x, at, mask, keep)
            de = np.zeros_like(net.p["E"])
            np.add.at(de, own[used], dx)
            spread = np.repeat(dx / n[:, None].astype(np.float32), n, axis=0)
            for j in range(DIM):
                de[:, j] += np.bincount(r, spread[:, j], len(de))
            grad["E"] = de
            step += 1
            pace = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
            for k, v in net.p.items():
                m, s = state[k]
                m += 0.1 * (grad[k] - m)
                s += 0.01 * (grad[k] ** 2 - s)
                v -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    test = apart if len({y_of[d] for d in apart}) == 2 else kept
    tops, ys = [], []
    for lo in range(0, len(test), 200):
        part = test[lo : lo + 200]
        used, at, mask, doc = windows(part)
        logits = net.forward(net.gates(rows_of(used)[2]), at, mask)
        top = np.full(len(part), -np.inf)
        np.maximum.at(top, doc, logits)
        tops += top.tolist()
        ys += [y_of[d] for d in part]
    tops, ys = np.array(tops), np.array(ys)
    if len(set(ys.tolist())) == 2:  # the middle of the widest of the best cuts, weighted to the classes' true rates
        weight = np.where(ys == 1, prior / (ys == 1).mean(), (1 - prior) / (ys == 0).mean())
        edges = np.unique(tops)
        cuts = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
        gaps = np.concatenate([[0], np.diff(edges), [0]])
        errors = np.array([weight[(tops >= c) != (ys == 1)].sum() for c in cuts])
        best = np.flatnonzero(errors <= errors.min() + 1e-9)
        net.shift = float(cuts[best[np.argmax(gaps[best])]])
    return net


class Scorer:
    """Scores whole texts; a worker keeps the gate inputs of words that it has met."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _learn(self, fresh: set[str]) -> None:
        known, new = self.index, {}
        base = len(self.table)
        for token in sorted(fresh):
            word = normal(token)
            known[token] = base + new.setdefault(word, len(new))
        self.table = np.concatenate([self.table, self.net.gates(self.net.inputs(list(new)))])

    def score(self, texts: list[str]) -> np.ndarray:
        out, part, size = [], [], 0
        for t in texts:
            part.append(words_of(t))
            size += len(part[-1])
            if size > 400_000:
                out.append(self._score(part))
                part, size = [], 0
        return np.concatenate([*out, self._score(part)]) if part else np.concatenate(out) if out else np.empty(0)

    def _score(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.index) > STORE:
            self.index, self.table = {}, self.table[:0]
        fresh = set().union(*docs).difference(self.index)
        if fresh:
            self._learn(fresh)
        look = self.index.__getitem__
        codes = [np.fromiter(map(look, d), np.int64, len(d)) for d in docs]
        begins = np.cumsum([0, *map(len, codes)])
        flat = np.concatenate([*codes, np.zeros(WINDOW, np.int64)])
        starts = [window_starts(len(c)) for c in codes]
        doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        start = np.concatenate([np.array(s) for s in starts])
        left = np.array([len(c) for c in codes])[doc] - start
        order = np.argsort(-np.minimum(left, WINDOW), kind="stable")
        table = self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), np.float32)
        top = np.full(len(docs), -np.inf)
        for lo in range(0, len(order), SLAB):
            w = order[lo : lo + SLAB]
            span = int(max(1, min(WINDOW, left[w[0]])))
            cols = np.arange(span)
            mask = (cols[None, :] < left[w][:, None]).astype(np.float32)
            at = np.where(mask > 0, flat[np.minimum((begins[doc[w]] + start[w])[:, None] + cols, len(flat) - 1)], 0)
            np.maximum.at(top, doc[w], self.net.forward(table, at, mask))
        return 1 / (1 + np.exp(-np.clip(top - self.net.shift, -50, 50)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network | None:
    """Train on a bounded sample of labelled documents outside the held-out fold; None without both classes.

    At most ``per_class`` documents of each class are drawn, in an order by hash, and of them as many as come to half of
    MOST_WORDS words. Windows of a drawn document are learned from, whatever its length: all of them, or, of a document of more than
    an eighth of MOST_WORDS words, as many as come to that, in an order by hash. Of several texts of an id one is taken, and of
    several labels the largest.
    """
    small_batches(documents.sparkSession)
    rates = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(rates) < 2:
        return None

    def cut(batches):
        for b in batches:
            for i in range(0, len(b), 100):
                some = b.iloc[i : i + 100]
                texts = ((d, words_of(t), y) for d, t, y in zip(some["doc_id"], some["text"], some["y"], strict=True))
                out = [(d, j, " ".join(words[s : s + WINDOW]), y) for d, words, y in texts for j, s in drawn_windows(d, len(words))]
                yield pd.DataFrame(out, columns=["doc_id", "j", "words", "y"])

    sized = labelled(documents, labels, label, per_class).withColumn("n", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)))
    turn = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # per_class rows at most
    counted = sized.withColumn("n", F.least("n", F.lit(MOST_WORDS // 8)))
    drawn = counted.withColumn("so_far", F.sum("n").over(turn)).where(F.col("so_far") <= MOST_WORDS // 2)
    rows = drawn.select("doc_id", "text", "y").mapInPandas(cut, "doc_id bigint, j int, words string, y int").collect()
    rows = [(r["doc_id"], r["words"].split(), r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["j"], r["words"]))]
    rows = [r for r in rows if r[1]]
    return train(rows, rates[1] / sum(rates.values())) if len({r[2] for r in rows}) == 2 else None


def drawn_windows(doc_id: int, n: int, most: int = MOST_WORDS // 8 // STRIDE) -> list[tuple[int, int]]:
    """(number, start) of the windows of a document of ``n`` words that are learned from: all, or ``most`` in an order by hash."""
    every = list(enumerate(window_starts(n)))
    if len(every) <= most:
        return every
    return sorted(sorted(every, key=lambda w: (zlib.crc32(f"{doc_id}:{w[0]}".encode()), w[0]))[:most])


def score_documents(documents: DataFrame, net: Network | None, threshold: float = 0.5) -> DataFrame:
    """All columns of ``documents`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Null texts score as empty ones, which have one window without words. Without a network (no labels of both classes)
    every score is 0. Null ids are never held out. Repeated rows score alike; clashing columns are replaced.
    """
    small_batches(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(net)
    mark = 0 if net is None else zlib.crc32(net.p["E"].tobytes())

    def run(text: pd.Series) -> pd.Series:
        if shipped.value is None:
            return pd.Series(np.zeros(len(text)))
        own = kept(("toxicity", mark), lambda: Scorer(shipped.value))
        return pd.Series(own.score(text.fillna("").tolist()), dtype="float64")

    keep = [c for c in documents.columns if c not in ("held_out", "score", "predicted")]
    scored = documents.select(*keep, held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(run, "double")(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
