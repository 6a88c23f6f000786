"""The learned operators against plain versions of their arithmetic, and odd labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality, toxicity
from plumbline.llm.common import BATCH_BYTES, labelled, small_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta,", "Gamma", "12", "délta", "x|y", "the", "the"]) + r.choice(["", "s", "."]) for _ in range(n))


def plain_logit(net, words):
    """One window's logit, word by word."""
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    gates = []
    for w in words:
        raw = b"<" + toxicity.normal(w).encode() + b">"
        rows = []
        for n in (3, 4, 5):
            for i in range(len(raw) - n + 1):
                x = n
                for b in raw[i : i + n]:
                    x = ((x ^ b) * 0x100000001B3) % 2**64
                rows.append((x ^ (x >> 29)) % toxicity.BUCKETS)
        own = p["E"][toxicity.BUCKETS + zlib.crc32(raw) % toxicity.BUCKETS]
        gates.append((own + p["E"][rows].mean(axis=0)) @ p["W"] + p["b"])
    states = np.zeros((len(words), 2 * h))
    for d, order in ((0, range(len(words))), (1, range(len(words) - 1, -1, -1))):
        s = np.zeros(h)
        for i in order:
            x, y = gates[i][3 * h * d : 3 * h * (d + 1)], s @ p[f"U{d}"]
            r, z = sigmoid(x[:h] + y[:h]), sigmoid(x[h : 2 * h] + y[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :])
            states[i, d * h : (d + 1) * h] = s
    if not len(words):
        return p["c"][0]
    a = np.tanh(states @ p["Wa"] + p["ba"]) @ p["v"]
    soft = np.exp(a - a.max())
    return (soft / soft.sum()) @ states @ p["w"] + p["c"][0]


def test_scores_equal_a_plain_network(spark):
    net = toxicity.Network.fresh(3)
    net.p["b"] = np.random.default_rng(0).normal(size=net.p["b"].shape).astype(np.float32)
    net.shift = 0.1
    texts = ["", "  ", "one", text(1, 40), text(2, 64), text(3, 65), text(4, 400), None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for r in toxicity.score_documents(df, net).collect():
        w = toxicity.words_of(texts[r.doc_id])
        top = max(plain_logit(net, w[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(w)))
        assert r.score == pytest.approx(1 / (1 + np.exp(net.shift - top)), abs=1e-5)


def corpus(spark, n=300):
    rows = [(i, text(i, 20 + i % 50).upper() if i % 3 == 0 else text(i, 20 + i % 50), "en", "s", 1) for i in range(n)]
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(n)]
    return rows, labels, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_ridge_equals_a_direct_solution(spark):
    rows, labels, df, lf = corpus(spark)
    model = quality.fit(df.repartition(5), lf)
    use = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.statistics(rows[i][1]) for i in use]), np.array([labels[i][1] for i in use])
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-8) and model.scale == pytest.approx(np.where(x.std(axis=0) > 1e-6, x.std(axis=0), 1), abs=1e-8)
    fitted = np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 != 0 for i in use])
    z = np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - model.mean) / model.scale, -8, 8) @ model.omega + model.phase)
    z = np.hstack([z, np.ones((len(z), 1))])[fitted]
    a = z.T @ z
    beta = np.linalg.solve(a + 1e-3 * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), z.T @ y[fitted])
    assert z @ model.beta == pytest.approx(z @ beta, abs=1e-6)
    steps = sorted(zip((z @ beta).tolist(), quality.isotonic(z @ beta, y[fitted].astype(float))[1], strict=False))
    assert steps == sorted(steps, key=lambda s: s[0])
    scores = {r.doc_id: r.score for r in quality.score_documents(df, model).collect()}
    assert all(scores[i] == pytest.approx(float(model.score(np.array([quality.statistics(rows[i][1])]))[0])) for i in range(0, len(rows), 17))


def test_isotonic_equals_the_best_rising_means():
    """Min-max formula of isotonic regression."""
    rng = np.random.default_rng(5)
    s, y = rng.normal(size=30), rng.integers(0, 2, 30).astype(float)
    y_in = y[np.argsort(s)]
    mean = lambda i, j: y_in[i : j + 1].mean()
    best = np.array([max(min(mean(i, j) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)])
    xs, vs = quality.isotonic(s, y)
    at = np.interp(np.sort(s), xs, vs)
    groups = np.split(at, np.flatnonzero(np.diff(best) > 1e-12) + 1)
    assert all(np.ptp(g) < 1e-9 for g in groups) and (np.diff(at) >= -1e-12).all()


def test_statistics_of_a_text():
    got = quality.statistics("One two, two\n123 |")
    assert got[0] == pytest.approx(np.log1p(5) / 10) and got[1] == pytest.approx((3 + 4 + 3 + 3 + 1) / 5 / 10)
    assert got[13:15] == pytest.approx([1 / 18, 8 / 18]) and len(got) == quality.N_STATS == len(quality.statistics(None))


def test_odd_labels(spark):
    rows, labels, df, lf = corpus(spark, 120)
    again = spark.createDataFrame([(5, "repeated " + str(i), "en", "s", 1) for i in range(500)] + [(None, "no id", None, None, None), (7, None, None, None, None)], SCHEMA)
    more = lf.unionByName(spark.createDataFrame([(5, 1, None), (5, 0, None), (None, 1, 1), (9, None, None), (11, 7, 7), (999, 1, 1)], LABELS))
    drawn = labelled(df.unionByName(again), more, "quality", 10).collect()
    assert len(drawn) <= 20 and len({r.doc_id for r in drawn}) == len(drawn) and all(r.y in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 for r in drawn)
    both = df.unionByName(again)
    assert quality.fit(both, more) is not None and toxicity.fit(both, more, per_class=15) is not None
    odd = quality.score_documents(both.withColumn("predicted", F.lit("x")), quality.fit(both, more)).where("doc_id is null or text is null").collect()
    assert len(odd) == 2 and not [r for r in odd if r.doc_id is None][0].held_out


def test_training_sample_is_bounded_by_words(spark, monkeypatch):
    rows, labels, df, lf = corpus(spark, 120)
    monkeypatch.setattr(toxicity, "MOST_WORDS", 1600)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, prior: seen.extend(rows))
    long = spark.createDataFrame([(2, text(1, 5000), "en", "s", 1)], SCHEMA)
    toxicity.fit(df.where("doc_id != 2").unionByName(long), lf)
    of = {}
    for d, words, y in seen:
        of.setdefault(d, []).append(words)
    assert of and 2 not in of and sum(len(rows[d][1].split()) for d in of) <= 1600
    assert all(len(w) == len(toxicity.window_starts(len(rows[d][1].split()))) for d, w in of.items())


def test_batches_are_bounded_unless_the_user_says_so(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    small_batches(spark)
    assert spark.conf.get(name) == str(BATCH_BYTES)
    spark.conf.set(name, "1m")
    small_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_long_labelled_texts_are_learned_from(spark):
    """A document of any length is drawn; of a very long one so many windows that they come to its share of words."""
    assert toxicity.drawn_windows(1, 20) == [(0, 0)]
    few = toxicity.drawn_windows(7, 1_000_000)
    assert len(few) == toxicity.MOST_WORDS // 8 // toxicity.STRIDE and few == sorted(few) and few == toxicity.drawn_windows(7, 1_000_000)
    assert few[-1][0] > 15_000 and {s for _, s in few} <= set(toxicity.window_starts(1_000_000))
    docs = spark.createDataFrame([(1, "bad words here " * 60_000), (2, "nice words there"), (3, "nice again"), (4, "bad again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels) is not None  # the only toxic one is very long
