"""Conversation repair, collocations and decontamination against brute-force versions, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import collocations, conversations, decontaminate

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string, seg string, at string"


# 11 conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3].encode()))


def plain_repair(rows):
    """Dynamic programming over (place, grammar state) with whole audits; rows of one conversation after damage, in order."""
    seen, marks, count = set(), [], collections.Counter()
    for _, _, role, text in rows:
        held = re.search(r"[^\x20\x09-\x0D]", text)
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
        count[fault] += 1
    step, roles = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, {"u": "user", "a": "assistant"}

    def ways(i, s, rest):
        """(cost, audit, lines) of what may stand at place i in state s, given rest(i, s)."""
        if i == len(rows):
            if s in (0, 3):
                yield 0, "", ()
        else:
            _, _, role, text = rows[i]
            c, a, ls = rest(i + 1, s)
            yield c + 2, "D" + a, ls
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                if (s, role[:1]) in step:
                    c, a, ls = rest(i + 1, step[s, role[:1]])
                    yield c + more, "K" + a, (f"{role}:{text}", *ls)
                for u in "ua":
                    if (s, u) in step:
                        c, a, ls = rest(i + 1, step[s, u])
                        yield c + 1 + more, "R" + a, (f"{roles[u]}:{text}", *ls)

    best = {}
    for i in range(len(rows), -1, -1):
        now = {s: min(ways(i, s, lambda j, t: best[j, t]), default=(10**9, "", ())) for s in range(4)}
        for _ in range(3):  # insertions
            for s in range(4):
                for u in "ua":
                    if (s, u) in step:
                        c, a, ls = now[step[s, u]]
                        now[s] = min(now[s], (c + 5, "I" + a, (f"{roles[u]}:", *ls)))
        best |= {(i, s): x for s, x in now.items()}
    cost, audit, lines = best[0, 0]
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_turns(seed):
    r, out = random.Random(seed), []
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why?", None, "é　.", "a.b", "end. \n", "x" * 50_000 + "."]
    for conv in [None, *range(1, 60)]:
        for turn in range(r.choice([0, 1, 2, 5, 9, 14]) + (700 if conv == 7 else 0)):
            text = r.choice(texts) if r.random() < 0.3 else f"line {r.randrange(10**6)}" + r.choice([".", "?", ""])
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[turn % 2] if turn or r.random() < 0.5 else "system"
            out.append((conv, None if r.random() < 0.05 else turn, r.choice([role] * 20 + [None, "", "tool", "u", "System"]), text))
    return out + [(99, 5, "user", "same.")] * 40 + [(98, None, None, None)] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain_programming(spark, seed):
    rows = random_turns(seed)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    by = collections.defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    want = {c: plain_repair(by[c]) for c in {r[0] for r in rows}}
    got = conversations.digest(df, conversations.repair(conversations.damage(df))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(len(w[6]) > 600 for w in want.values()) and any("R" in w[6] for w in want.values())


def test_repaired_rows_follow_the_grammar(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in random_turns(3)], TURNS)
    by = collections.defaultdict(list)
    for r in conversations.repaired(conversations.repair(df)).collect():
        by[r.conv_id].append(r)
    for rows in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in sorted(rows, key=lambda r: (r.seg, r.no))))


@pytest.mark.parametrize("seed", range(4))
def test_segments_fold_to_the_whole(seed):
    r = random.Random(seed)
    codes = "".join(r.choice("suauauaSUAox") for _ in range(60))
    whole, _ = conversations.segment_costs(codes), None
    a, b = conversations.segment_costs(codes[:23]), conversations.segment_costs(codes[23:])
    far = 10**9
    cost = lambda m, s, e: m[4 * s + e] if m[4 * s + e] >= 0 else far
    for s in range(4):
        for e in range(4):
            assert min(cost(a, s, k) + cost(b, k, e) for k in range(4)) % far == cost(whole, s, e) % far or cost(whole, s, e) == far


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.digest(none, conversations.repair(conversations.damage(none))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.", "", "")], TURNS)
    got = conversations.digest(one, conversations.repair(conversations.damage(one))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# 12 collocations


def plain_collocations(docs, least, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n, found = sum(v for k, v in c.items() if len(k) == 1), []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                if any(len(q) > len(p) and b >= least and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items()):
                    continue
                score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts_with_phrases(seed):
    r = random.Random(seed)
    vocabulary = ["alpha", "BETA", "gamma", "é", "Éa", "x\x00y", "delta", "the", "-", "a"]
    docs = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t", "  ", ". ", "\n", ":"]) for _ in range(r.randrange(60)))) for _ in range(80)]
    return docs + [("en", ""), ("en", None), ("de", "a " * 300), ("fr", "only once"), ("en", "!?.,")]


@pytest.mark.parametrize("shard", [1 << 19, 37])
def test_collocations_equal_plain_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    docs = texts_with_phrases(5)
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(docs)], DOCS).repartition(3)
    for least, top in ((10, 2000), (3, 7)):
        assert sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top).collect()) == plain_collocations(docs, least, top)
    if shard == 37:  # the workers read the module's own value; so hold a cut shard against the whole here
        a = np.array([1, 2, 1, 2, 0, 3, 1, 2, 1] * 20)
        whole = collections.Counter(tuple(a[i : i + n]) for n in (1, 2, 3) for i in range(len(a) - n + 1) if all(a[i : i + n]))
        cut = collections.Counter()
        for lo in range(0, len(a), 37):
            part = a[lo : lo + 39]
            for n, (at, count) in enumerate(collocations.lcp_intervals(part, 3, min(37, len(part))), 1):
                for i, f in zip(at, count, strict=True):
                    cut[tuple(part[i : i + n])] += f
        assert cut == whole


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_sorts_suffixes(seed):
    a = np.random.default_rng(seed).integers(0, 4, 200)
    got = collocations.suffix_array(a, len(a))
    assert got.tolist() == sorted(range(200), key=lambda i: a[i:].tolist())
    assert collocations.suffix_array(np.empty(0, np.int64), 3).tolist() == []


def test_large_counts_stay_exact(spark):
    rows = [("x", "p q", 2, 10**12 + 7), ("x", "p", 1, 10**12 + 9), ("x", "q", 1, 10**12 + 11), ("x", "", 0, 3 * 10**12)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint")
    real, collocations.frequent = collocations.frequent, lambda *a: counts
    try:
        (got,) = collocations.collocations(counts).collect()
    finally:
        collocations.frequent = real
    a, left, right = 10**12 + 7, 10**12 + 9, 10**12 + 11
    assert (got.a, got.l, got.r, got.score) == (a, left, right, 10**6 * a * a // (left * right))


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


# 13 decontamination


def plain_hits(docs, items, m=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    named = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - m + 1, 1) if w else 0):
            named[tuple(w[i : i + m])].add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in {len(k) for k in named}:
            for i in range(len(w) - n + 1):
                if got := named.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= got
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def shared_passages(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Ab", "cd", "ÉF", "g1", "h", "日本"])
    line = lambda n: r.choice([" ", "-", "\n", ", "]).join(word() for _ in range(n))
    items = [(i, line(r.choice([10, 11, 25, 40]))) for i in range(12)] + [(20, line(4) + " rare1"), (21, "zz yy"), (22, ""), (23, None), (None, line(14)), (3, line(15)), (30, "same " * 40), (31, "same " * 12)]
    docs = [(i, line(r.randrange(30)) + " " + (r.choice(items)[1] or "")[: r.choice([20, 60, 400])] + " " + line(r.randrange(30))) for i in range(80)]
    return docs + [(1, ""), (2, None), (None, items[0][1]), (5, "ZZ yy"), (5, "ZZ yy"), (6, "same " * 5000), (7, line(20_000) + " " + items[2][1])], items


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_equals_plain_search(spark, seed):
    docs, items = shared_passages(seed)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.hits(df, bench)).drop("spans").collect()
    want = plain_hits(docs, items)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert 5 < sum(w[-1] for w in want) < len(want)


def test_decontamination_without_items_or_documents(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 0), (None, None, None, None, None)], DOCS)
    none, bench = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert sorted((tuple(r)[:4] for r in decontaminate.digest(decontaminate.hits(df, none)).collect()), key=repr) == [(1, 3, 0, 0), (None, 0, 0, 0)]
    assert decontaminate.hits(df.limit(0), bench).collect() == []
    (row,) = decontaminate.hits(df.where("doc_id = 1"), bench).collect()
    assert [(s.start, s.end) for s in row.spans] == [(1, 2)] and row["items"] == ["1"]


def test_a_shared_window_shares_its_fingerprint():
    """Winnowing's guarantee: the least k-gram of a shared window is the same on both sides, whatever stands around it."""
    r = random.Random(4)
    passage = [r.randrange(1000) for _ in range(10)]
    least = lambda w: min(hash(tuple(w[i : i + 5])) for i in range(6))
    for _ in range(20):
        text = [r.randrange(1000) for _ in range(30)] + passage + [r.randrange(1000) for _ in range(30)]
        assert least(passage) in {least(text[i : i + 10]) for i in range(len(text) - 9)}
