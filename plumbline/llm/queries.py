"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, conversations, decontaminate, fingerprints, mixing, near_dedup, quality, secret_scan, sharding, token_counts, topk, toxicity
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(documents.select("doc_id", "text"), toxicity.fit(documents, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(documents.select("doc_id", "text"), quality.fit(documents, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.digest(given, conversations.repair(conversations.damage(given)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_top_k, op3_mixing, op4_toxicity, op5_bpe_codec, op6_secret_scan, op7_quality, op8_fingerprints, op9_token_counts, op10_near_dedup, op11_conversation_repair, op12_collocations, op13_decontamination)
}

def _rule_rows(i: int, rule: secret_scan.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT d.row, {i} AS nth, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(d.t, '{p}') AS gaps,
        regexp_extract_all(d.t, '{p}', 0) AS hits, regexp_extract_all(d.t, '{p}', {rule.group}) AS keys FROM d"""


def _after(rest: str, cost: int, letters: str) -> str:
    """A repair that begins with these letters, as a struct of cost and audit."""
    return f"{{'c': {cost} + {rest}.c, 'a': '{letters}' || {rest}.a}}"


def _step_sql(s: int) -> str:
    """The best repair from state ``s`` that begins with what becomes of row z, from the bests behind it."""
    initial, to = conversations.NEXT[s]
    kept = " ".join(f"WHEN z.i = '{i}' AND fault IS NULL THEN {_after(f's{t}', 0, 'K')} WHEN z.i = '{i}' AND fault = 'truncated' THEN {_after(f's{t}', 5, 'K')}" for (own, i), t in conversations.STEP.items() if own == s)
    put = f"WHEN fault IS NULL THEN {_after(f's{to}', 1, 'R')} WHEN fault = 'truncated' THEN {_after(f's{to}', 6, 'R')}"
    return f"list_min([{_after(f's{s}', 2, 'D')}, CASE {kept} ELSE NULL END, CASE {put} ELSE NULL END]) AS r{s}"


#: Fixed values of the contracts.
ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK, WORD = r"[^\x20\x09-\x0D]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op2_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(_rule_rows(i, r) for i, r in enumerate(secret_scan.RULES))}),
        n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
        o AS (
            SELECT row, nth, kind, least, hits[i] AS hit, keys[i] AS key,
                CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
            FROM n
        ),
        p AS (SELECT row, nth, a, kind || ':' || a || ':' || (a + length(hit)) AS s FROM o WHERE length(key) >= least),
        q AS (
            SELECT row, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
                string_agg(s, ',' ORDER BY a, nth) FILTER (nth < 3) AS base, string_agg(s, ',' ORDER BY a, nth) AS spans
            FROM p GROUP BY row
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN q USING (row)""",
    "op11_conversation_repair": f"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        f AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)), lambda c, b:
            list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS fate FROM k),
        g AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM f WHERE fate <> 0
        ),
        h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM g),
        z AS (
            SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM h
        ),
        b AS (
            SELECT conv_id, count(*) + 1 AS p, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM z GROUP BY conv_id
            UNION ALL
            SELECT conv_id, p, list_min([r0, {_after("r2", 5, "I")}, {_after("r3", 10, "II")}]), list_min([r1, {_after("r2", 5, "I")}, {_after("r3", 10, "II")}]),
                list_min([r2, {_after("r3", 5, "I")}]), list_min([r3, {_after("r2", 5, "I")}])
            FROM (SELECT z.conv_id, z.p, {", ".join(_step_sql(s) for s in range(4))} FROM b JOIN z ON b.conv_id IS NOT DISTINCT FROM z.conv_id AND z.p = b.p - 1)
        ),
        e AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM b WHERE p = 1),
        l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM e),
        n AS (SELECT conv_id, j, audit[j] AS letter, count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS p FROM l),
        o AS (
            SELECT n.conv_id, n.j, n.letter, z.role, z.text, row_number() OVER (PARTITION BY n.conv_id ORDER BY n.j) - 1 AS nth
            FROM n LEFT JOIN z ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND n.p = z.p AND n.letter <> 'I' WHERE n.letter <> 'D'
        ),
        q AS (SELECT *, max(CASE WHEN nth = 0 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM o),
        t AS (
            SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
            FROM q GROUP BY conv_id
        ),
        u AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id
        )
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON c.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {ABC}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) z(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        v AS (
            SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * u.a * u.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
            FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.cut + 1:], ' ')
        ),
        m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM v),
        x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
        y AS (
            SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
            FROM m LEFT JOIN x ON x.lang = m.lang AND x.phrase = m.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
        ),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
        SELECT y.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM y JOIN t ON t.lang = y.lang WHERE rank <= 2000""",
    "op13_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '{WORD}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '{WORD}') AS w FROM benchmark),
        j AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
        v AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS t FROM j),
        s AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM v) WHERE len(w) >= m),
        h AS (SELECT s.row, s.p, s.m, v.item_id FROM (SELECT row, m, p, array_to_string(w[p:p + m - 1], ' ') AS t FROM s) s JOIN v ON v.m = s.m AND v.t = s.t),
        n AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + m)) AS q FROM h) GROUP BY row),
        k AS (SELECT row, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n ON n.row = d.row LEFT JOIN k ON k.row = d.row""",
}
