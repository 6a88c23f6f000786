"""The pipeline's stages against plain versions of them, and its run on the smallest tables."""

import collections
import gc
import hashlib
import re
import weakref

from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import bpe_codec, near_dedup, quality, secret_scan, stores
from plumbline.llm.common import Scratch, table
from plumbline.llm.vocabulary import byte_path

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns, scratch = docs.columns, Scratch(spark, "test")
    before = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF, "labels"))
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        tables.append(docs.collect())
        if name != "encoding":
            assert docs.columns == columns
    good, unique, clean, mixed, encoded = tables
    assert {r.doc_id for r in good} == {i for i, r in before.items() if model.score(quality._matrix([r.text]))[0] >= 0.3}
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(good)).collect()}
    assert sorted(r.doc_id for r in unique) == sorted(set(classes.values()))
    for r in clean:
        t, spans, out, at = before[r.doc_id].text, secret_scan.base_spans(before[r.doc_id].text), "", 0
        for start, _, end in spans:
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean}
    times = collections.Counter(r.doc_id for r in mixed)
    assert set(times) <= set(size) and max(times.values()) <= 2
    total = sum(size[i] * n for i, n in times.items())
    assert abs(total - 1.5 * sum(size.values())) <= 0.03 * total
    lib = Tokenizer.from_file(byte_path())
    text = {r.doc_id: r.text for r in clean}
    assert collections.Counter(r.doc_id for r in encoded) == times
    for r in encoded:
        assert r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (None, "", None, None, 0, 1), (2, "some words here", "en", "s", 3, 1), (2, "some words here", "en", "s", 3, 1)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_executors_run_few_python_workers(spark, monkeypatch):
    """No stage's task runs the same function twice, in two workers, and no table comes through workers of another kind."""
    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, name))
    docs = table(spark, SF, "documents").limit(60)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").keep(stage(spark, docs, SF), name)
    runs = [re.findall(r"ArrowEvalPython \[(\w+)\(", p) for p in plans]
    assert any("shared" in r for r in runs) and all(r.count("shared") <= 1 for r in runs)
    assert not [p for p in plans if "ExistingRDD" in p]


def test_a_dropped_encoder_takes_its_vocabulary_with_it():
    bpe_codec.encoder(byte_path())
    held = weakref.ref(bpe_codec.encoder(byte_path()).v)
    stores.kept("test", dict)
    gc.collect()
    assert held() is None
