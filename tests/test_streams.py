"""Online regression and drift monitors against plain versions, with nulls, ties, restarts and empty tables."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import online
from plumbline.sources.shared import shared_dir
from plumbline.streaming import drift, regression
from plumbline.streaming import windows as stream

ROWS = "e string, i int, y double, a double, b double"


def rows(seed, n=120):
    r = random.Random(seed)
    some = lambda v: None if r.random() < 0.1 else v
    return [(r.choice(["p", "q", None]), i, some(r.gauss(0, 2)), some(r.random()), some(r.choice([0.0, 1.0, 5.0]))) for i in range(n)] + [("alone", 0, None, None, 1.0), ("once", 0, 3.0, 1.0, 1.0)]


def plain(data, prior=2.0, noise=0.5):
    """Rank-one updates of mean and covariance, row by row."""
    out, held = {}, {}
    for e, i, y, a, b in sorted(data, key=lambda r: (str(r[0]), r[1])):
        mu, cov = held.setdefault(e, (np.zeros(2), np.eye(2) / prior))
        if a is None or b is None:
            out[e, i] = (None, None, None)
            continue
        x = np.array([a, b])
        mean, var = x @ mu, x @ cov @ x + noise**2
        out[e, i] = (mean, var, None if y is None else -0.5 * (math.log(2 * math.pi * var) + (y - mean) ** 2 / var))
        if y is not None:
            gain = cov @ x / var
            held[e] = (mu + gain * (y - mean), cov - np.outer(gain, cov @ x))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        for x, y in zip((r.pred_mean, r.pred_var, r.log_evidence), want[r.e, r.i], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_batch_regression(spark):
    data = rows(1)
    df = spark.createDataFrame(data, ROWS).repartition(3)
    got = online.online_regression(df, "e", ["i"], "y", ["a", "b"], 2.0, 0.5)
    assert got.columns == [*df.columns, "pred_mean", "pred_var", "log_evidence"]
    same(got.collect(), plain(data))
    assert online.online_regression(df.limit(0), "e", ["i"], "y", ["a", "b"]).collect() == []
    with pytest.raises(ValueError):
        online.online_regression(df, "e", ["i"], "y", ["a"], prior_precision=0.0)


def test_stream_regression_goes_on_after_restarts(spark):
    data = rows(2)
    df = spark.createDataFrame(data, ROWS)
    regression.with_rocksdb(spark)
    thirds = [df.where("i < 40"), df.where("i >= 40 and i < 90"), df.where("i >= 90")]
    got = stream.run_in_turn(thirds, lambda r: regression.running_regression(r, "e", ["i"], "y", ["a", "b"], 2.0, 0.5))
    same(got.collect(), plain(data))


def test_f20_a_call_of_python_serves_many_entities(spark, monkeypatch):
    """Entities of one bucket keep apart, through restarts; Python is called by bucket, not by entity."""
    monkeypatch.setattr(regression, "BUCKETS", 2)
    r = random.Random(5)
    data = [(r.choice([*map(str, range(40)), "", None]), i, r.gauss(0, 2), r.random(), r.random()) for i in range(300)]
    df = spark.createDataFrame(data, ROWS)
    regression.with_rocksdb(spark)
    built = regression.running_regression(df, "e", ["i"], "y", ["a", "b"], 2.0, 0.5)
    assert "entity_bucket" in built._jdf.queryExecution().logical().toString()
    got = stream.run_in_turn([df.where("i < 150"), df.where("i >= 150")], lambda x: regression.running_regression(x, "e", ["i"], "y", ["a", "b"], 2.0, 0.5))
    same(got.collect(), plain(data))


def plain_psi(values, edges, reference):
    counts = lambda vs: [sum(sum(e <= v for e in edges) == i for v in vs if v is not None) for i in range(len(edges) + 1)]
    p, q = counts(values), counts(reference)
    share = lambda c: [(x + 0.5) / (sum(c) + 0.5 * len(c)) for x in c]
    return sum((x - y) * math.log(x / y) for x, y in zip(share(p), share(q), strict=True))


def batches(seed):
    r = random.Random(seed)
    at = lambda m: [None if r.random() < 0.05 else r.gauss(m, 1) for _ in range(200)]
    return at(0), [at(0), at(4), at(4), [], at(0)]


@pytest.mark.parametrize("relearn", [False, True])
def test_drift_against_plain_psi(spark, relearn):
    first, later = batches(3)
    frame = lambda vs: spark.createDataFrame([(v, 1.0) for v in vs], "v double, same double")
    folder, called = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}", []
    for number, vs in enumerate(later):
        monitor = drift.DriftMonitor(frame(first), ["v", "same"], folder, relearn=relearn, on_drift=lambda b, n: called.append(n))
        monitor(frame(vs), number)
    edges = lambda vs: sorted(set(np.quantile([v for v in vs if v is not None], np.arange(1, 10) / 10)))
    reference, of, want = first, -1, {}
    for number, vs in enumerate(later):
        psi = plain_psi(vs, edges(reference), reference) if vs else None
        want[number] = (sum(v is not None for v in vs), psi, psi is not None and psi > 0.25, of)
        if want[number][2] and relearn:
            reference, of = vs, number
    got = {r.batch: r for r in monitor.verdicts().where("column = 'v'").collect()}
    assert {n: (r.n, r.drifted, r.reference) for n, r in got.items()} == {n: (w[0], w[2], w[3]) for n, w in want.items()}
    assert all((got[n].psi is None) == (w[1] is None) and (w[1] is None or abs(got[n].psi - w[1]) < 1e-9) for n, w in want.items())
    assert called == [n for n, w in want.items() if w[2]] == ([1, 4] if relearn else [1, 2])
    assert {r.psi for r in monitor.verdicts().where("column = 'same' and batch = 0").collect()} == {0.0}
    before = sorted(map(tuple, monitor.verdicts().collect()), key=repr)
    for number in (1, 2):  # processed once more, as after a restart before the offsets were stored
        monitor(frame(later[number]), number)
    assert sorted(map(tuple, monitor.verdicts().collect()), key=repr) == before


def test_drift_watches_a_stream_and_goes_on(spark):
    root = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    first = spark.range(100).select((F.col("id") % 10).cast("double").alias("v"))
    for shift in (0, 50):
        first.select((F.col("v") + shift).alias("v")).write.mode("append").parquet(f"{root}/in")
        monitor = drift.DriftMonitor(first, ["v"], f"{root}/monitor")
        monitor.watch(spark.readStream.schema(first.schema).parquet(f"{root}/in"))
    monitor.watch(spark.readStream.schema(first.schema).parquet(f"{root}/in"))  # nothing new
    assert [(r.batch, r.n, r.drifted) for r in monitor.verdicts().orderBy("batch").collect()] == [(0, 100, False), (1, 100, True)]
