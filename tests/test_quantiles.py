"""Percentiles of all rows are exact however they are found, and no aggregate holds all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import encodings as C
from plumbline.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("few", [3, 50, 20_000])
@pytest.mark.parametrize("kind", ["spread", "ties", "far", "constant", "nan"])
def test_as_percentile(spark, few, kind):
    rng = np.random.default_rng(1)
    v = {
        "spread": rng.normal(size=3001), "ties": rng.integers(0, 7, 3000).astype(float), "far": np.append(rng.exponential(size=2000) * 1e-9, [1e300, -1e300]),
        "constant": np.full(100, 2.5), "nan": np.append(rng.normal(size=500), [np.nan] * 60),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    want = df.agg(F.percentile("v", F.array(*map(F.lit, SHARES)))).first()[0]
    np.testing.assert_array_equal(quantiles(df, "v", SHARES, few), want)


def test_without_values(spark):
    assert quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_stats_gather_no_whole_column(spark):
    df = spark.range(300).select((F.col("id") % 20).alias("k"), (F.col("id") * 7 % 101).cast("double").alias("y"))
    out = C.order_stat_encode(df, "k", "y")
    assert "Join" not in plan_of(out) and plan_of(out).count("percentile(") == 1  # the groups' own
    few = {r["k"]: r for r in C.order_stat_encode(df.where("k > 0 or id < 100"), "k", "y").collect()}
    want = df.where("k > 0 or id < 100").agg(F.median("y"), F.min("y")).first()
    assert (few[0]["median"], few[0]["min"]) == tuple(want)
