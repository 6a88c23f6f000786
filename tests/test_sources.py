"""Sources and sinks on odd values."""

import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files
from plumbline.sources.shared import shared_dir


def test_csv_keeps_odd_texts(spark):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    data = [(1, 'a "b", c'), (2, None), (3, ""), (4, "two\nlines"), (5, "tab\tand \\ slash"), (6, " é ")]
    df = spark.createDataFrame(data, "k int, t string")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == [(k, t or None) for k, t in data]
    files.write_csv(df.limit(0), path)
    assert files.read_csv(spark, path, df.schema).collect() == []


def test_jdbc_reads_allowed_columns_and_pushes_the_predicate(spark):
    url = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(1, 10.0, "x"), (2, None, "y"), (3, 30.0, "z")], "K int, V double, SECRET string")
    rows.write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    got = files.read_jdbc(spark, url, "T", ["K", "V"], {"K", "V"}, "K > 1", driver=driver)
    assert sorted(map(tuple, got.collect())) == [(2, None), (3, 30.0)]
    assert "*GreaterThan(K,1)" in got._jdf.queryExecution().toString()  # the database filters
    with pytest.raises(ValueError):
        files.read_jdbc(spark, url, "T", ["SECRET"], {"K"}, driver=driver)


def test_scan_reads_only_what_is_asked(spark):
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    spark.range(10).select("id", (F.col("id") / 3).alias("v"), F.lit("x").alias("t"), F.nullif(F.col("id"), F.lit(4)).alias("n")).write.parquet(path)
    got = files.read_columns(spark, path, ["v", "n"], rows=7, single=True, fill=-1.0)
    assert dict(got.dtypes) == {"v": "float", "n": "bigint"} and got.count() == 7
    assert "ReadSchema: struct<v:double,n:bigint>" in got._jdf.queryExecution().toString()
    assert {r.n for r in files.read_columns(spark, path, ["n"], fill=-1.0).collect()} == {-1, 0, 1, 2, 3, 5, 6, 7, 8, 9}
    assert files.task_of(spark, path, "t") == "classification" and files.task_of(spark, path, "v", most=9) == "regression" and files.task_of(spark, path, "v") == "classification"
