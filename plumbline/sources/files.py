"""Readers and writers: pruned Parquet scans, tails, append stores, CSV sinks, vector text, JDBC and seeded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None, single: bool = False, fill: float | None = None) -> DataFrame:
    """Parquet with only the named columns scanned, doubles as floats if ``single``, nulls of numbers filled, at most ``rows`` rows."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    if single:
        df = df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df = df.na.fill(fill) if fill is not None else df
    return df.limit(rows) if rows is not None else df


def task_of(spark: SparkSession, path: str, target: str, most: int = 50) -> str:
    """Whether a target is text, has at most ``most`` values, or neither; only its column is read."""
    df = spark.read.parquet(path).select(target)
    if dict(df.dtypes)[target] in ("string", "boolean"):
        return "classification"
    return "classification" if df.distinct().limit(most + 1).count() <= most else "regression"


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows in order: a top-n, not a sort of everything."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def drop_constant(df: DataFrame) -> DataFrame:
    """Without columns of at most one value; one aggregate for all."""
    s = df.agg(*(F.min(c).alias(f"lo_{c}") for c in df.columns), *(F.max(c).alias(f"hi_{c}") for c in df.columns)).first()
    return df.select(*(c for c in df.columns if s[f"lo_{c}"] != s[f"hi_{c}"]))


def append_observations(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def fold_observations(df: DataFrame, keys: list[str], metrics: list[str], weight: str = "n_obs", time: str = "ts") -> DataFrame:
    """One row a key: each metric's median weighted by the number of observations, their sum, and the last time."""
    return df.groupBy(*keys).agg(*(F.percentile(m, F.lit(0.5), F.col(weight)).alias(m) for m in metrics), F.sum(weight).alias(weight), F.max(time).alias(time))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside values are doubled, as readers of CSV expect, and blanks at a text's ends stay. CSV doesn't tell a null
    from an empty text: both are read as null."""
    df.write.mode("overwrite").options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` has written; values may hold line breaks."""
    return spark.read.schema(schema).options(escape='"', multiLine=True).csv(path, header=True)


def parse_vectors(lines: DataFrame) -> DataFrame:
    """(word, vector) from lines of a word and numbers between spaces; what is no number becomes null."""
    parts = F.split("value", " ")
    return lines.where(F.size(parts) > 1).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("float")).alias("vector"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], allowed: set[str], predicate: str | None = None, **options: str) -> DataFrame:
    """Allowed columns of a table; the predicate is pushed to the database."""
    if not set(columns) <= allowed:
        raise ValueError(f"columns not allowed: {sorted(set(columns) - allowed)}")
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)
    return df.where(predicate) if predicate else df


def synthetic(spark: SparkSession, rows: int, features: int, seed: int = 0) -> DataFrame:
    """id, normal features x0.. and a 0/1 target whose log odds are their sum; the same rows for a seed and partitioning."""
    df = spark.range(rows)
    df = df.withColumns({f"x{i}": F.randn(seed + i) for i in range(features)})
    p = 1 / (1 + F.exp(-sum(F.col(f"x{i}") for i in range(features))))
    return df.withColumn("y", (F.rand(seed + features) < p).cast("int"))
