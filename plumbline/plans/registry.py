"""All queries of the library by name, and their DuckDB equivalents.

A query takes (spark, sf_dir). Its doubles are rounded to six places on both sides, since sums of doubles differ in
the last bits from engine to engine.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", places: int = 6, name: str | None = None):
    """Register a function (read) -> DataFrame, read(table) being its input, with its SQL and the latter's double columns."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(t: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{t}.parquet")

            read.spark, read.folder = spark, sf_dir
            return rounded(f(read), places)

        QUERIES[key] = run
        if sql:
            swap = ", ".join(f"round({c}, {places}) AS {c}" for c in doubles.split())
            ORACLES[key] = f"SELECT * REPLACE ({swap}) FROM ({sql})" if swap else sql
        return f

    return add


for _module in ("joins", "windows", "aggregates", "metrics", "scalars", "encodings", "graphs", "frames", "blends", "transforms", "streams", "mixtures"):
    importlib.import_module(f"plumbline.plans.{_module}")
