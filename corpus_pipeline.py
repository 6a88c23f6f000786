"""A corpus pipeline in five stages; each stage's rows are written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_codec, mixing, near_dedup, quality, secret_scan
from plumbline.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of the least id."""
    return near_dedup.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    clean = secret_scan.redact(secret_scan.scan(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, left or repeated so that the sources' words meet their targets; a document that is taken twice is
    two rows. Documents without words belong to no share and go."""
    mixed = mixing.source_mix(docs.select(*COLUMNS), carry=COLUMNS).where("taken > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    return bpe_codec.encode_table(docs.select("doc_id", "text"))


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can't express the classifier, the sketches nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is a table in the shared folder that the next one reads."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
