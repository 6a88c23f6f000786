"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one is made only in a local session that has neither."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder, where it outlives lost executors; Spark's cleaner deletes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for loops over joins: a checkpoint keeps the size that its plan was guessed to have,
    which a join multiplies, so a loop's guesses get digits without end on the driver; files have a size. They stay in the folder."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
