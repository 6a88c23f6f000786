"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where neither is set and the session is local (tests) is a temporary folder made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs no recomputation of what they hold."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.held: set[str] = set()

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        self.held.add(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        self._delete({t._scratch_path for t in tables} & self.held)

    def only(self, table: DataFrame) -> DataFrame:
        """Delete all tables but this one, and let Spark's cleaner delete the shuffles that nothing refers to any more: it
        follows the driver's garbage collection, which else may come after the next shuffles are written."""
        self._delete(self.held - {table._scratch_path})
        gc.collect()
        self.spark._jvm.System.gc()
        return table

    def _delete(self, names: set[str]) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held -= names


#: Bytes of an Arrow batch between Spark and Python, instead of Spark's default of 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless the user has set a bound. By rows alone, a batch of long texts
    takes tens of times that, in Spark and in Python, for each task."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(BATCH_BYTES))


#: Arrow's types of the columns of local tables.
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's ``rows``, sent as Arrow. Lists are unpickled by Python workers of another kind than functions', which
    then stay beside those on the executors."""
    columns = [c.split(" ") for c in schema.split(", ")]
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    arrays = [pa.array(list(v), KINDS[kind]) for v, (_, kind) in zip(values, columns, strict=True)]
    return spark.createDataFrame(pa.table(arrays, [name for name, _ in columns]), schema)


def text_lists(text: pa.Array, most: int = 500) -> Iterator[list[str]]:
    """An Arrow array's texts, a few at a time, so that a batch isn't held twice; nulls as empty texts."""
    for i in range(0, len(text), most):
        yield [t or "" for t in text.slice(i, most).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, label: str, per_class: int, seed: int = 7) -> DataFrame:
    """At most ``per_class`` labelled ids of each class outside the held-out fold: (doc_id, y).

    The draw is by a seeded hash of the id, so reruns agree; an id with several labels takes the largest.
    The bound makes the result fit for a broadcast: 2 * per_class rows of 12 bytes.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    )
    parts = [rows.where(F.col("y") == c).orderBy("_h", "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "y")


def labelled(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of a bounded labelled sample: at most 2 * per_class rows, since of several texts of an id only the least
    by hash is taken. The ids are broadcast, so only texts of the sample are shuffled."""
    ids = label_sample(labels, label, per_class)
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), F.md5(F.col("text").cast("binary")))).alias("t")
    return rows.groupBy("doc_id", "y").agg(one).select("doc_id", "t.text", "y")
