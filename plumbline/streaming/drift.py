"""Drift monitor: each batch of a stream is held against a stored reference, and may become the reference itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import _part
from ..operators.quantiles import quantiles


def sketch(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, edges, counts): edges at the quantiles k / bins, equal ones once, and the numbers of values between them (an edge
    belongs to the bin above). Nulls don't count; a column without values has no edges and one empty bin. A row for each column."""
    shares = [i / bins for i in range(1, bins)]
    found = {c: [e for e in dict.fromkeys(quantiles(df, c, shares)) if e is not None] for c in columns}
    counts = histogram(df, found).first()
    rows = [(c, found[c], [int(counts[f"{c}_{i}"]) for i in range(len(found[c]) + 1)]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, edges array<double>, counts array<bigint>")


def histogram(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """One row: column_i, the number of values in bin i of each column, from one aggregate over the rows."""
    inside = lambda c, i: F.count_if(F.col(c).isNotNull() & (_part(F.col(c).cast("double"), edges[c]) == i)).alias(f"{c}_{i}")
    return df.agg(*(inside(c, i) for c, own in edges.items() for i in range(len(own) + 1)))


def _psi(counts: list[Column], reference: list[int]) -> Column:
    """Population stability index of binned counts, half a row added to each bin."""
    n, total, bins = sum(counts[1:], counts[0]), sum(reference), len(reference)
    shares = [((c + 0.5) / (n + 0.5 * bins), (r + 0.5) / (total + 0.5 * bins)) for c, r in zip(counts, reference, strict=True)]
    return sum(((p - q) * F.log(p / F.lit(q)) for p, q in shares), F.lit(0.0))


class DriftMonitor:
    """Holds batches against the reference that was current before them and stores verdicts in ``folder``.

    A verdict is a row for each column: batch, column, n, psi, drifted (psi above ``threshold``) and reference (the batch that the
    reference is of, -1 for the given one). If ``share`` of the columns drifted, or more, the batch is stored as the next reference
    where ``relearn`` is set, and ``on_drift(batch, number)`` is called. All that is stored is named by the batch's number, and a batch
    looks at references of earlier numbers only: a batch that is processed again after a restart says the same and replaces what it
    had stored.
    """

    def __init__(self, reference: DataFrame, columns: list[str], folder: str, bins: int = 10, threshold: float = 0.25, share: float = 0.5, relearn: bool = False, on_drift: Callable[[DataFrame, int], None] | None = None):
        self.columns, self.folder, self.bins, self.threshold, self.share, self.relearn, self.on_drift = columns, folder, bins, threshold, share, relearn, on_drift
        self.spark: SparkSession = reference.sparkSession
        if self._references().isEmpty():
            self._store(sketch(reference, columns, bins), "references", -1)

    def _store(self, df: DataFrame, kind: str, number: int) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")  # a row for each column

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _references(self) -> DataFrame:
        return self._read("references", "column string, edges array<double>, counts array<bigint>, batch int")

    def verdicts(self) -> DataFrame:
        return self._read("verdicts", "column string, n bigint, psi double, drifted boolean, reference int, batch int")

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = self._references().where(F.col("batch") < number).collect()  # a row for each column and reference
        newest = max(r["batch"] for r in rows)
        held = {r["column"]: r for r in rows if r["batch"] == newest}
        counts = histogram(batch, {c: held[c]["edges"] for c in self.columns})
        counts = self.spark.createDataFrame(counts.collect(), counts.schema)  # one row, so that all columns' verdicts read the batch once

        def verdict(c: str) -> Column:
            own = [F.col(f"{c}_{i}") for i in range(len(held[c]["counts"]))]
            n = sum(own[1:], own[0])
            psi = F.when(n > 0, _psi(own, held[c]["counts"]))
            return F.struct(F.lit(c).alias("column"), n.alias("n"), psi.alias("psi"), F.coalesce(psi > self.threshold, F.lit(False)).alias("drifted"), F.lit(newest).alias("reference"))

        said = counts.select(F.explode(F.array(*map(verdict, self.columns))).alias("v")).select("v.*")
        drifted = sum(r["drifted"] for r in said.collect())
        if drifted and drifted >= self.share * len(self.columns):
            if self.relearn:
                self._store(sketch(batch, self.columns, self.bins), "references", number)
            if self.on_drift:
                self.on_drift(batch, number)
        self._store(said, "verdicts", number)  # last: a batch with a verdict is done

    def watch(self, stream: DataFrame, **trigger) -> None:
        """Process what the stream has; call again, also from a new session on the same folder, to go on."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/offsets").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
