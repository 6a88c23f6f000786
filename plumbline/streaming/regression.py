"""Online regression as a stream: a posterior for each entity, kept by Spark from trigger to trigger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.online import along, prior


#: Groups of entities that a state is kept for; a stream that has begun keeps the number that it began with.
BUCKETS = 1024


class _Posteriors(StatefulProcessor):
    """Predicts and learns rows in order, a posterior for each entity of a bucket; the state is k * k + k numbers an entity. A bucket is one call
    of Python and one value, since calls cost more than an entity's few rows."""

    def __init__(self, entity: str, order: list[str], y: str, xs: list[str], prior_precision: float, noise: float):
        self.entity, self.order, self.y, self.xs, self.prior_precision, self.noise = entity, order, y, xs, prior_precision, noise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("posteriors", "entities array<string>, precision array<double>, weighted array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k = len(self.xs)
        names, precision, weighted = [], np.empty((0, k, k)), np.empty((0, k))
        if self.state.exists():
            names, *held = self.state.get()
            precision, weighted = np.array(held[0], float).reshape(-1, k, k), np.array(held[1], float).reshape(-1, k)
        place = {name: i for i, name in enumerate(names)}
        batch = pd.concat(list(rows), ignore_index=True)
        at = np.array([place.setdefault(name, len(place)) for name in batch["entity_name"]], np.int64)
        new = len(place) - len(names)
        start = prior(k, self.prior_precision)
        precision, weighted = (np.concatenate([x, np.repeat(p[None], new, axis=0)]) for x, p in zip((precision, weighted), start, strict=True))
        batch = batch.assign(_at=at).sort_values(["_at", *self.order], kind="stable")
        at = batch["_at"].to_numpy()
        x, y = batch[self.xs].to_numpy(float, na_value=np.nan), batch[self.y].to_numpy(float, na_value=np.nan)
        out = np.empty((3, len(batch)))
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            i = at[lo]
            *out[:, lo:hi], precision[i], weighted[i] = along(x[lo:hi], y[lo:hi], precision[i], weighted[i], self.noise)
        self.state.update((list(place), precision.ravel().tolist(), weighted.ravel().tolist()))
        out[~np.isfinite(out)] = np.nan  # null in the result
        yield batch[list(dict.fromkeys([self.entity, *self.order]))].assign(pred_mean=out[0], pred_var=out[1], log_evidence=out[2])

    def close(self) -> None:
        pass


def running_regression(rows: DataFrame, entity: str, order: list[str], y: str, xs: list[str], prior_precision: float = 1.0, noise: float = 1.0) -> DataFrame:
    """(entity, *order, pred_mean, pred_var, log_evidence) as ``operators.online.online_regression`` gives them, if each trigger's rows
    come after the earlier ones'; rows that come in a later trigger count as later. Needs RocksDB for state (see ``with_rocksdb``).

    Entities are dealt into BUCKETS groups by a hash, those without a name into one of their own."""
    prior(len(xs), prior_precision)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys([entity, *order])) + ", pred_mean double, pred_var double, log_evidence double"
    processor = _Posteriors(entity, order, y, xs, prior_precision, noise)
    name = F.hex(entity) if kinds[entity] == "binary" else F.col(entity).cast("string")
    # names that begin with an underscore are lost on the way to Python
    dealt = rows.select(*dict.fromkeys([entity, *order, y, *xs]), F.coalesce(name, F.lit("")).alias("entity_name"))
    bucket = F.when(F.col(entity).isNull(), -1).otherwise(F.pmod(F.xxhash64("entity_name"), F.lit(BUCKETS))).cast("int")
    return dealt.withColumn("entity_bucket", bucket).groupBy("entity_bucket").transformWithStateInPandas(processor, schema, "append", "none")


def with_rocksdb(spark) -> None:
    """Keyed state of this kind lives in RocksDB; a query that has begun keeps the store that it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
