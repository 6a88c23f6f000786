"""Table functions for SQL: what they emit depends on a partition's rows in order, of which they hold a bounded number."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

#: Rows back that an edge reaches at most.
MOST_BACK = 1000


@udtf(returnType="src bigint, dst bigint, back int")
class RecentEdges:
    """Edges from each row's node to the nodes of the ``back`` rows before it in its partition."""

    def __init__(self):
        self.held: deque = deque(maxlen=MOST_BACK)

    def eval(self, row: Row, node: str, back: int) -> Iterator[tuple]:
        if not 0 < back <= MOST_BACK:
            raise ValueError(f"back is from 1 to {MOST_BACK}")
        own = row[node]
        if own is None:
            return
        for i in range(1, min(back, len(self.held)) + 1):
            yield own, self.held[-i], i
        self.held.append(own)


@udtf(returnType="state string, first_at bigint, last_at bigint, n bigint")
class Runs:
    """Runs of one state along a partition: state, the first and last row's number and the rows; a null is a state of its own."""

    def __init__(self):
        self.run: list | None = None

    def eval(self, row: Row, state: str, at: str) -> Iterator[tuple]:
        s = row[state]
        if self.run and self.run[0] == s:
            self.run[2], self.run[3] = row[at], self.run[3] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [s, row[at], row[at], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """Name the functions in a session: ``SELECT * FROM recent_edges(TABLE(t) PARTITION BY code ORDER BY (ts), 'node', 3)`` and
    ``SELECT * FROM runs(TABLE(t) PARTITION BY entity ORDER BY (ts), 'state', 'id')``."""
    spark.udtf.register("recent_edges", RecentEdges)
    spark.udtf.register("runs", Runs)
