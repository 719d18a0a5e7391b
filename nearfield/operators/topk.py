"""The k best rows per key, ties broken by id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import shuffle_partitions


def merge_salts(df: DataFrame, keys: int) -> int:
    """How many ways to split one key so that few keys still fill the cluster."""
    return max(1, min(64, shuffle_partitions(df.sparkSession) // (8 * max(1, keys))))


def top_k(
    df: DataFrame,
    k: int,
    key: str | tuple[str, ...] = "qid",
    order: tuple[str, ...] = ("dist", "vec_id"),
    salts: int = 1,
) -> DataFrame:
    """Rows ranked ``rk`` 1..k within ``key``.

    Spark turns the rank filter into a group limit on both sides of the
    shuffle, so a task never holds a whole key.  With ``salts`` above one a key
    is first cut down in slices, which spreads a key fed by many tasks.
    """
    keys = (key,) if isinstance(key, str) else key
    if salts > 1:
        sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(salts)))
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = sliced.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk", "_slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


class RunningTopK:
    """k best (distance, id) of each query over the blocks one task reads.

    Offers wait until there are about as many as the answer is long, so sorting
    stays in proportion to the rows offered.  ``bound`` may lag behind the offers
    and never falls below the distance of the k-th best row.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.dist = np.zeros(0, np.float64)
        self.ids = np.zeros(0, np.int64)
        self.bound = np.full(queries, np.inf)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._count = 0
        self._enough = max(1024, queries * k)

    def offer(self, query: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        self._waiting.append((query, dist, ids))
        self._count += len(query)
        if self._count >= self._enough:
            self.settle()

    def settle(self) -> "RunningTopK":
        """Merge what waits; call before reading the result."""
        if not self._waiting:
            return self
        query, dist, ids = (
            np.concatenate([held, *offered])
            for held, offered in zip((self.query, self.dist, self.ids), zip(*self._waiting, strict=True), strict=True)
        )
        self._waiting, self._count = [], 0
        order = np.lexsort((ids, dist, query))
        query, dist, ids = query[order], dist[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = rank == self.k - 1
        self.bound[query[last]] = np.minimum(self.bound[query[last]], dist[last])
        kept = rank < self.k
        self.query, self.dist, self.ids = query[kept], dist[kept], ids[kept]
        return self
