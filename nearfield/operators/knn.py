"""Batch k-nearest-neighbour search by full scan.

A bounded block of queries goes to every task; a task scores its share of the
corpus against it and hands on at most k rows for each query, so the shuffle
carries candidates and never vectors.  Longer query tables run block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.functions.vectors import cosine_distance
from nearfield.operators import metrics
from nearfield.operators.topk import RunningTopK, merge_salts, top_k
from nearfield.session import broadcast_limit, cut_lineage, query_chunk_rows

HITS = "qid bigint, vec_id bigint, dist double"


class QueryBlock(NamedTuple):
    """A bounded set of queries, as float rows, as packed codes, or both."""

    ids: np.ndarray
    floats: np.ndarray | None
    codes: np.ndarray | None

    @property
    def nbytes(self) -> int:
        return sum(part.nbytes for part in self if part is not None)

    def side(self, metric: str) -> np.ndarray:
        return self.codes if metric == "hamming" else self.floats


def _block(queries: DataFrame, limit: int) -> QueryBlock:
    table = queries.toArrow()

    def rows(name: str, dtype) -> np.ndarray | None:
        return blocks.read_vectors(table.column(name), dtype)[0] if name in table.column_names else None

    block = QueryBlock(
        table.column("qid").to_numpy().astype(np.int64), rows("qv", np.float64), rows("qcode", np.int64)
    )
    if block.nbytes > limit:
        raise ValueError(
            f"a query block of {block.nbytes} bytes exceeds {settings.BROADCAST_LIMIT_KEY}; "
            f"lower {settings.QUERY_CHUNK_KEY}"
        )
    return block


def query_blocks(queries: DataFrame) -> Iterator[QueryBlock]:
    """``queries`` (qid, qv and/or qcode) in blocks of bounded size.

    A table that fits one block takes one job.  A longer one is split by a hash
    of the query id, so no more than one block is ever on the driver.
    """
    spark = queries.sparkSession
    rows, limit = query_chunk_rows(spark), broadcast_limit(spark)
    sides = [c for c in ("qv", "qcode") if c in queries.columns]
    queries = queries.select(F.col("qid").cast("bigint"), *sides).na.drop(subset=sides)
    first = _block(queries.limit(rows + 1), limit)
    if len(first.ids) <= rows:
        yield first
        return
    pieces = -(-queries.count() // rows)
    for piece in range(pieces):
        yield _block(queries.filter(F.pmod(F.xxhash64("qid"), F.lit(pieces)) == piece), limit)


def score_block(
    x: np.ndarray,
    ids: np.ndarray,
    q: np.ndarray,
    columns: np.ndarray,
    state: RunningTopK,
    metric,
    allowed: np.ndarray | None = None,
) -> None:
    """Offer the rows of ``x`` to the queries ``columns`` of ``q``.

    ``allowed``, rows x columns, leaves pairs out.
    """
    if len(x) == 0 or len(columns) == 0:
        return
    step = max(1, settings.BLOCK_CELLS // len(columns))
    wanted = q[columns]
    for start in range(0, len(x), step):
        part, part_ids = x[start : start + step], ids[start : start + step]
        coarse = metric.coarse(part, wanted)
        if allowed is not None:
            coarse = np.where(allowed[start : start + step], coarse, np.nan)
        bound = state.bound[columns]
        if len(part) > state.k and np.isinf(bound).any():
            kth = np.partition(coarse, state.k - 1, axis=0)[state.k - 1]
            bound = np.fmin(bound, kth)
        rows, cols = np.nonzero(coarse <= bound[None, :] + metric.slack)
        dist = metric.exact(part, wanted, rows, cols) if metric.slack else coarse[rows, cols].astype(float)
        state.offer(columns[cols], dist, part_ids[rows])


def hits_batch(state: RunningTopK, query_ids: np.ndarray) -> pa.RecordBatch:
    state.settle()
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[state.query]), pa.array(state.ids), pa.array(state.dist)],
        names=["qid", "vec_id", "dist"],
    )


def scan_block(
    corpus: DataFrame, block: QueryBlock, k: int, vec: str, metric_name: str, bound: np.ndarray | None = None
) -> DataFrame:
    """Per-task k best rows of ``corpus`` for every query of ``block``.

    ``bound`` holds distances the k-th best row is known not to exceed; rows
    beyond them are not handed on.
    """
    metric, dtype = metrics.metric_of(metric_name), metrics.DTYPES[metric_name]
    shipped = corpus.sparkSession.sparkContext.broadcast((block, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, known = shipped.value
        ids, matrix = local.ids, local.side(metric_name)
        state, everyone = RunningTopK(len(ids), k), np.arange(len(ids))
        if known is not None:
            state.bound[:] = known
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(1), dtype)
            score_block(x, batch.column(0).to_numpy(), matrix, everyone, state, metric)
        yield hits_batch(state, ids)

    rows = corpus.select("vec_id", vec).filter(F.col(vec).isNotNull())
    return rows.mapInArrow(run, HITS)


def pilot_bound(pilot: DataFrame | None, block: QueryBlock, k: int, vec: str, metric: str) -> np.ndarray | None:
    """Distance of each query's k-th best row among ``pilot``.

    ``pilot`` is a part of the corpus, so the whole corpus does at least as well.
    With a hundredth of a long table as pilot, its tasks hand on about a hundred
    times k rows per query instead of k rows per query and task.
    """
    if pilot is None:
        return None
    kth = top_k(scan_block(pilot, block, k, vec, metric), k).filter(F.col("rk") == k).select("qid", "dist").toArrow()
    order = np.argsort(block.ids)
    bound = np.full(len(block.ids), np.inf)
    bound[order[np.searchsorted(block.ids[order], kth.column("qid").to_numpy())]] = kth.column("dist").to_numpy()
    return bound


def pilot_files(spark: SparkSession, path: str, share: float = 0.01) -> DataFrame:
    """A share of the files of a stored table, spread over the table."""
    table = spark.read.parquet(path)
    files = sorted(table.inputFiles())
    step = max(1, round(1 / share))
    return spark.read.schema(table.schema).option("basePath", path).parquet(*files[::step])


def per_block(queries: DataFrame, answer: Callable[[QueryBlock], DataFrame]) -> DataFrame:
    """Union of ``answer`` over the query blocks.

    With several blocks each answer is written out before the next one starts,
    so the driver and the executors hold one block at a time.
    """
    result, several = None, False
    for block in query_blocks(queries):
        if result is not None and not several:
            result, several = cut_lineage(result), True
        part = answer(block)
        result = part if result is None else result.unionByName(cut_lineage(part))
    return result


def exact_knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    vec: str = "f32",
    metric: str = "cosine",
    pilot: DataFrame | None = None,
) -> DataFrame:
    """The k nearest rows of every query: (qid, rk, vec_id, dist).

    ``pilot``, any part of the corpus, is scanned first and keeps the shuffle of
    a long table small; the result is the same without it.
    """

    def answer(block: QueryBlock) -> DataFrame:
        bound = pilot_bound(pilot, block, k, vec, metric)
        hits = scan_block(corpus, block, k, vec, metric, bound)
        return top_k(hits, k, salts=merge_salts(hits, len(block.ids)))

    found = per_block(queries, answer)
    return found.select("qid", "rk", "vec_id", "dist")


def hamming_knn(
    queries: DataFrame, codes: DataFrame, k: int, variant: str, pilot: DataFrame | None = None
) -> DataFrame:
    """The k rows whose code differs least: (qid, rk, vec_id, dist)."""
    found = exact_knn(queries.select("qid", "qcode"), codes, k, f"code_{variant}", "hamming", pilot)
    return found.withColumn("dist", F.col("dist").cast("int"))


def ground_truth(queries: DataFrame, corpus: DataFrame, k: int, vec: str = "v") -> DataFrame:
    """The k rows of largest dot product, the truth recall is measured by."""
    found = exact_knn(queries, corpus, k, vec, "dot")
    return found.select("qid", "rk", "vec_id", (-F.col("dist")).alias("dot"))


def nearest_to(vector: list[float], corpus: DataFrame, k: int, vec: str = "f32") -> DataFrame:
    """The k nearest rows of one vector: a distance column and an ordered limit."""
    dist = cosine_distance(F.col(vec), F.lit([float(x) for x in vector]))
    near = corpus.filter(F.col(vec).isNotNull()).select("vec_id", dist.alias("dist")).orderBy("dist", "vec_id").limit(k)
    return near
