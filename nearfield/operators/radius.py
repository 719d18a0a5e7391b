"""Exact Hamming search by counting distances first.

Distances of codes are small whole numbers, so one pass counts, per query, how many
rows lie at each distance; the sums of all tasks give the exact radius of the k
nearest.  Rows at the radius itself may be many (a code that a third of the rows
share), of which those of smallest id count: where they are too many, further
passes count them in ranges of ids until the range that ends the answer holds k at
most.  The last pass hands on only the rows that are then known to be wanted, so
what is shuffled does not grow with the tasks or with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.operators.knn import HITS, QueryBlock, per_block
from nearfield.operators.metrics import Hamming
from nearfield.operators.topk import merge_salts, top_k

COUNTED_CELLS = 1 << 23  # queries x distances counted by a task at once
ID_BINS = 256
COUNTS = "q int, bin int, n bigint"


def _scan(codes: DataFrame, vec: str, q: np.ndarray, step: Callable, schema: str, last: Callable) -> DataFrame:
    """Run ``step(state, ids, distances)`` over slices of the rows; ``last(state)`` makes a task's result."""
    shipped = codes.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, wanted = None, shipped.value
        size = max(1, settings.BLOCK_CELLS // max(1, len(wanted)))
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(1), np.int64)
            ids = batch.column(0).to_numpy()
            for first in range(0, len(x), size):
                distances = Hamming.coarse(x[first : first + size], wanted)
                state = step(state, ids[first : first + size], distances)
        if state is not None:
            yield last(state)

    return codes.mapInArrow(run, schema)


def _counts_batch(counts: np.ndarray) -> pa.RecordBatch:
    q, at = np.nonzero(counts)
    columns = [q.astype(np.int32), at.astype(np.int32), counts[q, at]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "bin", "n"])


def _summed(partial: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    table = partial.groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape, np.int64)
    out[table.column("q").to_numpy(), table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return out


def distance_counts(codes: DataFrame, vec: str, q: np.ndarray, k: int) -> np.ndarray:
    """(queries, distances): rows at each distance, as far as the k nearest of any task reach."""
    queries, bins = len(q), q.shape[1] * 64 + 1

    def step(counts, ids, distances):
        at = distances + np.arange(queries) * bins
        found = np.bincount(at.ravel(), minlength=queries * bins).reshape(queries, bins)
        return found if counts is None else counts + found

    def last(counts):
        # Beyond its own k nearest a task has nothing to add to the radius.
        before = np.cumsum(counts, axis=1) - counts
        return _counts_batch(np.where(before < k, counts, 0))

    return _summed(_scan(codes, vec, q, step, COUNTS, last), (queries, bins))


def radii(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(radius of the k nearest, rows nearer than it, rows at it) of every query; all rows where there are fewer than k."""
    upto = np.cumsum(counts, axis=1)
    reached = upto >= k
    radius = np.where(reached.any(axis=1), reached.argmax(axis=1), counts.shape[1] - 1)
    every = np.arange(len(counts))
    return radius, upto[every, radius] - counts[every, radius], counts[every, radius]


def id_cuts(codes: DataFrame, vec: str, q: np.ndarray, radius: np.ndarray, need: np.ndarray, k: int) -> np.ndarray:
    """Largest id wanted among the rows at ``radius``, of which each query needs the ``need`` smallest ids.

    Up to k rows more than needed may lie under a cut.
    """
    least, most = codes.agg(F.min("vec_id"), F.max("vec_id")).first()
    low, high, need = [least] * len(q), [most] * len(q), need.copy()
    active = np.arange(len(q))
    while len(active):
        first = np.array([low[i] for i in active], np.int64)
        final = np.array([high[i] for i in active], np.int64)
        width = np.array([-(-(high[i] - low[i] + 1) // ID_BINS) for i in active], np.uint64)
        at_radius = radius[active]

        def step(counts, ids, distances, first=first, final=final, width=width, at_radius=at_radius):
            row, one = np.nonzero(distances == at_radius)
            inside = (ids[row] >= first[one]) & (ids[row] <= final[one])
            row, one = row[inside], one[inside]
            at = (ids[row].astype(np.uint64) - first[one].astype(np.uint64)) // width[one]
            found = np.bincount(one * ID_BINS + at.astype(np.int64), minlength=len(first) * ID_BINS)
            found = found.reshape(len(first), ID_BINS)
            return found if counts is None else counts + found

        counts = _summed(_scan(codes, vec, q[active], step, COUNTS, _counts_batch), (len(active), ID_BINS))
        still = []
        for i, of_query, wide in zip(active, counts, width, strict=True):
            upto = np.cumsum(of_query)
            at = int(np.searchsorted(upto, need[i]))
            need[i] -= upto[at] - of_query[at]
            low[i], high[i] = low[i] + at * int(wide), min(high[i], low[i] + (at + 1) * int(wide) - 1)
            if of_query[at] > k and low[i] < high[i]:
                still.append(i)
        active = np.array(still, np.int64)
    return np.array(high, np.int64)


def rows_within(codes: DataFrame, block: QueryBlock, vec: str, k: int) -> DataFrame:
    """(qid, vec_id, dist) of the rows that may be among the k nearest of each query."""
    q = block.codes
    counts = distance_counts(codes, vec, q, k)
    radius, below, tied = radii(counts, k)
    cut = np.full(len(q), np.iinfo(np.int64).max)
    many = np.flatnonzero(tied > k)
    if len(many):
        cut[many] = id_cuts(codes, vec, q[many], radius[many], (k - below)[many], k)
    shipped = codes.sparkSession.sparkContext.broadcast((block, radius, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, within, last = shipped.value
        size = max(1, settings.BLOCK_CELLS // max(1, len(local.ids)))
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(1), np.int64)
            ids = batch.column(0).to_numpy()
            for first in range(0, len(x), size):
                part = ids[first : first + size]
                distances = Hamming.coarse(x[first : first + size], local.codes)
                wanted = (distances < within) | ((distances == within) & (part[:, None] <= last))
                row, one = np.nonzero(wanted)
                columns = [local.ids[one], part[row], distances[row, one].astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "vec_id", "dist"])

    return codes.mapInArrow(run, HITS)


def hamming_radius_knn(queries: DataFrame, codes: DataFrame, k: int, variant: str) -> DataFrame:
    """The k rows whose code differs least: (qid, rk, vec_id, dist), as ``hamming_knn`` finds them.

    ``codes`` is read several times, so it should be a stored table.  Rows without a
    code or an id take no part.
    """
    vec = f"code_{variant}"
    rows = codes.select("vec_id", vec).na.drop()

    def answer(block: QueryBlock) -> DataFrame:
        bins = block.codes.shape[1] * 64 + 1 if len(block.ids) else 1
        size, result = max(1, COUNTED_CELLS // bins), None
        for first in range(0, max(1, len(block.ids)), size):
            part = QueryBlock(block.ids[first : first + size], None, block.codes[first : first + size])
            if len(part.ids) == 0:
                hits = rows.sparkSession.createDataFrame([], HITS)
            else:
                hits = rows_within(rows, part, vec, k)
            best = top_k(hits, k, salts=merge_salts(hits, len(part.ids)))
            result = best if result is None else result.unionByName(best)
        return result

    found = per_block(queries.select("qid", "qcode"), answer)
    return found.select("qid", "rk", "vec_id", F.col("dist").cast("int").alias("dist"))
