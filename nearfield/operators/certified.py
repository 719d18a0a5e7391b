"""Exact nearest neighbours from inverted lists, with a certificate for the lists left out.

Each list knows the widest angle of its rows to its centroid.  By the triangle
inequality for angles no row of a list is nearer to a query than the centroid's
angle less that width.  The lists around a query that hold k rows are read first;
the k-th distance found there is an upper bound, and only lists whose lower bound
does not pass it are read after.  The answer is that of the full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.operators.ivf import IvfIndex, Probes, scan_probed
from nearfield.operators.knn import QueryBlock, per_block
from nearfield.operators.topk import merge_salts, top_k
from nearfield.session import broadcast_limit, materialise

SLACK = 1e-6  # radians; far above the rounding of an arc cosine


class Spread(NamedTuple):
    """Rows of every list, and the widest angle of one of them to the centroid."""

    rows: np.ndarray
    angle: np.ndarray


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the rows of two matrices."""
    return np.arccos(np.clip(blocks.unit_rows(a) @ blocks.unit_rows(b).T, -1.0, 1.0))


def list_spread(index: IvfIndex, vec: str = "f32") -> Spread:
    """One pass over the postings; tasks hand on a row per list."""
    lists = len(index.centroids)
    shipped = index.postings.sparkSession.sparkContext.broadcast(blocks.unit_rows(index.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, widest = np.zeros(lists, np.int64), np.zeros(lists)
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(1))
            if len(x) == 0:
                continue
            at = batch.column(0).to_numpy()
            cosine = np.einsum("ij,ij->i", blocks.unit_rows(x), shipped.value[at])
            np.maximum.at(widest, at, np.arccos(np.clip(cosine, -1.0, 1.0)))
            rows += np.bincount(at, minlength=lists)
        held = np.flatnonzero(rows)
        columns = [held.astype(np.int32), rows[held], widest[held]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list_id", "n", "angle"])

    held = index.postings.filter(F.col(vec).isNotNull()).select("list_id", vec)
    partial = held.mapInArrow(run, "list_id int, n bigint, angle double")
    table = partial.groupBy("list_id").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).toArrow()
    rows, widest = np.zeros(lists, np.int64), np.zeros(lists)
    at = table.column("list_id").to_numpy()
    rows[at], widest[at] = table.column("n").to_numpy(), table.column("angle").to_numpy()
    return Spread(rows, widest)


def nearest_lists_of(to_centroid: np.ndarray, spread: Spread, k: int) -> np.ndarray:
    """(queries, lists): the nearest lists that together hold k rows."""
    order = np.argsort(to_centroid, axis=1, kind="stable")
    held = spread.rows[order]
    wanted = (np.cumsum(held, axis=1) - held < k) & (held > 0)
    out = np.zeros(to_centroid.shape, bool)
    np.put_along_axis(out, order, wanted, axis=1)
    return out


def as_probes(reads: np.ndarray) -> Probes:
    return Probes({int(one): np.flatnonzero(reads[:, one]) for one in np.flatnonzero(reads.any(axis=0))})


def certified_knn(
    queries: DataFrame,
    index: IvfIndex,
    spread: Spread,
    k: int,
    vec: str = "f32",
    read: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """The k nearest of all rows: (qid, rk, vec_id, dist).

    ``index`` holds every row of the corpus and should be a stored one.  ``read``
    gets, for each block, how many (query, list) pairs were read and how many there are.
    """
    if index.metric != "cosine":
        raise ValueError("the certificate holds for angles")

    def answer(block: QueryBlock) -> DataFrame:
        spark = index.postings.sparkSession
        if len(block.ids) * len(index.centroids) * 16 > broadcast_limit(spark):
            raise ValueError("queries x lists exceed the broadcast limit; ask in smaller blocks")
        to_centroid = angles(block.floats, index.centroids) if len(block.ids) else np.zeros((0, len(index.centroids)))
        first = nearest_lists_of(to_centroid, spread, k)
        near = scan_probed(index, block, as_probes(first), k, vec)
        near = materialise(top_k(near, k, salts=merge_salts(near, len(block.ids))).drop("rk"), "certified")
        kth = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("dist")).toArrow()
        bound = np.full(len(block.ids), np.inf)
        order = np.argsort(block.ids)
        at = order[np.searchsorted(block.ids[order], kth.column("qid").to_numpy())]
        bound[at] = np.where(kth.column("n").to_numpy() >= k, kth.column("dist").to_numpy(), np.inf)
        widest = np.where(np.isinf(bound), np.pi, np.arccos(np.clip(1.0 - bound, -1.0, 1.0)))
        beyond = to_centroid - spread.angle > widest[:, None] + SLACK
        second = ~beyond & ~first & (spread.rows > 0)
        if read is not None:
            read.append((int(first.sum() + second.sum()), len(block.ids) * int((spread.rows > 0).sum())))
        if not second.any():
            return top_k(near, k)
        more = scan_probed(index, block, as_probes(second), k, vec, bound)
        return top_k(near.unionByName(more), k, salts=merge_salts(more, len(block.ids)))

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")
