"""Rerank that reads the floats of few row groups.

The table is stored sorted by (list_id, vec_id) in small row groups.  Candidates come
from a scan of the codes alone.  They stand near the queries, so they lie in few lists,
and where they lie is found from the two key columns.  The lists are merged into a
bounded number of ranges, which go to the float scan as a filter: Parquet then leaves
out every row group whose key range meets none of them.  A gap between ranges that is
merged costs rows that the join drops again, never a result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.ivf import ivf_build
from nearfield.operators.knn import QueryBlock, per_block, scan_block
from nearfield.operators.rerank import CANDIDATE_BYTES, rerank
from nearfield.operators.topk import merge_salts, top_k
from nearfield.session import broadcast_limit, materialise

GROUP_BYTES = 16 << 20
RANGES = 64


def write_sorted(
    table: DataFrame, centroids: np.ndarray, path: str, vec: str = "f32", group_bytes: int = GROUP_BYTES, files: int | None = None
) -> None:
    """Store ``table`` with its lists, sorted by (list_id, vec_id); a long list falls into several files."""
    keys = ["list_id", "vec_id"]
    postings = ivf_build(table, centroids, vec).postings
    dealt = postings.repartitionByRange(files, *keys) if files else postings.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes).parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_ranges(values: np.ndarray, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ``values``; the widest gaps stay open."""
    values = np.unique(values)
    if not len(values):
        return []
    gaps = np.diff(values)
    wide = np.flatnonzero(gaps > 1)
    cuts = np.sort(wide[np.argsort(-gaps[wide], kind="stable")[: most - 1]])
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(values) - 1)
    return [(int(values[a]), int(values[b])) for a, b in zip(starts, ends, strict=True)]


def within(name: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(Column.__or__, [F.col(name).between(a, b) for a, b in ranges], F.lit(False))


def lists_of(stored: DataFrame, candidates: DataFrame, count: int) -> np.ndarray:
    """Lists that hold a candidate, from the key columns; a number for each list at most."""
    ids = candidates.select("vec_id").distinct()
    if count * CANDIDATE_BYTES <= broadcast_limit(stored.sparkSession):
        ids = F.broadcast(ids)
    held = stored.select("list_id", "vec_id").join(ids, "vec_id", "left_semi")
    return held.select("list_id").distinct().toArrow().column(0).to_numpy()


def rows_near(stored: DataFrame, lists: np.ndarray, most: int = RANGES) -> DataFrame:
    """The part of ``stored`` whose lists lie in the merged ranges of ``lists``."""
    return stored.filter(within("list_id", merged_ranges(lists, most)))


def rerank_late(
    queries: DataFrame, stored: DataFrame, k: int, overfetch: int, variant: str, precision: str, most: int = RANGES
) -> DataFrame:
    """The answer of ``rerank_knn``, from a table of ``write_sorted``: (qid, rk, vec_id, dist)."""
    code = f"code_{variant}"
    width = k * overfetch

    def answer(block: QueryBlock) -> DataFrame:
        hits = scan_block(stored, block, width, code, "hamming")
        found = top_k(hits, width, salts=merge_salts(hits, len(block.ids))).select("qid", "vec_id")
        found = materialise(found, "candidates")
        near = rows_near(stored, lists_of(stored, found, len(block.ids) * width), most)
        return rerank(found, block, near, k, precision, width)

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")
