"""Inverted lists of bounded length under a tree of centroids held as tables.

A row is assigned to the nearest of a few coarse centroids, which are broadcast, and
then, by a join on the coarse list, to the nearest fine centroid of that list.  A
coarse list has one fine centroid for every ``rows_per_list`` of its rows, so lists
stay short however large or uneven the table is, and what is broadcast does not grow
with it: the fine centroids are a table that is never on the driver.

Fine centroids are rows of their list, picked by a hash, and name their list: a
``list_id`` is the vec_id of its centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.functions.vectors import hash_order
from nearfield.operators import ivf, metrics
from nearfield.operators.knn import HITS, QueryBlock, hits_batch, per_block, score_block
from nearfield.operators.topk import RunningTopK, merge_salts, top_k
from nearfield.session import broadcast_limit, materialise

ROWS_PER_LIST = 4096
ID_BYTES = 16


class TwoLevelIndex(NamedTuple):
    """Coarse centroids, fine ones (coarse_id, list_id, f32), and the rows (coarse_id, list_id, ...)."""

    coarse: np.ndarray
    fine: DataFrame
    postings: DataFrame
    vec: str


def hash_share(seed: str, key: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 for every key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint")


def pick_fine(rows: DataFrame, sizes: DataFrame, rows_per_list: int, seed: str) -> DataFrame:
    """(coarse_id, vec_id) of the fine centroids: of each coarse list about one row in ``rows_per_list``, at least one.

    A row is picked by comparing its hash with the list's share, so no list is sorted.
    """
    wanted = F.ceil(F.col("n") / rows_per_list).cast("bigint")
    cut = sizes.select("coarse_id", F.expr("n").alias("_n"), wanted.alias("_m")).withColumn("_cut", F.expr("_m * 4294967296 div _n"))
    hashed = rows.select("coarse_id", "vec_id").withColumn("_h", hash_share(seed, "vec_id"))
    least = hashed.groupBy("coarse_id").agg(F.min(F.struct("_h", "vec_id")).alias("_least"))
    joined = hashed.join(F.broadcast(cut.join(least, "coarse_id")), "coarse_id")
    picked = (F.col("_h") < F.col("_cut")) | (F.col("vec_id") == F.col("_least.vec_id"))
    return joined.filter(picked).select("coarse_id", "vec_id").distinct()


def assign_fine(rows: DataFrame, fine: DataFrame, sizes: DataFrame, vec: str, cell_rows: int) -> DataFrame:
    """(vec_id, list_id, coarse_id, ``vec``): rows met with the fine centroids of their coarse list.

    A long coarse list is cut into pieces of about ``cell_rows`` rows, each of which gets the centroids.
    """
    pieces = sizes.select("coarse_id", F.ceil(F.col("n") / cell_rows).cast("int").alias("_pieces"))
    dealt = rows.join(F.broadcast(pieces), "coarse_id").withColumn("_piece", F.pmod(F.xxhash64("vec_id"), F.col("_pieces")).cast("int"))
    spread = fine.join(F.broadcast(pieces), "coarse_id").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    left = dealt.select("coarse_id", "_piece", "vec_id", vec).groupBy("coarse_id", "_piece")
    right = spread.select("coarse_id", "_piece", "list_id", vec).groupBy("coarse_id", "_piece")

    def run(of_rows: pa.Table, centroids: pa.Table) -> pa.Table:
        centroids = centroids.sort_by("list_id")
        names = centroids.column("list_id").to_numpy()
        held = blocks.read_vectors(centroids.column(vec))[0]
        column = of_rows.column(vec)
        at = np.zeros(len(of_rows), np.int64)
        step = max(1, settings.BLOCK_CELLS // max(1, len(names)))
        for first in range(0, len(of_rows), step):
            x = blocks.read_vectors(column.slice(first, step))[0]
            at[first : first + step] = ivf.nearest_rows(x, held, metrics.Cosine, 1)[:, 0]
        made = {"vec_id": of_rows.column("vec_id"), "list_id": names[at], "coarse_id": of_rows.column("coarse_id"), vec: column}
        return pa.table(made)

    element = dict(rows.dtypes)[vec]
    return left.cogroup(right).applyInArrow(run, f"vec_id bigint, list_id bigint, coarse_id int, `{vec}` {element}")


def two_level_build(
    corpus: DataFrame,
    coarse: np.ndarray,
    vec: str = "f32",
    rows_per_list: int = ROWS_PER_LIST,
    cell_rows: int = settings.CELL_ROWS,
    seed: str = "fine",
) -> TwoLevelIndex:
    """Index of (vec_id, ``vec``) under ``coarse``; rows without a vector or an id drop out."""
    rows = corpus.select("vec_id", vec).na.drop()
    list_id = ivf.nearest_list(corpus.sparkSession, F.col(vec), coarse)
    rows = materialise(rows.withColumn("coarse_id", list_id), "coarse_rows")
    sizes = materialise(rows.groupBy("coarse_id").agg(F.count(F.lit(1)).alias("n")), "coarse_sizes")
    picked = pick_fine(rows, sizes, rows_per_list, seed)
    fine = rows.join(picked, ["coarse_id", "vec_id"]).dropDuplicates(["coarse_id", "vec_id"])
    fine = materialise(fine.select("coarse_id", F.col("vec_id").alias("list_id"), vec), "fine")
    assigned = assign_fine(rows, fine, sizes, vec, cell_rows)
    return TwoLevelIndex(coarse, fine, materialise(assigned.sortWithinPartitions("list_id"), "postings"), vec)


def probed_lists(queries: DataFrame, index: TwoLevelIndex, coarse_probes: int, probes: int) -> DataFrame:
    """(qid, list_id): the nearest lists of every query under its nearest coarse lists.

    The fine centroids are searched as the rows of inverted lists themselves.
    """
    fine = index.fine.select(F.col("coarse_id").alias("list_id"), F.col("list_id").alias("vec_id"), index.vec)
    found = ivf.ivf_knn(queries, ivf.IvfIndex(index.coarse, "cosine", fine), probes, coarse_probes, index.vec)
    return found.select("qid", F.col("vec_id").alias("list_id"))


def two_level_knn(queries: DataFrame, index: TwoLevelIndex, k: int, coarse_probes: int, probes: int) -> DataFrame:
    """k nearest rows within the ``probes`` nearest lists: (qid, rk, vec_id, dist)."""
    spark, vec = index.postings.sparkSession, index.vec
    asked = materialise(queries.select("qid", "qv"), "asked")
    probed = materialise(probed_lists(asked, index, coarse_probes, probes), "probed")

    def answer(block: QueryBlock) -> DataFrame:
        ids = spark.createDataFrame([(int(i),) for i in block.ids], "qid bigint")
        table = probed.join(F.broadcast(ids), "qid", "left_semi").toArrow()
        lists = table.column("list_id").to_numpy()
        order = np.argsort(block.ids)
        query = order[np.searchsorted(block.ids[order], table.column("qid").to_numpy())]
        by_list = np.argsort(lists, kind="stable")
        names, starts = np.unique(lists[by_list], return_index=True)
        shipped = spark.sparkContext.broadcast((block, names, np.append(starts, len(lists)), query[by_list]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, wanted, begins, asking = shipped.value
            state = RunningTopK(len(local.ids), k)
            for batch in batches:
                x, _ = blocks.read_vectors(batch.column(2))
                held = batch.column(0).to_numpy()
                row_ids = batch.column(1).to_numpy()
                rows = np.argsort(held, kind="stable")
                here, firsts = np.unique(held[rows], return_index=True)
                for one, of_list in zip(here, np.split(rows, firsts[1:]), strict=True):
                    at = np.searchsorted(wanted, one)
                    if at < len(wanted) and wanted[at] == one:
                        columns = asking[begins[at] : begins[at + 1]]
                        score_block(x[of_list], row_ids[of_list], local.floats, columns, state, metrics.Cosine)
            yield hits_batch(state, local.ids)

        some = spark.createDataFrame([(int(i),) for i in names], "list_id bigint")
        if len(names) * ID_BYTES <= broadcast_limit(spark):
            some = F.broadcast(some)
        near = index.postings.join(some, "list_id", "left_semi").select("list_id", "vec_id", vec)
        hits = near.mapInArrow(run, HITS)
        return top_k(hits, k, salts=merge_salts(hits, len(block.ids)))

    return per_block(asked, answer).select("qid", "rk", "vec_id", "dist")
