"""Two-stage search: candidates by code, order by cosine distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.operators import metrics
from nearfield.operators.knn import QueryBlock, per_block, pilot_bound, scan_block
from nearfield.operators.topk import merge_salts, top_k
from nearfield.session import broadcast_limit

CANDIDATE_BYTES = 24


def pair_distance(spark: SparkSession, block: QueryBlock, metric: str = "cosine"):
    """Column function (qid, vector) -> distance to that query."""
    order = np.argsort(block.ids)
    shipped = spark.sparkContext.broadcast((block.ids[order], block.side(metric)[order]))
    measure, dtype = metrics.metric_of(metric), metrics.DTYPES[metric]

    @F.arrow_udf("double")
    def distance(qid: pa.Array, vec: pa.Array) -> pa.Array:
        x, _ = blocks.read_vectors(vec, dtype)
        ids, matrix = shipped.value
        at = np.searchsorted(ids, qid.to_numpy())
        return pa.array(measure.exact(x, matrix, np.arange(len(x)), at))

    return distance


def rerank(
    candidates: DataFrame, block: QueryBlock, corpus: DataFrame, k: int, vec: str, per_query: int
) -> DataFrame:
    """Order ``candidates`` (qid, vec_id) by the float column, keep k.

    A query has at most ``per_query`` candidates, so their size is known before
    anything runs: within the limit they are broadcast and the corpus stays in
    place; beyond it the join shuffles.
    """
    size = len(block.ids) * per_query * CANDIDATE_BYTES
    if size <= broadcast_limit(corpus.sparkSession):
        candidates = F.broadcast(candidates)
    pairs = corpus.select("vec_id", vec).filter(F.col(vec).isNotNull()).join(candidates, "vec_id")
    distance = pair_distance(corpus.sparkSession, block)
    return top_k(pairs.select("qid", "vec_id", distance("qid", vec).alias("dist")), k)


def rerank_knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    overfetch: int,
    variant: str,
    precision: str,
    pilot: DataFrame | None = None,
) -> DataFrame:
    """k nearest rows by ``precision`` among the k*overfetch nearest by code.

    ``queries`` carry (qid, qv, qcode): the float and the coded query.  The
    first pass reads codes only, the second reads floats of the candidates.
    ``pilot`` is a part of the corpus, as in ``exact_knn``.
    """
    code = f"code_{variant}"
    width = k * overfetch

    def answer(block: QueryBlock) -> DataFrame:
        bound = pilot_bound(pilot, block, width, code, "hamming")
        hits = scan_block(corpus, block, width, code, "hamming", bound)
        candidates = top_k(hits, width, salts=merge_salts(hits, len(block.ids))).select("qid", "vec_id")
        return rerank(candidates, block, corpus, k, precision, width)

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")
