"""Inverted lists as a partitioned table.

Centroids are a small model (lists x dimensions, size checked) on the driver;
postings are the corpus with a ``list_id``.  A search ships the queries and the
lists each one probes, and every task scores only the pairs that meet in a list:
no posting is shuffled and no (query, posting) pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.functions.codes import bits_per_dim
from nearfield.functions.vectors import hash_order
from nearfield.operators import metrics
from nearfield.operators.knn import HITS, QueryBlock, hits_batch, per_block, score_block
from nearfield.operators.rerank import rerank
from nearfield.operators.topk import RunningTopK, merge_salts, top_k
from nearfield.session import broadcast_limit, materialise
from nearfield.sources.vectors import hash_sample, hash_share

ROWS_PER_FILE = 1_000_000
# Fewer rows of a list than this are not worth a product of their own.
ROWS_PER_STEP = 64
SUMS_SHARE = 16  # part of the broadcast limit that the sums of a training step may take on the driver


class IvfIndex(NamedTuple):
    """Centroids (row = list id) and the postings they partition."""

    centroids: np.ndarray
    metric: str
    postings: DataFrame


def checked(spark: SparkSession, centroids: np.ndarray) -> np.ndarray:
    if centroids.nbytes > broadcast_limit(spark):
        raise ValueError(
            f"{len(centroids)} centroids take {centroids.nbytes} bytes, above "
            f"{settings.BROADCAST_LIMIT_KEY}; use fewer lists"
        )
    return centroids


def nearest_rows(x: np.ndarray, centroids: np.ndarray, metric, count: int) -> np.ndarray:
    """(len(x), count) list ids, nearest first, ties to the lower id."""
    state = RunningTopK(len(x), count)
    every = np.arange(len(x))
    score_block(centroids, np.arange(len(centroids)), x, every, state, metric)
    return state.settle().ids.reshape(len(x), count).astype(np.int32)


def blockwise(x: np.ndarray, centroids: np.ndarray, metric, count: int) -> np.ndarray:
    step = max(1, settings.BLOCK_CELLS // len(centroids))
    parts = [nearest_rows(x[i : i + step], centroids, metric, count) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, count), np.int32)


def nearest_list(spark: SparkSession, vec: Column | str, centroids: np.ndarray, metric: str = "cosine") -> Column:
    """List id of every vector."""
    shipped = spark.sparkContext.broadcast(checked(spark, centroids))
    dtype, measure = metrics.DTYPES[metric], metrics.metric_of(metric)

    @F.arrow_udf("int")
    def assign(column: pa.Array) -> pa.Array:
        x, valid = blocks.read_vectors(column, dtype)
        out = np.zeros(len(valid), np.int32)
        out[valid] = blockwise(x, shipped.value, measure, 1)[:, 0]
        return pa.array(out, mask=~valid)

    return assign(vec)


def nearest_lists(
    spark: SparkSession, vec: Column | str, centroids: np.ndarray, count: int, metric: str = "cosine"
) -> Column:
    """The ``count`` nearest list ids of every vector, nearest first."""
    shipped = spark.sparkContext.broadcast(checked(spark, centroids))
    dtype, measure = metrics.DTYPES[metric], metrics.metric_of(metric)

    @F.arrow_udf("array<int>")
    def assign(column: pa.Array) -> pa.Array:
        x, valid = blocks.read_vectors(column, dtype)
        lists = blockwise(x, shipped.value, measure, min(count, len(shipped.value)))
        return blocks.write_vectors(lists, valid, pa.int32())

    return assign(vec)


def seed_centroids(corpus: DataFrame, lists: int, vec: str = "f32", seed: str = "centroid") -> np.ndarray:
    """``lists`` pseudo-random corpus rows, in the order of their draw."""
    drawn = hash_sample(corpus.select("vec_id", vec), lists, seed)
    table = drawn.select(vec, hash_order(seed, "vec_id").alias("draw"), "vec_id").toArrow()
    table = table.sort_by([("draw", "ascending"), ("vec_id", "ascending")])
    dtype = np.int64 if vec.startswith("code_") else np.float64
    return checked(corpus.sparkSession, blocks.read_vectors(table.column(vec), dtype)[0])


def list_sums(sample: DataFrame, centroids: np.ndarray, vec: str = "f32") -> DataFrame:
    """(list_id, n, total): rows and vector sum of every list, once for each task that holds rows of it."""
    shipped = sample.sparkSession.sparkContext.broadcast(checked(sample.sparkSession, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros(shipped.value.shape), np.zeros(len(shipped.value), np.int64)
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0))
            if len(x) == 0:
                continue
            at = blockwise(x, shipped.value, metrics.metric_of("cosine"), 1)[:, 0]
            order = np.argsort(at, kind="stable")
            held, starts = np.unique(at[order], return_index=True)
            totals[held] += np.add.reduceat(x[order], starts, axis=0)
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        sums = blocks.write_vectors(totals[held], np.ones(len(held), bool), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(rows[held]), sums], names=["list_id", "n", "total"]
        )

    return sample.select(vec).mapInArrow(run, "list_id int, n bigint, total array<double>")


def lloyd_step(sample: DataFrame, centroids: np.ndarray, vec: str = "f32") -> DataFrame:
    """(list_id, d, mean): mean vector of every list, not yet of unit length.

    Each task hands on one sum per list it holds rows of, so a list that holds
    most rows costs no more than any other.
    """
    return (
        list_sums(sample, centroids, vec).select("list_id", "n", F.posexplode("total").alias("d", "x"))
        .groupBy("list_id", "d")
        .agg((F.sum("x") / F.sum("n")).alias("mean"))
    )


def _moved(means: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Unit-length means; an empty list, whose mean is NaN, keeps its centroid."""
    fresh = blocks.unit_rows(means)
    return np.where(np.isnan(fresh), centroids, fresh)


def updated_centroids(means: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Unit-length means; an empty list keeps its centroid."""
    table = means.toArrow()
    fresh = np.full(centroids.shape, np.nan)
    fresh[table.column("list_id").to_numpy(), table.column("d").to_numpy()] = table.column("mean").to_numpy()
    return _moved(fresh, centroids)


def gathered_step(sample: DataFrame, centroids: np.ndarray, vec: str = "f32") -> np.ndarray:
    """The centroids after one step whose sums, a model for each task, are added on the driver."""
    table = list_sums(sample, centroids, vec).toArrow()
    totals, rows = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
    if len(table):
        at = table.column("list_id").to_numpy()
        np.add.at(totals, at, blocks.read_vectors(table.column("total"))[0])
        np.add.at(rows, at, table.column("n").to_numpy())
    with np.errstate(invalid="ignore"):
        return _moved(totals / rows[:, None], centroids)


def train_sample(corpus: DataFrame, vec: str, sample_rows: int | None = None) -> DataFrame:
    """Training rows: all, or about ``sample_rows`` picked by hash where the caller asks for fewer."""
    rows = corpus.select("vec_id", vec)
    return materialise(rows if sample_rows is None else hash_share(rows, sample_rows, "train"), "train")


def train_centroids(
    corpus: DataFrame,
    lists: int,
    steps: int = 5,
    vec: str = "f32",
    seed: str = "centroid",
    sample_rows: int | None = None,
) -> np.ndarray:
    """Spherical k-means from seeded rows, a fixed number of steps over all rows or a stated sample."""
    centroids = seed_centroids(corpus, lists, vec, seed)
    sample = train_sample(corpus, vec, sample_rows) if steps else None
    tasks = sample.rdd.getNumPartitions() if steps else 0
    few = tasks * centroids.nbytes <= broadcast_limit(corpus.sparkSession) // SUMS_SHARE
    for _ in range(steps):
        if few:
            centroids = gathered_step(sample, centroids, vec)
        else:
            centroids = updated_centroids(lloyd_step(sample, centroids, vec), centroids)
    return centroids


def train_kmeans(
    corpus: DataFrame, lists: int, vec: str = "f32", steps: int = 20, seed: int = 7, sample_rows: int | None = None
) -> np.ndarray:
    """Spherical k-means by Spark ML, for lists of better balance."""
    sample = train_sample(corpus, vec, sample_rows).select(array_to_vector(vec).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=steps, distanceMeasure="cosine", initSteps=2).fit(sample)
    return checked(corpus.sparkSession, np.array(model.clusterCenters()))


def train_code_centroids(
    codes: DataFrame,
    lists: int,
    nbits: int,
    steps: int = 1,
    vec: str = "code_sign",
    seed: str = "centroid",
    sample_rows: int | None = None,
) -> np.ndarray:
    """Code centroids: seeded rows, refined by a majority vote on every bit."""
    centroids = seed_centroids(codes, lists, vec, seed)
    sample = train_sample(codes, vec, sample_rows) if steps else None
    for _ in range(steps):
        centroids = majority_step(sample, centroids, nbits, vec)
    return centroids


def bit_votes(sample: DataFrame, centroids: np.ndarray, nbits: int, vec: str) -> DataFrame:
    """(list_id, n, d, votes): rows of a list, and how many of them set bit d."""
    shipped = sample.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = np.zeros((len(shipped.value), nbits), np.int64)
        rows = np.zeros(len(shipped.value), np.int64)
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0), np.int64)
            at = blockwise(x, shipped.value, metrics.Hamming, 1)[:, 0]
            bits = blocks.unpack_bits(x, nbits)
            for one in np.unique(at):
                votes[one] += bits[at == one].sum(axis=0, dtype=np.int64)
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held.astype(np.int32)),
                pa.array(rows[held]),
                blocks.write_vectors(votes[held], np.ones(len(held), bool), pa.int64()),
            ],
            names=["list_id", "n", "votes"],
        )

    partial = sample.select(vec).mapInArrow(run, "list_id int, n bigint, votes array<bigint>")
    return (
        partial.select("list_id", "n", F.posexplode("votes").alias("d", "v"))
        .groupBy("list_id", "d")
        .agg(F.sum("n").alias("n"), F.sum("v").alias("votes"))
    )


def majority_step(sample: DataFrame, centroids: np.ndarray, nbits: int, vec: str) -> np.ndarray:
    """A bit is set when at least half of its list sets it."""
    table = bit_votes(sample, centroids, nbits, vec).toArrow()
    bits = blocks.unpack_bits(centroids, nbits)
    set_bits = 2 * table.column("votes").to_numpy() >= table.column("n").to_numpy()
    bits[table.column("list_id").to_numpy(), table.column("d").to_numpy()] = set_bits
    return blocks.pack_bits(bits)


def ivf_build(corpus: DataFrame, centroids: np.ndarray, vec: str = "f32") -> IvfIndex:
    """Postings of ``corpus`` under ``centroids``: one narrow pass."""
    metric = "hamming" if vec.startswith("code_") else "cosine"
    list_id = nearest_list(corpus.sparkSession, F.col(vec), centroids, metric)
    return IvfIndex(centroids, metric, corpus.filter(F.col(vec).isNotNull()).withColumn("list_id", list_id))


def write_index(index: IvfIndex, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store an index; a long list is cut in several files written by several tasks."""
    spark = index.postings.sparkSession
    postings = index.postings
    pieces = postings.groupBy("list_id").count()
    pieces = pieces.select("list_id", F.ceil(F.col("count") / rows_per_file).alias("_pieces"))
    spread = postings.join(F.broadcast(pieces), "list_id").withColumn(
        "_piece", F.pmod(F.xxhash64("vec_id"), "_pieces")
    )
    spread.repartition("list_id", "_piece").drop("_pieces", "_piece").write.partitionBy("list_id").parquet(
        f"{path}/postings"
    )
    rows = [(i, c.tolist()) for i, c in enumerate(index.centroids)]
    element = "bigint" if index.metric == "hamming" else "double"
    spark.createDataFrame(rows, f"list_id int, centroid array<{element}>").write.parquet(f"{path}/centroids")


def read_index(spark: SparkSession, path: str) -> IvfIndex:
    table = spark.read.parquet(f"{path}/centroids")
    coded = dict(table.dtypes)["centroid"] == "array<bigint>"
    rows = table.toArrow().sort_by("list_id").column("centroid")
    centroids, _ = blocks.read_vectors(rows, np.int64 if coded else np.float64)
    return IvfIndex(centroids, "hamming" if coded else "cosine", spark.read.parquet(f"{path}/postings"))


class Probes(NamedTuple):
    """Which queries of a block look into a list."""

    by_list: dict[int, np.ndarray]

    def only(self, postings: DataFrame, lists: int) -> DataFrame:
        """Postings of probed lists; a literal filter prunes stored partitions."""
        if len(self.by_list) == lists:
            return postings
        return postings.filter(F.col("list_id").isin(sorted(self.by_list)))


def probe_lists(block: QueryBlock, index: IvfIndex, probes: int) -> Probes:
    q, measure = block.side(index.metric), metrics.metric_of(index.metric)
    if len(block.ids) == 0:
        return Probes({})
    lists = blockwise(q, index.centroids, measure, min(probes, len(index.centroids)))
    query, flat = np.repeat(np.arange(len(q)), lists.shape[1]), lists.ravel()
    return Probes({int(one): query[flat == one] for one in np.unique(flat)})


def by_list(list_ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(list, its row positions) within a batch."""
    order = np.argsort(list_ids, kind="stable")
    starts = np.flatnonzero(np.diff(list_ids[order], prepend=-1))
    for rows in np.split(order, starts[1:]) if len(order) else []:
        yield int(list_ids[rows[0]]), rows


def scan_probed(
    index: IvfIndex, block: QueryBlock, probes: Probes, k: int, vec: str, bound: np.ndarray | None = None
) -> DataFrame:
    """Per-task k best rows of the probed lists; rows beyond ``bound``, a distance per query, are not handed on."""
    measure, dtype = metrics.metric_of(index.metric), metrics.DTYPES[index.metric]
    shipped = index.postings.sparkSession.sparkContext.broadcast((block, probes.by_list, bound))

    index_metric, lists = index.metric, len(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, wanted, known = shipped.value
        q, state = local.side(index_metric), RunningTopK(len(local.ids), k)
        if known is not None:
            state.bound[:] = known
        everyone = np.arange(len(local.ids))
        meets = np.zeros((lists, len(everyone)), bool)
        for one, asking in wanted.items():
            meets[one, asking] = True
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(2), dtype)
            ids, at = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            if len(x) < ROWS_PER_STEP * len(np.unique(at)):
                # Rows of many lists mixed: one product for all, unmet pairs left out.
                some = meets[at].any(axis=1)
                score_block(x[some], ids[some], q, everyone, state, measure, meets[at[some]])
                continue
            for one, rows in by_list(at):
                if one in wanted:
                    score_block(x[rows], ids[rows], q, wanted[one], state, measure)
        yield hits_batch(state, local.ids)

    rows = probes.only(index.postings, len(index.centroids)).select("list_id", "vec_id", vec)
    return rows.filter(F.col(vec).isNotNull()).mapInArrow(run, HITS)


def ivf_knn(queries: DataFrame, index: IvfIndex, k: int, probes: int, vec: str = "f32") -> DataFrame:
    """k nearest rows within the ``probes`` nearest lists of every query."""

    def answer(block: QueryBlock) -> DataFrame:
        hits = scan_probed(index, block, probe_lists(block, index, probes), k, vec)
        return top_k(hits, k, salts=merge_salts(hits, len(block.ids)))

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")


def ivf_rerank(
    queries: DataFrame, index: IvfIndex, k: int, overfetch: int, probes: int, variant: str, precision: str
) -> DataFrame:
    """Candidates by code within probed lists, then order by ``precision``."""
    width = k * overfetch

    def answer(block: QueryBlock) -> DataFrame:
        probed = probe_lists(block, index, probes)
        hits = scan_probed(index, block, probed, width, f"code_{variant}")
        candidates = top_k(hits, width, salts=merge_salts(hits, len(block.ids))).select("qid", "vec_id")
        lists = probed.only(index.postings, len(index.centroids))
        return rerank(candidates, block, lists, k, precision, width)

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")


def code_bits(dim: int, variant: str) -> int:
    return dim * bits_per_dim(variant)
