"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors becomes a neighbour graph, the graph is cut into
balanced parts, and a small classifier learns from each sampled vector in which
parts its neighbours lie.  The classifier then files every vector of the table
under its most probable part, and sends a query to as many of its most probable
parts as the sample needed to find ``coverage`` of the neighbours.  Within those
parts every vector is compared, by inner product in double precision.

Equal vectors are one class in the index, with its ``k + 1`` smallest ids, which
are all of a class that can be in an answer.  A part is scored in cells of at
most about ``CELL_ROWS`` vectors and as many queries, so a part of any size is
split, and a cell hands on ``k + 1`` classes per query.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part,
neither as rows nor as queries; nor do rows without an id.  Rows of one id and
vector are one row.  All vectors must share one width.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.neardup import with_keys
from nearfield.operators.knn import score_block
from nearfield.operators.metrics import NegatedDot
from nearfield.operators.topk import RunningTopK
from nearfield.session import materialise

SAMPLE_ROWS = 8192  # rows that the graph, the parts and the classifier are learned from
PART_ROWS = 2048  # rows of the table per part
MOST_PARTS = 256
GRAPH_DEGREE = 16
COVERAGE = 0.95
HIDDEN = 128
EPOCHS = 30
CELL_ROWS = 4096


class Router(NamedTuple):
    """One hidden layer; the probability of each part."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x * self.scale @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Ids of the ``degree`` rows of largest inner product with each row, itself left out."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), max(degree, 0)), np.int64)
    for first in range(0, len(x) if degree > 0 else 0, 1024):
        near = x[first : first + 1024] @ x.T
        near[np.arange(len(near)), np.arange(first, first + len(near))] = -np.inf
        out[first : first + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def bisect(x: np.ndarray, edges: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two halves of equal size with few edges between: a cut at the median of the
    widest direction, then swaps of the rows that gain most, as many from each half."""
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred[:: max(1, len(x) // 2048)], full_matrices=False)
    side = np.zeros(len(x), bool)
    side[np.argsort(centred @ axes[0], kind="stable")[len(x) // 2 :]] = True
    for _ in range(rounds):
        across = side[edges[:, 0]] != side[edges[:, 1]]
        gain = np.zeros(len(x))
        for end in (0, 1):
            gain += np.bincount(edges[:, end], np.where(across, 1.0, -1.0), len(x))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        good = gain[left[:n]] + gain[right[:n]] > 0
        many = int(good.sum()) // 2  # half of them, as swapped neighbours change each other's gain
        if not many:
            break
        side[left[:many]], side[right[:many]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row: halves of halves, ``parts`` being a power of two."""
    part = np.zeros(len(x), np.int64)
    pairs = np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], axis=1)
    count = 1
    while count < parts:
        cut = part.copy()
        for p in range(count):
            rows = np.flatnonzero(part == p)
            if len(rows) < 2:
                cut[rows] = 2 * p
                continue
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            edges = place[pairs]
            cut[rows] = 2 * p + bisect(x[rows], edges[(edges >= 0).all(axis=1)])
        part, count = cut, 2 * count
    return part


def learn(x: np.ndarray, parts: int, coverage: float = COVERAGE, seed: int = 7) -> Router:
    """Graph, parts and classifier of a sample; ``probes`` is what ``coverage`` takes on it."""
    rng = np.random.default_rng(seed)
    width, n = x.shape[1], len(x)
    scale = 1 / max(1e-12, float(np.sqrt((x * x).sum() / max(1, x.size))))
    w1, w2 = rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts))
    b1, b2 = np.zeros(HIDDEN), np.zeros(parts)
    if parts == 1 or n < 2 * parts:
        return Router(scale, w1, b1, w2, b2, parts)
    graph = neighbour_graph(x, GRAPH_DEGREE)
    part = balanced_parts(x, graph, parts)
    # The target of a row is where it and its neighbours lie.
    want = np.zeros((n, parts))
    np.add.at(want, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    want[np.arange(n), part] += 1
    want /= want.sum(axis=1, keepdims=True)
    kept_out = rng.random(n) < 0.2
    inside = np.flatnonzero(~kept_out)
    values, step = [w1, b1, w2, b2], 0
    m, v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    for _ in range(EPOCHS):
        rng.shuffle(inside)
        for first in range(0, len(inside), 256):
            rows, step = inside[first : first + 256], step + 1
            xs = x[rows] * scale
            h = np.maximum(xs @ w1 + b1, 0)
            z = h @ w2 + b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - want[rows]) / len(rows)
            dh = (d @ w2.T) * (h > 0)
            for p, a, b, g in zip(values, m, v, (xs.T @ dh, dh.sum(0), h.T @ d, d.sum(0)), strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    router = Router(scale, *values, parts)
    # Rows are filed by the classifier; count how deep held-out rows find their neighbours.
    filed = router.probabilities(x).argmax(axis=1)
    asked = np.flatnonzero(kept_out)
    rank = np.argsort(np.argsort(-router.probabilities(x[asked]), axis=1), axis=1)
    depth = np.take_along_axis(rank, filed[graph[asked]], axis=1)
    found = np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / max(1, depth.size)
    return router._replace(probes=min(parts, int(np.searchsorted(found, coverage)) + 1))


class Index(NamedTuple):
    """``rows``: (vkey, part, first, ids, v), one row per class; ``counts``: classes per part."""

    router: Router
    rows: DataFrame
    counts: np.ndarray


def parts_for(classes: int) -> int:
    """A power of two that keeps about ``PART_ROWS`` rows in a part."""
    return 1 << max(0, min(MOST_PARTS.bit_length() - 1, round(np.log2(max(1, classes) / PART_ROWS))))


def build(keyed: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index every row of ``keyed`` (vec_id, vkey, v)."""
    spark = keyed.sparkSession
    one = keyed.filter("vkey IS NOT NULL AND vec_id IS NOT NULL")
    # The smallest ids of a class: the rank filter is applied before the shuffle too.
    place = F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))
    first = one.groupBy("vkey", "vec_id").agg(F.lit(1).alias("_")).withColumn("rk", place).filter(F.col("rk") <= k + 1)
    ids = first.groupBy("vkey").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = one.groupBy("vkey").agg(F.first("v").alias("v")).join(ids, "vkey")
    classes = materialise(classes.withColumn("first", F.element_at("ids", 1)), "classes")
    sample = classes.orderBy(F.xxhash64("vkey"), "vkey").limit(sample_rows).select("vkey", "v").toArrow().sort_by("vkey")
    many = sample.num_rows
    x = np.asarray(sample.column("v").combine_chunks().flatten()).reshape(many, -1) if many else np.zeros((0, 1))
    router = learn(x, parts_for(classes.count()))
    shipped = spark.sparkContext.broadcast(router)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            part = model.probabilities(np.asarray(v.flatten()).reshape(len(v), -1)).argmax(axis=1) if len(v) else []
            yield batch.append_column("part", pa.array(part, pa.int32()))

    filed = classes.select("vkey", "first", "ids", "v")
    rows = materialise(filed.mapInArrow(run, "vkey string, first bigint, ids array<bigint>, v array<double>, part int"), "index")
    counts = np.zeros(router.b2.shape[0], np.int64)
    for row in rows.groupBy("part").count().collect():  # one row per part
        counts[row["part"]] = row["count"]
    return Index(router, rows, counts)


FOUND = "qkey string, first bigint, vkey string, dist double"


def search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(qkey, vkey, score): the ``k + 1`` best classes found for each query class of ``asked`` (qkey, v)."""
    spark, parts = asked.sparkSession, len(index.counts)
    shipped = spark.sparkContext.broadcast((index.router, index.counts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = shipped.value
        for batch in batches:
            v = batch.column(1)
            p = model.probabilities(np.asarray(v.flatten()).reshape(len(v), -1)) if len(v) else np.zeros((0, parts))
            best = np.argsort(-p, axis=1, kind="stable")[:, : model.probes].astype(np.int32)
            lists = pa.array(list(best), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, lists], names=["qkey", "v", "parts"])

    routed = asked.select("qkey", "v").mapInArrow(route, "qkey string, v array<double>, parts array<int>")
    routed = materialise(routed.select("qkey", "v", F.posexplode("parts").alias("turn", "part")), "routed")
    best = Window.partitionBy("qkey").orderBy("dist", "first", "vkey")
    ranked = lambda found: found.withColumn("rk", F.row_number().over(best))
    # The most probable part first: no later part hands on what is worse than its k + 1 best.
    near = routed.filter("turn = 0").withColumn("bound", F.lit(None).cast("double"))
    near = materialise(_cells(index, near, k), "nearest_part")
    bound = ranked(near).filter(F.col("rk") == k + 1).select("qkey", F.col("dist").alias("bound"))
    found = near.unionByName(_cells(index, routed.filter("turn > 0").join(bound, "qkey", "left"), k))
    return ranked(found).filter(F.col("rk") <= k + 1).select("qkey", "vkey", (-F.col("dist")).alias("score"))


def _cells(index: Index, routed: DataFrame, k: int) -> DataFrame:
    """What the cells of each part find for the queries (qkey, v, part, bound) sent there."""
    parts = len(index.counts)
    asks = np.zeros(parts, np.int64)
    for row in routed.groupBy("part").count().collect():
        asks[row["part"]] = row["count"]
    row_cells = F.array(*(F.lit(int(max(1, -(-c // CELL_ROWS)))) for c in index.counts))
    ask_cells = F.array(*(F.lit(int(max(1, -(-c // CELL_ROWS)))) for c in asks))

    def cell(df: DataFrame, key: str, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.element_at(own, F.col("part") + 1)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.element_at(other, F.col("part") + 1) - 1))
        return df.withColumn(names[0], mine).withColumn(names[1], each)

    rows = cell(index.rows.select("part", "vkey", "first", "v"), "vkey", row_cells, ask_cells, ("r", "q"))
    asking = cell(routed, "qkey", ask_cells, row_cells, ("q", "r"))
    both = rows.select("part", "r", "q", F.lit(False).alias("asks"), "vkey", "first", F.lit(None).cast("double").alias("bound"), "v").unionByName(
        asking.select("part", "r", "q", F.lit(True).alias("asks"), F.col("qkey").alias("vkey"), F.lit(None).cast("bigint").alias("first"), "bound", "v")
    )

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        queries, held = np.flatnonzero(asks), np.flatnonzero(~asks)
        names = table.column("vkey").combine_chunks()
        first = np.asarray(table.column("first").combine_chunks().fill_null(0))
        held = held[np.argsort(first[held], kind="stable")]  # ties go to the smaller id
        state = RunningTopK(len(queries), k + 1)
        state.bound[:] = np.asarray(table.column("bound").combine_chunks().fill_null(np.inf))[queries]
        score_block(v[held], np.arange(len(held)), v[queries], np.arange(len(queries)), state, NegatedDot)
        state.settle()
        at = held[state.ids]
        return pa.table({"qkey": names.take(queries[state.query]), "first": first[at], "vkey": names.take(at), "dist": state.dist})

    return both.groupBy("part", "r", "q").applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, asks: Column, k: int = 20, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``asks`` holds for."""
    keyed = materialise(with_keys(vectors, (), vec), "vectors")
    index = build(keyed, k)
    members = keyed.filter(asks & F.col("vkey").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey")).distinct()
    asked = index.rows.join(members.select(F.col("qkey").alias("vkey")).distinct(), "vkey", "left_semi")
    hits = materialise(search(index, asked.select(F.col("vkey").alias("qkey"), "v"), k), "hits")
    near = hits.join(index.rows.select("vkey", "ids"), "vkey").select("qkey", "score", F.explode("ids").alias("vec_id"))
    # Of a query class, the k + 1 nearest rows; each member then leaves itself out.
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k + 1).drop("rk")
    lists = near.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))).alias("near"))
    each = members.join(lists, "qkey")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.d")).alias("score"))
