"""Neighbour graphs as tables, and batch search over them.

Building compares rows in cells: the sources of a list are cut in slices of bounded
size, its targets in as many runs as the cluster needs cells.  A task holds a slice
and lets the run pass, so none ever holds a list, however large, and a source hands
on one row for every run.  Of a vector held by a crowd of rows only the first few
take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.operators import metrics
from nearfield.operators.cells import FOUND, nearest_of_cells
from nearfield.operators.ivf import nearest_lists
from nearfield.operators.knn import QueryBlock, per_block, scan_block, score_block
from nearfield.operators.rerank import CANDIDATE_BYTES, pair_distance, rerank
from nearfield.operators.topk import RunningTopK, top_k
from nearfield.session import broadcast_limit, cut_lineage
from nearfield.sources.vectors import gathered_sample

COPY_SALTS = 16
CELL_PARTITIONS = 2000
CELL_PAIRS = 1 << 25  # pairs that are worth a task, where there are enough tasks for the cluster
CELL_WAVES = 3  # tasks a core, so that uneven cells do not leave cores idle
PRUNE_ALPHA = 1.2
HELD_SHARE = 4  # part of the broadcast limit that a beam on the driver may take


def _hinted(rows: DataFrame, bound: int) -> DataFrame:
    fits = bound * CANDIDATE_BYTES <= broadcast_limit(rows.sparkSession)
    return F.broadcast(rows) if fits else rows


def _content(vec: str) -> list[Column]:
    """Two independent 64-bit hashes: together they identify a vector."""
    return [F.xxhash64(vec).alias("_h1"), F.xxhash64(F.lit("second"), F.col(vec)).alias("_h2")]


def crowds(corpus: DataFrame, vec: str, copies: int) -> DataFrame:
    """(_h1, _h2, first, last): vectors held by more than ``copies`` rows.

    Copies of a vector are equally far from everything and the lower id wins, so
    only the first ``copies`` of them can be one of ``copies - 1`` neighbours, and
    all of them share the neighbours of the first.  ``last`` is the highest id
    that can.  Only ids and hashes are shuffled, and no group is gathered.
    """
    ranked = top_k(corpus.select("vec_id", *_content(vec)), copies + 1, key=("_h1", "_h2"), order=("vec_id",))
    found = ranked.groupBy("_h1", "_h2").agg(
        F.min("vec_id").alias("first"),
        F.max(F.when(F.col("rk") == copies, F.col("vec_id"))).alias("last"),
        F.max("rk").alias("held"),
    )
    return cut_lineage(found.filter(F.col("held") > copies).drop("held"))


def _roles(corpus: DataFrame, vec: str, crowd: DataFrame, crowd_rows: int) -> DataFrame:
    """(vec_id, vec, is_target, is_source): rows that can be a neighbour, or that neighbours are to be found for."""
    rows = corpus.select("vec_id", F.col(vec).alias("vec"))
    if crowd_rows == 0:
        return rows.select("vec_id", "vec", F.lit(True).alias("is_target"), F.lit(True).alias("is_source"))
    placed = rows.withColumns({"_h1": _content("vec")[0], "_h2": _content("vec")[1]}).join(
        _hinted(crowd, crowd_rows), ["_h1", "_h2"], "left"
    )
    alone = F.col("first").isNull()
    target, source = (alone | (F.col("vec_id") <= F.col("last"))), (alone | (F.col("vec_id") == F.col("first")))
    return placed.filter(target | source).select("vec_id", "vec", target.alias("is_target"), source.alias("is_source"))


def _sides(corpus: DataFrame, vec: str, crowd: DataFrame, crowd_rows: int) -> tuple[DataFrame, DataFrame]:
    """(targets, sources): rows that can be a neighbour, rows to find neighbours for."""
    rows = _roles(corpus, vec, crowd, crowd_rows)
    return tuple(rows.filter(role).select("vec_id", "vec") for role in ("is_target", "is_source"))


def _cell_edge(lists: pa.Table) -> int:
    """Sources of a cell: as many as fit, as every slice more repeats the targets.

    Few rows are dealt to enough cells for the cluster, four times as long as wide, as each run
    of targets finds its thresholds anew.
    """
    pairs = pc.sum(pc.multiply(pc.cast(lists["s"], "double"), pc.cast(lists["t"], "double"))).as_py() or 0.0
    wanted = int((pairs / settings.CELLS_LEAST) ** 0.5 / 2)
    return min(_fitting(lists), settings.CELL_ROWS_MOST, max(wanted, settings.CELL_ROWS))


def _fitting(lists: pa.Table) -> int:
    return max(1, settings.CELL_BYTES // max(1, 8 * (pc.max(lists["width"]).as_py() or 1)))


def _cell_sizes(lists: pa.Table, edge: int) -> list[tuple[int, int, int, int]]:
    """(list_id, s, t, first): slices of sources and runs of targets of every list, and its first cell.

    A list has few runs, as each more hands on k results a source; cells are near equal
    in pairs and there are enough of them for the cluster.
    """
    pairs = sum(row["s"] * row["t"] for row in lists.to_pylist()) or 1
    sizes, first = [], 0
    for row in lists.sort_by("list_id").to_pylist():
        s = -(-row["s"] // edge)
        of_cell = min(row["s"], edge) * row["t"]
        t = max(1, min(-(-row["t"] // edge), -(-of_cell * settings.CELLS_LEAST // pairs)))
        sizes.append((row["list_id"], s, t, first))
        first += s * t
    return sizes


def _cell_tasks(spark: SparkSession, lists: pa.Table, sizes: list[tuple[int, int, int, int]]) -> int:
    """Tasks for the cells: one each, but small cells share one, as many as the cluster can use."""
    pairs = sum(row["s"] * row["t"] for row in lists.to_pylist())
    wanted = max(CELL_WAVES * spark.sparkContext.defaultParallelism, -(-pairs // CELL_PAIRS))
    return min(sum(s * t for _, s, t, _ in sizes), wanted, CELL_PARTITIONS)


def _sliced(rows: DataFrame, sizes: list[tuple[int, int, int, int]]) -> DataFrame:
    """(cell, is_target, vec_id, vec): a source once for every run, a target once for every slice."""
    names = ("list_id", "s", "t", "first")
    if len(sizes) == 1:
        placed = rows.filter(F.col("list_id") == sizes[0][0]).withColumns({n: F.lit(x) for n, x in zip(names, sizes[0], strict=True)})
    else:
        columns = {name: pa.array(column, pa.int32()) for name, column in zip(names, zip(*sizes, strict=True), strict=True)}
        placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table(columns))), "list_id")

    def side(own: str, other: str) -> Column:
        """Cells of a row: its own slice or run by all of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), own).cast("int")
        place = (lambda i: mine * F.col("t") + i) if own == "s" else (lambda i: i * F.col("t") + mine)
        return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.col("first") + place(i))

    cells = F.when(F.col("is_target"), side("t", "s")).otherwise(side("s", "t"))
    return placed.select(F.explode(cells).alias("cell"), "is_target", "vec_id", "vec")


def _placed(rows: DataFrame) -> DataFrame:
    """(list_id, is_target, vec_id, vec): a row once for the list that holds it and once for each that it looks into."""
    place = lambda one, is_target: F.struct(one.alias("list_id"), F.lit(is_target).alias("is_target"))
    none = F.array().cast("array<struct<list_id:int,is_target:boolean>>")
    held = F.when(F.col("is_target"), F.array(place(F.col("own"), True))).otherwise(none)
    asked = F.when(F.col("is_source"), F.transform("lists", lambda one: place(one, False))).otherwise(none)
    return rows.select(F.explode(F.concat(held, asked)).alias("at"), "vec_id", "vec").select("at.*", "vec_id", "vec")


def cell_top_k(rows: DataFrame, k: int, metric: str, cell_rows: int | None = None) -> DataFrame:
    """(src, nbrs): k best targets of every source among its lists, nearest first.

    ``rows`` carry (vec_id, vec, is_target, is_source, own, lists): the list that holds a
    target, and the lists that a source looks into.
    """
    placed = _placed(rows)
    totals = [F.count_if(~F.col("is_target")).alias("s"), F.count_if("is_target").alias("t"), F.max(F.size("vec")).alias("width")]
    # One row per list; the number of lists is a parameter of the build.
    lists = placed.groupBy("list_id").agg(*totals).filter((F.col("s") > 0) & (F.col("t") > 0)).toArrow()
    edge = cell_rows or _cell_edge(lists)
    sizes = _cell_sizes(lists, edge)
    if not sizes:
        return rows.sparkSession.createDataFrame([], FOUND)
    cells = _sliced(placed, sizes)
    # They are not put together again by bytes, as time goes by pairs.
    count = _cell_tasks(rows.sparkSession, lists, sizes)
    cells = cells.repartitionById(count, F.pmod("cell", F.lit(count)))
    cells = cells.sortWithinPartitions("cell", "is_target", "vec_id")
    chunk = cell_rows or min(_fitting(lists), settings.CELL_ROWS_MOST)
    found = cells.mapInArrow(lambda batches: nearest_of_cells(batches, k, metric, chunk), FOUND)
    # Lists are disjoint, so a pair meets in one cell only.
    merged = found.groupBy("src").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"))
    return merged.select("src", F.slice(F.sort_array("nbrs"), 1, k).alias("nbrs"))


def _without_self(nbrs: Column, own: Column, degree: int) -> Column:
    return F.slice(F.filter(nbrs, lambda n: n["dst"] != own), 1, degree)


def knn_graph(
    corpus: DataFrame,
    degree: int,
    vec: str = "f32",
    centroids: np.ndarray | None = None,
    probes: int = 1,
    cell_rows: int | None = None,
) -> DataFrame:
    """(vec_id, nbrs): the ``degree`` nearest other rows, nearest first.

    With ``centroids`` a row looks into its ``probes`` nearest lists; without,
    into the whole corpus, which is exact and quadratic.
    """
    spark = corpus.sparkSession
    metric = "hamming" if vec.startswith("code_") else "cosine"
    corpus = corpus.filter(F.col(vec).isNotNull())
    crowd = crowds(corpus, vec, degree + 1)
    crowd_rows = crowd.count()
    rows = _roles(corpus, vec, crowd, crowd_rows)
    if centroids is None:
        rows = rows.withColumns({"own": F.lit(0), "lists": F.array(F.lit(0))})
    else:
        # The nearest of the lists that a row looks into is the one that holds it.
        rows = rows.withColumn("lists", nearest_lists(spark, F.col("vec"), centroids, probes, metric))
        rows = rows.withColumn("own", F.col("lists")[0])
    found = cell_top_k(rows, degree + 1, metric, cell_rows).withColumnRenamed("src", "vec_id")
    if crowd_rows:
        found = _with_copies(corpus, crowd, cut_lineage(found), vec)
    return found.select("vec_id", _without_self(F.col("nbrs"), F.col("vec_id"), degree).alias("nbrs"))


def _with_copies(corpus: DataFrame, crowd: DataFrame, found: DataFrame, vec: str) -> DataFrame:
    """Give every copy of a crowd the neighbours found for its first row.

    A crowd may be a third of the table, so the join is spread over salts and no
    task holds a crowd.  It moves ids and hashes, not vectors.
    """
    lists = crowd.join(found.withColumnRenamed("vec_id", "first"), "first").select(
        "_h1", "_h2", "nbrs", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("_salt")
    )
    salted = corpus.select(
        "vec_id", *_content(vec), F.pmod(F.xxhash64("vec_id"), F.lit(COPY_SALTS)).cast("int").alias("_salt")
    )
    copies = salted.join(lists, ["_h1", "_h2", "_salt"]).select("vec_id", "nbrs")
    alone = found.join(crowd.select(F.col("first").alias("vec_id")), "vec_id", "left_anti")
    return alone.unionByName(copies)


def edges(graph: DataFrame) -> DataFrame:
    """(src, dst, rk, dist) rows of a graph."""
    return graph.select(F.col("vec_id").alias("src"), F.posexplode("nbrs").alias("pos", "n")).select(
        "src", F.col("n.dst").alias("dst"), (F.col("pos") + 1).alias("rk"), F.col("n.dist").alias("dist")
    )


def undirected(graph: DataFrame, max_degree: int) -> DataFrame:
    """(vec_id, nbrs): edges usable both ways, the ``max_degree`` nearest kept.

    A row that is near to many others would collect them all; the degree bound
    is part of the graph's definition and is applied before any row is gathered.
    """
    ways = F.array(
        F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    both = edges(graph).select(F.explode(ways).alias("way"), "dist").select("way.src", "way.dst", "dist")
    return _nearest_links(both, max_degree)


def pruned_rows(dist: np.ndarray, x: np.ndarray, alpha: float, degree: int) -> list[int]:
    """Positions kept when each neighbour drops those it covers ``alpha`` times closer."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    between = 1.0 - (x @ x.T) / np.outer(norms, norms)
    alive, kept = np.ones(len(dist), bool), []
    for i in range(len(dist)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > dist
    return kept


def _with_vectors(graph: DataFrame, corpus: DataFrame, vec: str) -> DataFrame:
    """(src, n): every row's links with their vectors; the lists are bounded."""
    ends = corpus.select(F.col("vec_id").alias("dst"), F.col(vec).alias("vec"))
    return (
        edges(graph)
        .join(ends, "dst")
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "vec"))).alias("n"))
    )


def prune(graph: DataFrame, corpus: DataFrame, degree: int, alpha: float = PRUNE_ALPHA, vec: str = "f32") -> DataFrame:
    """(vec_id, nbrs): fewer, more spread edges (the pruning rule of DiskANN).

    The lists of ``graph`` are bounded, so a row carries its neighbours' vectors.
    """

    @F.arrow_udf("array<int>")
    def kept(dists: pa.Array, vectors: pa.Array) -> pa.Array:
        ends = np.cumsum([len(d) for d in dists])
        flat, x = dists.flatten().to_numpy(), blocks.read_vectors(vectors.flatten())[0]
        starts = np.concatenate([[0], ends[:-1]])
        return pa.array(
            [pruned_rows(flat[a:b], x[a:b], alpha, degree) for a, b in zip(starts, ends, strict=True)],
            pa.list_(pa.int32()),
        )

    listed = _with_vectors(graph, corpus, vec)
    chosen = listed.withColumn("keep", kept(F.col("n.dist"), F.col("n.vec")))
    link = lambda i: F.struct(F.col("n")[i]["dist"].alias("dist"), F.col("n")[i]["dst"].alias("dst"))
    return chosen.select(F.col("src").alias("vec_id"), F.transform("keep", link).alias("nbrs"))


def two_sided(
    graph: DataFrame, corpus: DataFrame, degree: int, candidates: int, alpha: float = PRUNE_ALPHA, vec: str = "f32"
) -> DataFrame:
    """(vec_id, nbrs): at most ``degree`` spread edges, chosen from the links to a row as well as its own.

    Links both ways are the candidates of the pruning rule, ``candidates`` of them at
    most, so that the rule, not nearness, bounds the degree.
    """
    return prune(undirected(graph, candidates), corpus, degree, alpha, vec)


def refine(graph: DataFrame, corpus: DataFrame, degree: int, vec: str = "f32") -> DataFrame:
    """(vec_id, nbrs) after one round of NN-Descent: neighbours meet each other.

    The rows linked to one row are compared in place, and each hands on only its
    ``degree`` best of them, so pairs are never rows.
    """
    metric = "hamming" if vec.startswith("code_") else "cosine"
    measure, dtype = metrics.metric_of(metric), metrics.DTYPES[metric]

    def links(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (src, dst, dist)], names=["src", "dst", "dist"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ids, known = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            yield links(np.repeat(batch.column(0).to_numpy(), lengths), ids, known)
            x, _ = blocks.read_vectors(batch.column(3).flatten(), dtype)
            ends = np.cumsum(lengths)
            for start, end in zip(ends - lengths, ends, strict=True):
                here, own = np.arange(end - start), ids[start:end]
                state = RunningTopK(len(here), degree)
                part = x[start:end]
                score_block(part, own, part, here, state, measure, here[:, None] != here[None, :])
                state.settle()
                yield links(own[state.query], state.ids, state.dist)

    listed = _with_vectors(graph, corpus, vec).select("src", "n.dst", "n.dist", "n.vec")
    return _nearest_links(listed.mapInArrow(meet, "src bigint, dst bigint, dist double"), degree)


def _nearest_links(links: DataFrame, degree: int) -> DataFrame:
    """(vec_id, nbrs): the ``degree`` nearest distinct ends of every row.

    The links of a hub are spread over the tasks that find the distinct ones, each of which hands on ``degree`` of them.
    """
    once = links.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    kept = top_k(once, degree, key="src", order=("dist", "dst"))
    return kept.groupBy(F.col("src").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("nbrs")
    )


def nodes(graph: DataFrame, corpus: DataFrame, *columns: str) -> DataFrame:
    """(vec_id, nbr_ids, columns): a graph stored beside the vectors it links."""
    return corpus.select("vec_id", *columns).join(
        graph.select("vec_id", F.col("nbrs.dst").alias("nbr_ids")), "vec_id"
    )


def beam(
    block: QueryBlock,
    table: DataFrame,
    ef: int,
    hops: int,
    entries: int,
    vec: str,
    max_degree: int,
    seed: str = "entry",
) -> DataFrame:
    """(qid, rk, vec_id, dist): the ``ef`` best rows met within ``hops`` expansions.

    Each hop is one scan of ``table`` that answers all queries: rows new to a
    query's beam are looked up once, scored, and carry their own links for the
    next hop.  The beam is bounded by queries x ef.  Where all that a hop can hand
    on is small it stays on the driver, as the queries do, and a hop is a single
    job; else it is a table that is written out per hop.
    """
    everything = table.select("vec_id", vec, "nbr_ids")
    # As many rows as there are entry points: a fixed parameter of the search.
    start = gathered_sample(everything, entries, seed)
    met = len(block.ids) * ef * max_degree
    if met * (CANDIDATE_BYTES + 8 * max_degree) <= broadcast_limit(table.sparkSession) // HELD_SHARE:
        return _held_beam(block, everything, start, ef, hops, vec)
    return _stored_beam(block, everything, start, ef, hops, vec, met)


class _Held(NamedTuple):
    """Rows of a beam: query, row, distance, links, and whether those were followed."""

    query: np.ndarray
    ids: np.ndarray
    dist: np.ndarray
    links: pa.Array
    expanded: np.ndarray

    def best(self, ef: int) -> "_Held":
        """The ``ef`` nearest rows of every query, nearest first."""
        order = np.lexsort((self.ids, self.dist, self.query))
        own = self.query[order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own, "left") < ef]
        query, ids, dist, expanded = (column[order] for column in (self.query, self.ids, self.dist, self.expanded))
        return _Held(query, ids, dist, self.links.take(pa.array(order)), expanded)

    def unmet(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that the unfollowed links lead to and the beam does not hold."""
        ahead = np.flatnonzero(~self.expanded)
        links = self.links.take(pa.array(ahead))
        lengths = pc.fill_null(pc.list_value_length(links), 0).to_numpy()
        query = np.concatenate([self.query, np.repeat(self.query[ahead], lengths)])
        ids = np.concatenate([self.ids, links.flatten().drop_null().to_numpy()])
        fresh = np.arange(len(query)) >= len(self.query)
        order = np.lexsort((fresh, ids, query))
        query, ids, fresh = query[order], ids[order], fresh[order]
        first = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
        return query[first & fresh], ids[first & fresh]


def _entry_points(start: pa.Table, block: QueryBlock, ef: int, vec: str, metric: str) -> _Held:
    """The ``ef`` best entry points of every query."""
    start = start.filter(start.column(vec).is_valid()).combine_chunks()
    x, _ = blocks.read_vectors(start.column(vec), metrics.DTYPES[metric])
    state, everyone = RunningTopK(len(block.ids), ef), np.arange(len(block.ids))
    score_block(x, np.arange(len(x)), block.side(metric), everyone, state, metrics.metric_of(metric))
    state.settle()
    ids = start.column("vec_id").to_numpy()[state.ids]
    links = start.column("nbr_ids").combine_chunks().take(pa.array(state.ids))
    return _Held(block.ids[state.query], ids, state.dist, links, np.zeros(len(ids), bool))


def _held_beam(
    block: QueryBlock, everything: DataFrame, start: pa.Table, ef: int, hops: int, vec: str
) -> DataFrame:
    spark = everything.sparkSession
    metric = "hamming" if vec.startswith("code_") else "cosine"
    distance = pair_distance(spark, block, metric)
    state = _entry_points(start, block, ef, vec, metric).best(ef)
    for _ in range(hops):
        query, ids = state.unmet()
        if not len(ids):
            break
        fresh = spark.createDataFrame(pa.table({"qid": query, "vec_id": ids}))
        scored = everything.join(F.broadcast(fresh), "vec_id").select("qid", "vec_id", distance("qid", vec), "nbr_ids")
        query, ids, dist, links = (column.combine_chunks() for column in scored.toArrow().columns)
        known = state._replace(expanded=np.ones(len(state.ids), bool))
        found = _Held(query.to_numpy(), ids.to_numpy(), dist.to_numpy(), links, np.zeros(len(ids), bool))
        joined = [np.concatenate(pair) for pair in zip(known[:3], found[:3], strict=True)]
        links = pa.concat_arrays([known.links.cast(found.links.type), found.links])
        state = _Held(*joined, links, np.concatenate([known.expanded, found.expanded])).best(ef)
    rk = np.arange(len(state.ids)) - np.searchsorted(state.query, state.query, "left") + 1
    columns = {"qid": state.query, "rk": rk.astype(np.int32), "vec_id": state.ids, "dist": state.dist}
    return spark.createDataFrame(pa.table(columns))


def _stored_beam(
    block: QueryBlock, everything: DataFrame, start: pa.Table, ef: int, hops: int, vec: str, met_most: int
) -> DataFrame:
    spark = everything.sparkSession
    metric = "hamming" if vec.startswith("code_") else "cosine"
    distance = pair_distance(spark, block, metric)
    start = spark.createDataFrame(start)
    first = top_k(scan_block(start, block, ef, vec, metric), ef)
    linked = first.join(F.broadcast(start.select("vec_id", "nbr_ids")), "vec_id")
    state = cut_lineage(linked.select("qid", "rk", "vec_id", "dist", "nbr_ids", F.lit(False).alias("expanded")))
    for _ in range(hops):
        links = state.filter(~F.col("expanded")).select("qid", F.explode("nbr_ids").alias("vec_id"))
        met = links.withColumn("known", F.lit(False)).unionByName(
            state.select("qid", "vec_id", F.lit(True).alias("known"))
        )
        fresh = met.groupBy("qid", "vec_id").agg(F.bool_or("known").alias("known")).filter(~F.col("known"))
        fresh = fresh.select("qid", "vec_id")
        found = everything.join(_hinted(fresh, met_most), "vec_id")
        scored = found.select(
            "qid", "vec_id", distance("qid", vec).alias("dist"), "nbr_ids", F.lit(False).alias("expanded")
        )
        known = state.drop("rk").withColumn("expanded", F.lit(True))
        state = cut_lineage(top_k(known.unionByName(scored), ef))
    return state.select("qid", "rk", "vec_id", "dist")


def graph_knn(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    ef: int,
    hops: int,
    entries: int = 20,
    vec: str = "f32",
    max_degree: int = 64,
) -> DataFrame:
    """k nearest rows met by a beam search over the links of ``table``."""

    def answer(block: QueryBlock) -> DataFrame:
        return beam(block, table, ef, hops, entries, vec, max_degree).filter(F.col("rk") <= k)

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")


def graph_rerank(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    overfetch: int,
    variant: str,
    precision: str,
    hops: int,
    entries: int = 20,
    max_degree: int = 64,
) -> DataFrame:
    """Beam search over a code graph, then order by ``precision``."""
    width = k * overfetch

    def answer(block: QueryBlock) -> DataFrame:
        met = beam(block, table, width, hops, entries, f"code_{variant}", max_degree)
        return rerank(met.select("qid", "vec_id"), block, table, k, precision, width)

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")
