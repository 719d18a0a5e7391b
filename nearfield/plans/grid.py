"""The benchmark matrix as data, and a job that runs its cells."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions.codes import bits_per_dim
from nearfield.functions.rules import code_storage_mb, vector_storage_mb
from nearfield.operators import graph, ivf, knn, rabitq, rerank
from nearfield.operators.evaluate import mean_recall
from nearfield.operators.prep import as_queries, fit_thresholds, represent
from nearfield.session import cut_lineage, materialise, release
from nearfield.sources.tables import index_size

# Precisions of each method over floats, and the coded methods.
FLOAT_METHODS = {
    "rabitq": ["f32", "f16"],
    "ivf": ["f32", "f16"],
    "graph_pruned": ["f32"],
    "graph": ["f32", "f16"],
    "exact": ["f32", "f16"],
}
CODE_METHODS = ["graph_rerank", "ivf_rerank", "exact_rerank"]
CODE_VARIANTS = ["mean", "thermo8", "thermo4"]
STORAGE = {"f32": "float32", "f16": "float16"}
CELL_KEYS = [("dimension", "int"), ("storage", "string"), ("method", "string"), ("variant", "string")]
RESULTS = (
    "dimension int, storage string, method string, variant string, build_time_s double, index_bytes bigint, "
    "storage_mb double, latency_s double, recall double, status string"
)


class Profile(NamedTuple):
    """Search parameters of a run."""

    k: int = settings.K
    overfetch: int = settings.OVERFETCH
    lists: int = settings.IVF_LISTS
    probes: int = settings.IVF_PROBES
    probes_codes: int = settings.IVF_PROBES_CODES
    rabitq_lists: int = settings.RABITQ_LISTS
    rabitq_probes: int = settings.RABITQ_PROBES
    epsilon: float = settings.RABITQ_EPSILON
    degree: int = settings.GRAPH_DEGREE
    ef: int = settings.GRAPH_SEARCH_WIDTH_MAX
    hops: int = 4
    steps: int = 5


def config_grid(corpus: DataFrame, dims: list[int]) -> DataFrame:
    """Every cell of the matrix with its estimated float and code storage."""
    spark = corpus.sparkSession
    cells = [(m, p, None, 0) for m, ps in FLOAT_METHODS.items() for p in ps]
    cells += [(m, p, v, bits_per_dim(v)) for m in CODE_METHODS for v in CODE_VARIANTS for p in STORAGE]
    rows = [(d, *cell) for d in dims for cell in cells]
    grid = spark.createDataFrame(rows, "dimension int, method string, precision string, variant string, bits int")
    held = corpus.agg(F.count("embedding")).first()[0]
    n = F.lit(held).cast("bigint")
    storage = F.when(F.col("precision") == "f32", "float32").otherwise("float16")
    return grid.select(
        "dimension",
        "method",
        storage.alias("storage"),
        "variant",
        n.alias("num_vectors"),
        vector_storage_mb(n, "dimension", storage).alias("storage_mb"),
        code_storage_mb(n, "dimension", "bits").alias("code_mb"),
    )


class _Cell(NamedTuple):
    build: Callable[[], object]
    search: Callable[[object], DataFrame]
    nbytes: Callable[[object], int]


def _logical_bytes(table: DataFrame) -> int:
    return index_size(table).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _cell(method: str, precision: str, variant: str | None, table: DataFrame, sample: DataFrame, p: Profile) -> _Cell:
    """How to build and search one cell; only its own derived tables are read."""
    queries = as_queries(sample, precision, variant)
    # An index over codes serves both rerank precisions.
    columns = ["f32", "f16", f"code_{variant}"] if variant else [precision]
    own = table.select("vec_id", *columns)

    def pinned(index: ivf.IvfIndex) -> ivf.IvfIndex:
        return index._replace(postings=materialise(index.postings, "postings"))

    def ivf_bytes(index: ivf.IvfIndex) -> int:
        return index.centroids.nbytes + _logical_bytes(index.postings)

    def linked(links: DataFrame) -> DataFrame:
        both_ways = graph.undirected(links, 2 * p.degree)
        return materialise(graph.nodes(both_ways, own, *columns), "nodes")

    def link_bytes(nodes: DataFrame) -> int:
        return nodes.agg(F.coalesce(F.sum(F.size("nbr_ids") * 8), F.lit(0))).first()[0]

    def blocked(vec: str) -> DataFrame:
        centroids = (
            ivf.seed_centroids(own, p.lists, vec)
            if variant
            else ivf.train_centroids(own, p.lists, p.steps, vec)
        )
        return graph.knn_graph(own, p.degree, vec, centroids, p.probes_codes if variant else p.probes)

    if method == "exact":
        return _Cell(lambda: own, lambda t: knn.exact_knn(queries, t, p.k, precision), lambda t: 0)
    if method == "exact_rerank":
        return _Cell(
            lambda: own,
            lambda t: rerank.rerank_knn(queries, t, p.k, p.overfetch, variant, precision),
            lambda t: 0,
        )
    if method == "ivf":
        return _Cell(
            lambda: pinned(ivf.ivf_build(own, ivf.train_centroids(own, p.lists, p.steps, precision), precision)),
            lambda i: ivf.ivf_knn(queries, i, p.k, p.probes, precision),
            ivf_bytes,
        )
    if method == "ivf_rerank":
        code = f"code_{variant}"
        return _Cell(
            lambda: pinned(ivf.ivf_build(own, ivf.seed_centroids(own, p.lists, code), code)),
            lambda i: ivf.ivf_rerank(queries, i, p.k, p.overfetch, p.probes_codes, variant, precision),
            ivf_bytes,
        )
    if method == "rabitq":

        def build() -> rabitq.RabitqIndex:
            lists = ivf.train_centroids(own, p.rabitq_lists, p.steps, precision)
            coded = rabitq.rabitq_build(ivf.ivf_build(own, lists, precision), True, precision)
            return coded._replace(ivf=pinned(coded.ivf))

        def coded_bytes(index: rabitq.RabitqIndex) -> int:
            words = index.ivf.postings.agg(F.coalesce(F.sum(F.size("rq_code") * 8 + 16), F.lit(0))).first()[0]
            return index.ivf.centroids.nbytes + words

        return _Cell(
            build, lambda i: rabitq.rabitq_knn(queries, i, p.k, p.rabitq_probes, p.epsilon, precision), coded_bytes
        )
    width = {"vec": precision, "max_degree": 2 * p.degree}
    if method == "graph":
        return _Cell(
            lambda: linked(blocked(precision)),
            lambda t: graph.graph_knn(queries, t, p.k, p.ef, p.hops, **width),
            link_bytes,
        )
    if method == "graph_pruned":
        return _Cell(
            lambda: linked(graph.prune(blocked(precision), own, p.degree, vec=precision)),
            lambda t: graph.graph_knn(queries, t, p.k, p.ef, p.hops, **width),
            link_bytes,
        )
    if method == "graph_rerank":
        return _Cell(
            lambda: linked(blocked(f"code_{variant}")),
            lambda t: graph.graph_rerank(
                queries, t, p.k, p.overfetch, variant, precision, p.hops, max_degree=2 * p.degree
            ),
            link_bytes,
        )
    raise ValueError(f"unknown method: {method}")


def _timed(action: Callable[[], object]) -> tuple[object, float]:
    start = time.perf_counter()
    value = action()
    return value, time.perf_counter() - start


def _by_index(corpus: DataFrame, dims: list[int], methods: list[str] | None) -> list[list[Row]]:
    """The wanted cells, those of one index together."""
    grid = [c for c in config_grid(corpus, dims).collect() if not methods or c.method in methods]
    unknown = set(methods or []) - {cell.method for cell in grid}
    if unknown:
        raise ValueError(f"unknown method: {', '.join(sorted(unknown))}")
    groups: dict[tuple, list[Row]] = {}
    for spec in grid:
        groups.setdefault((spec.dimension, spec.method, spec.variant or spec.storage), []).append(spec)
    return list(groups.values())


def _prepared(
    corpus: DataFrame, query_ids: DataFrame, dims: list[int], full_dim: int, profile: Profile
) -> tuple[DataFrame, dict[int, DataFrame], dict[int, DataFrame]]:
    """Truth over full-width vectors, the encoded table of each dimension and its rows that are queries."""
    thresholds = fit_thresholds(corpus, full_dim)
    full = represent(corpus, full_dim, full_dim, ("f32",))
    wanted = cut_lineage(query_ids.select("vec_id"))
    asked = as_queries(full.join(wanted, "vec_id", "left_semi"))
    truth = cut_lineage(knn.ground_truth(asked, full, profile.k, "f32"))
    columns = ("f32", "f16", *[f"code_{v}" for v in CODE_VARIANTS])
    tables = {
        dim: materialise(represent(corpus, dim, full_dim, columns, thresholds), f"items_{dim}") for dim in dims
    }
    samples = {
        dim: materialise(table.join(wanted, "vec_id", "left_semi"), f"queries_{dim}") for dim, table in tables.items()
    }
    return truth, tables, samples


def _cell_of(spec: Row, table: DataFrame, sample: DataFrame, profile: Profile) -> _Cell:
    precision = next(p for p, name in STORAGE.items() if name == spec.storage)
    return _cell(spec.method, precision, spec.variant, table, sample, profile)


def recall_grid(
    corpus: DataFrame,
    query_ids: DataFrame,
    dims: list[int],
    full_dim: int = settings.FULL_DIM,
    profile: Profile = Profile(),
    methods: list[str] | None = None,
) -> DataFrame:
    """(dimension, storage, method, variant, recall) of every cell, without timings; a failed cell raises."""
    by_index = _by_index(corpus, dims, methods)
    truth, tables, samples = _prepared(corpus, query_ids, dims, full_dim, profile)
    parts = []
    for cells in by_index:
        index = None
        for spec in cells:
            cell = _cell_of(spec, tables[spec.dimension], samples[spec.dimension], profile)
            index = cell.build() if index is None else index
            names = [F.lit(spec[name]).cast(kind).alias(name) for name, kind in CELL_KEYS]
            parts.append(cut_lineage(mean_recall(cell.search(index), truth).select(*names, "recall")))
    return reduce(DataFrame.unionAll, parts)


def run_grid(
    corpus: DataFrame,
    query_ids: DataFrame,
    dims: list[int],
    full_dim: int = settings.FULL_DIM,
    profile: Profile = Profile(),
    methods: list[str] | None = None,
    warm_up: bool = True,
    parallel: int = 1,
    sink: str | None = None,
) -> DataFrame:
    """Build, search and score every cell; a failed cell has its error as status.

    ``query_ids`` (vec_id) names the corpus rows used as queries.  Truth is the
    exact answer over full-width vectors.  Latency is one materialising run of
    the whole query batch, after a warm-up run; with ``parallel`` above one cells
    share the cluster, which is quicker but makes latencies incomparable.

    An exact method builds nothing; an index over codes is built once and serves
    both float precisions.
    """
    spark = corpus.sparkSession
    by_index = _by_index(corpus, dims, methods)
    truth, tables, samples = _prepared(corpus, query_ids, dims, full_dim, profile)

    def run(cells: list[Row]) -> list[tuple]:
        """The cells of one index: built for the first, searched for each."""
        rows, built = [], None
        for spec in cells:
            build_s = latency = recall = size = None
            try:
                cell = _cell_of(spec, tables[spec.dimension], samples[spec.dimension], profile)
                built = built or _timed(cell.build)
                index, build_s = built
                size = cell.nbytes(index)
                search = lambda cell=cell, index=index: cut_lineage(cell.search(index))
                if warm_up:
                    search()
                found, latency = _timed(search)
                recall, status = mean_recall(found, truth).first().recall, "ok"
            except Exception as error:  # noqa: BLE001 - a cell reports, the run goes on
                status = f"{type(error).__name__}: {str(error)[:200]}"
            measured = (build_s, size, spec.storage_mb, latency, recall, status)
            rows.append((spec.dimension, spec.storage, spec.method, spec.variant, *measured))
        release(spark)
        return rows

    with ThreadPoolExecutor(parallel) as pool:
        results = [row for rows in pool.map(run, by_index) for row in rows]
    table = spark.createDataFrame(results, RESULTS)
    if sink:
        table.write.mode("append").parquet(sink)
    return table


def results_markdown(results: DataFrame) -> DataFrame:
    """One Markdown table line per result row."""
    name = F.concat_ws("_", "method", "variant")
    cells = [
        name,
        F.format_string("%.1f", F.col("recall") * 100),
        F.format_string("%.2f", F.col("latency_s") * 1000),
        F.col("dimension").cast("string"),
        F.col("storage"),
        F.format_string("%.2f", "build_time_s"),
        F.format_string("%.1f", "storage_mb"),
        F.format_string("%.1f", F.col("index_bytes") / F.lit(1048576.0)),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return results.withColumn("line", line)


MARKDOWN_HEAD = (
    "| Index | Recall (%) | Latency (ms) | Dim | Storage | Build (s) | Storage (MB) | Index (MB) |\n"
    "|-------|------------|--------------|-----|---------|-----------|--------------|------------|"
)


def markdown_table(results: DataFrame) -> str:
    """The whole report; a run has a few hundred rows at most."""
    lines = results_markdown(results).orderBy("dimension", "method", "variant", "storage").select("line").collect()
    return "\n".join([MARKDOWN_HEAD, *[row.line for row in lines]])


def explain(df: DataFrame) -> None:
    """Show the physical plan of a search."""
    df.explain("formatted")


