"""The registered queries: one per operator, over the whole supplied tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import codes, rules, vectors
from nearfield.operators import certified, descent, evaluate, graph, ivf, knn, late, multi_index, prep, quantiles, rabitq, radius, rerank, seeding, two_level
from nearfield.plans import grid
from nearfield.session import attach, materialise, scratch_path
from nearfield.sources import tables, versions
from nearfield.sources import vectors as source

# Profile of the supplied table (64-dimensional vectors).
FULL = 64
DIM = 32
K = 10
OVERFETCH = 10
QUERIES = 10
LISTS, PROBES, PROBES_CODES = 50, 8, 24
COARSE, COARSE_PROBES, ROWS_PER_LIST = 8, 4, 16
SEED_ROUNDS = 2
DEGREE = 8
EF, HOPS, ENTRIES = 20, 3, 20
CAP = 400
EPSILON = 1.9
ACCURACY = 100  # of the approximate percentiles whose rank error is checked
SHIFT = 0.05  # of mean thresholds, for a table that must be built again
GRID_PROFILE = grid.Profile(
    k=K,
    overfetch=OVERFETCH,
    lists=LISTS,
    probes=PROBES,
    probes_codes=PROBES_CODES,
    rabitq_lists=LISTS,
    rabitq_probes=PROBES,
    degree=DEGREE,
    ef=EF,
    hops=HOPS,
)
GRID_DIMS = [16, DIM, FULL]

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def _query(name: str):
    def register(build: Query) -> Query:
        _REGISTERED[name] = lambda spark, sf_dir: build(attach(spark), sf_dir)
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


# --- shared pieces -------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _table(spark: SparkSession, sf_dir: str, dim: int, *columns: str, keep=("vec_id",)) -> DataFrame:
    """Representations of the corpus; thresholds are learned when a code needs them."""
    raw = _raw(spark, sf_dir)
    learned = [c for c in columns if c.startswith("code_") and c != "code_sign"]
    thresholds = None
    if learned == ["code_mean"]:
        thresholds = prep.fit_means(raw, FULL)
    elif learned:
        thresholds = prep.fit_thresholds(raw, FULL)
    return prep.represent(raw, dim, FULL, columns, thresholds, keep=keep)


def _stored(spark: SparkSession, sf_dir: str, dim: int, *columns: str) -> DataFrame:
    """The same, encoded once and written: for queries that read it more than once."""
    return materialise(_table(spark, sf_dir, dim, *columns), "items")


def _sample(table: DataFrame) -> DataFrame:
    return source.hash_sample(table, QUERIES, "query")


def _micro(vec: Column | str) -> Column:
    """Elements in millionths, as text: the same digits on every engine."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1000000).cast("bigint")), ",")


def _half_units(vec: Column | str) -> Column:
    """Half-precision values are whole multiples of 2**-24."""
    return F.array_join(F.transform(vec, lambda x: (x.cast("double") * 16777216).cast("bigint")), ",")


def _bits(name: str, dim: int) -> Column:
    return codes.bits_to_string(name, ivf.code_bits(dim, name.removeprefix("code_")))


def _rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with a plain zero for both signed zeros."""
    value = F.round(c, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "rk", "vec_id", _rounded("dist").alias("dist"))


# --- sources, sinks, catalogue -------------------------------------------------------


@_query("load_vectors")
def load_vectors(spark, sf_dir):
    corpus = source.load_vectors(spark, f"{sf_dir}/embeddings.parquet")
    return source.width_report(corpus)


@_query("cap_rows")
def cap_rows(spark, sf_dir):
    return source.cap_rows(_raw(spark, sf_dir), CAP).select("vec_id", "label")


@_query("gen_vectors")
def gen_vectors(spark, sf_dir):
    made = source.gen_vectors(_raw(spark, sf_dir).select("vec_id"), 16)
    return made.select("vec_id", _micro("embedding").alias("v"))


@_query("assign_ids")
def assign_ids(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("vec_id", vectors.hash_order("order", "vec_id").alias("h"))
    return source.assign_ids(rows, "h").select("vec_id", "row_id")


def _unified(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return tables.unified_table(raw, DIM, FULL, prep.fit_thresholds(raw, FULL))


@_query("unified_table")
def unified_table(spark, sf_dir):
    coded = [_bits(f"code_{v}", DIM).alias(f"code_{v}") for v in ("sign", "mean", "thermo4", "thermo8")]
    return _unified(spark, sf_dir).select(
        "vec_id", _micro("f32").alias("f32"), _half_units("f16").alias("f16"), *coded
    )


@_query("single_precision_table")
def single_precision_table(spark, sf_dir):
    single = tables.single_precision_table(_unified(spark, sf_dir), "halfvec")
    return single.select(
        "vec_id", _half_units("embedding").alias("embedding"), _bits("code_thermo4", DIM).alias("code_thermo4")
    )


@_query("single_precision_table_vector")
def single_precision_table_vector(spark, sf_dir):
    single = tables.single_precision_table(_unified(spark, sf_dir), "vector")
    return single.select("vec_id", _micro("embedding").alias("embedding"), _bits("code_sign", DIM).alias("code_sign"))


def _label_tables(spark, sf_dir) -> DataFrame:
    sized = _raw(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("num_vectors"))
    return sized.select(
        F.concat(F.lit("items_"), F.col("label").cast("string")).alias("table_name"),
        F.lit("embeddings").alias("data_source"),
        "num_vectors",
        F.lit(DIM).alias("dimension"),
        F.lit("thermometer").alias("encoder"),
        F.col("label"),
    )


@_query("metadata_upsert")
def metadata_upsert(spark, sf_dir):
    stored = _label_tables(spark, sf_dir)
    mean = stored.agg(F.avg("num_vectors")).first()[0]
    rebuilt = stored.filter(F.col("num_vectors") > mean).withColumn("dimension", F.lit(FULL))
    return tables.metadata_upsert(stored.drop("label"), rebuilt.drop("label"))


@_query("cache_check")
def cache_check(spark, sf_dir):
    stored = _label_tables(spark, sf_dir)
    span = stored.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    wanted = stored.withColumn(
        "data_source", F.when(F.col("label") != span.high, F.col("data_source"))
    ).withColumn("num_vectors", F.col("num_vectors") + F.when(F.col("label") == span.low, 1).otherwise(0))
    return tables.cache_check(stored, wanted, ("data_source", "num_vectors", "dimension", "encoder"))


@_query("table_check")
def table_check(spark, sf_dir):
    expected = _raw(spark, sf_dir).count()
    return tables.table_check(
        _table(spark, sf_dir, DIM, "f32", "code_sign"), expected, ("f32", "code_sign", "code_thermo8")
    )


@_query("table_build_cached")
def table_build_cached(spark, sf_dir):
    """Build, skip, rebuild under other thresholds, forced rebuild; the ones of the mean code tell the tables apart."""
    raw = _raw(spark, sf_dir)
    cuts = prep.fit_thresholds(raw, FULL)
    shifted = cuts._replace(mean=cuts.mean + SHIFT)
    catalog = tables.TableCatalog(spark)
    steps = [("build", cuts, True), ("again", cuts, True), ("shifted", shifted, True), ("forced", shifted, False)]
    out = None
    for step, thresholds, skip in steps:
        built = catalog.build("items", raw, FULL, FULL, thresholds, data_source="embeddings", skip_if_exists=skip)
        ones = F.length(F.replace(_bits("code_mean", FULL), F.lit("0"), F.lit("")))
        row = catalog.table("items").agg(F.count(F.lit(1)).alias("num_vectors"), F.sum(ones).alias("ones"))
        row = row.select(F.lit(step).alias("step"), F.lit(built).alias("built"), "num_vectors", "ones")
        out = row if out is None else out.unionByName(row)
    return out


def _versions(spark, sf_dir) -> tuple[DataFrame, versions.VersionedTable]:
    """Two versions: all labels but the last, the first one's vectors turned round; then the whole table."""
    raw = _raw(spark, sf_dir).select("vec_id", "embedding", "label")
    cuts = prep.fit_thresholds(raw, FULL)
    span = raw.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    turned = F.transform("embedding", lambda x: -x)
    early = raw.filter(F.col("label") != span.high)
    early = early.withColumn("embedding", F.when(F.col("label") == span.low, turned).otherwise(F.col("embedding")))
    made = versions.VersionedTable(spark)
    for corpus in (early, raw):
        made.build(corpus, FULL, FULL, cuts)
    return raw, made


@_query("table_delta_build")
def table_delta_build(spark, sf_dir):
    _, made = _versions(spark, sf_dir)
    ones = F.length(F.replace(_bits("code_sign", FULL), F.lit("0"), F.lit("")))
    out = None
    for version in (1, 2):
        row = made.table(version).agg(F.sum(ones).alias("ones")).withColumn("version", F.lit(version))
        out = row if out is None else out.unionByName(row)
    return made.versions().join(out, "version").select("version", "num_vectors", "encoded", "removed", "ones")


@_query("table_drop_versions")
def table_drop_versions(spark, sf_dir):
    raw, made = _versions(spark, sf_dir)
    low = raw.agg(F.min("label")).first()[0]
    made.build(raw.filter(F.col("label") != low), FULL, FULL, prep.fit_thresholds(raw, FULL))
    known = materialise(made.versions().select("version"), "versions")
    made.drop_versions(keep=1)
    left = made.table().agg(F.count(F.lit(1)).alias("num_vectors"))
    left = left.select("num_vectors", F.lit(made.versions().first().version).alias("version"), F.lit(True).alias("kept"))
    kept = materialise(left, "kept")
    out = known.join(kept, "version", "left")
    return out.select("version", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("num_vectors", F.lit(0)).alias("num_vectors"))


@_query("index_size")
def index_size(spark, sf_dir):
    return tables.index_size(_unified(spark, sf_dir))


@_query("results_markdown")
def results_markdown(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    full = _stored(spark, sf_dir, FULL, "f32")
    truth = materialise(knn.ground_truth(prep.as_queries(_sample(full)), full, K, "f32"), "truth")
    estimate = grid.config_grid(raw, [16, DIM, FULL]).filter(F.col("method") == "exact")
    measured = None
    for dim in (16, DIM, FULL):
        table = _stored(spark, sf_dir, dim, "f32", "f16")
        sample = _sample(table)
        for precision, storage in grid.STORAGE.items():
            found = knn.exact_knn(prep.as_queries(sample, precision), table, K, precision)
            row = evaluate.mean_recall(found, truth).select(
                F.lit(dim).alias("dimension"), F.lit(storage).alias("storage"), "recall"
            )
            measured = row if measured is None else measured.unionByName(row)
    results = estimate.join(measured, ["dimension", "storage"]).select(
        "dimension",
        "storage",
        "method",
        "variant",
        F.lit(0.0).alias("build_time_s"),
        F.lit(0).cast("bigint").alias("index_bytes"),
        "storage_mb",
        F.lit(0.0).alias("latency_s"),
        "recall",
    )
    return grid.results_markdown(results).select("dimension", "storage", "line")


@_query("sample_queries")
def sample_queries(spark, sf_dir):
    return _sample(_raw(spark, sf_dir)).select("vec_id", "label")


@_query("config_grid")
def config_grid(spark, sf_dir):
    cells = grid.config_grid(_raw(spark, sf_dir), [16, DIM, FULL])
    return cells.withColumn("storage_mb", F.round("storage_mb", 6)).withColumn("code_mb", F.round("code_mb", 6))


# --- projections and scalar functions ------------------------------------------------


@_query("l2_normalize")
def l2_normalize(spark, sf_dir):
    return _raw(spark, sf_dir).select("vec_id", _micro(vectors.l2_normalize("embedding")).alias("v"))


@_query("pad_truncate")
def pad_truncate(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "vec_id",
        _micro(vectors.pad_truncate("embedding", 96)).alias("padded"),
        _micro(vectors.pad_truncate("embedding", 48)).alias("truncated"),
    )


@_query("matryoshka_slice")
def matryoshka_slice(spark, sf_dir):
    unit = vectors.l2_normalize("embedding")
    return _raw(spark, sf_dir).select("vec_id", _micro(vectors.matryoshka_slice(unit, 16)).alias("v"))


@_query("to_half")
def to_half(spark, sf_dir):
    return prep.prepare(_raw(spark, sf_dir), DIM, FULL).select(
        "vec_id", _half_units(vectors.to_half("v")).alias("f16")
    )


def _code_query(variant: str) -> None:
    @_query(f"code_{variant}")
    def build(spark, sf_dir):
        table = _table(spark, sf_dir, FULL, f"code_{variant}")
        return table.select("vec_id", _bits(f"code_{variant}", FULL).alias("code"))


for _variant in codes.VARIANTS:
    _code_query(_variant)


@_query("bits_to_string")
def bits_to_string(spark, sf_dir):
    text = _table(spark, sf_dir, FULL, "code_thermo4").select(
        "vec_id", "code_thermo4", _bits("code_thermo4", FULL).alias("bits")
    )
    back = codes.string_to_words("bits")
    return text.select(
        "vec_id",
        "bits",
        F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("bigint").alias("ones"),
        (back == F.col("code_thermo4")).alias("same"),
    )


@_query("vector_text_roundtrip")
def vector_text_roundtrip(spark, sf_dir):
    f32 = vectors.to_float32("embedding")
    read = _raw(spark, sf_dir).select("vec_id", f32.alias("f32")).withColumn(
        "back", vectors.text_to_vector(vectors.vector_to_text("f32"))
    )
    return read.select("vec_id", (F.col("f32") == F.col("back")).alias("same"), _micro("back").alias("v"))


def _pair_query(name: str, column: str, distance: Callable[[Column, Column], Column]) -> None:
    @_query(name)
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, DIM, column)
        one = source.hash_sample(table, 1, "query").first()[column]
        element = "float" if column == "f32" else "bigint"
        query = F.lit(list(one)).cast(f"array<{element}>")
        value = distance(F.col(column), query)
        return table.select("vec_id", (value if column != "f32" else _rounded(value)).alias("value"))


_pair_query("cosine_distance", "f32", vectors.cosine_distance)
_pair_query("inner_product", "f32", vectors.inner_product)
_pair_query("hamming_distance", "code_thermo4", vectors.hamming_distance)


@_query("ivf_params")
def ivf_params(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.withColumn("k", F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))))
    lists, probes, probes_codes = rules.ivf_params("n", "k")
    return asked.select(
        F.col("l_linenumber").cast("bigint").alias("part"),
        "n",
        "k",
        lists.alias("lists"),
        probes.alias("probes"),
        probes_codes.alias("probes_codes"),
        rules.search_width("k").alias("search_width"),
    )


@_query("storage_estimate")
def storage_estimate(spark, sf_dir):
    sizes = _raw(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")
    )
    return sizes.select(
        "label",
        "n",
        F.round(rules.vector_storage_mb("n", "dims", F.lit("float32")), 9).alias("f32_mb"),
        F.round(rules.vector_storage_mb("n", "dims", F.lit("float16")), 9).alias("f16_mb"),
        F.round(rules.code_storage_mb("n", "dims", F.lit(1)), 9).alias("code1_mb"),
        F.round(rules.code_storage_mb("n", "dims", F.lit(4)), 9).alias("code4_mb"),
        F.round(rules.code_storage_mb("n", "dims", F.lit(8)), 9).alias("code8_mb"),
    )


# --- aggregates ----------------------------------------------------------------------


@_query("dim_means")
def dim_means(spark, sf_dir):
    means = quantiles.dim_means(prep.prepare(_raw(spark, sf_dir), FULL, FULL))
    return means.select("d", _rounded("mean", 9).alias("mean"))


@_query("dim_percentiles")
def dim_percentiles(spark, sf_dir):
    return _cuts(prep.thresholds_table(spark, prep.fit_thresholds(_raw(spark, sf_dir), FULL)))


@_query("dim_percentiles_two_pass")
def dim_percentiles_two_pass(spark, sf_dir):
    return _cuts(prep.thresholds_table(spark, prep.fit_thresholds(_raw(spark, sf_dir), FULL, sketched=True)))


def _cuts(learned: DataFrame) -> DataFrame:
    return learned.select("d", F.posexplode("t8").alias("cut", "value"), "t4").select(
        "d",
        "cut",
        _rounded("value", 9).alias("eighth"),
        _rounded(F.try_element_at("t4", F.col("cut") + 1), 9).alias("quarter"),
    )


@_query("dim_percentiles_approx")
def dim_percentiles_approx(spark, sf_dir):
    cuts = quantiles.approx_percentiles(prep.prepare(_raw(spark, sf_dir), FULL, FULL), prep.EIGHTHS)
    return cuts.select("d", F.posexplode("cuts").alias("cut", "value")).withColumn(
        "value", _rounded("value", 9)
    )


@_query("dim_percentiles_rank_error")
def dim_percentiles_rank_error(spark, sf_dir):
    """The values between which each approximate percentile must lie by its sketch's rank error, and whether it does."""
    unit = materialise(prep.prepare(_raw(spark, sf_dir), FULL, FULL), "unit")
    schema = "d int, cut int, lowest double, highest double"
    n = unit.filter("v IS NOT NULL").count()
    slack = -(-n // ACCURACY)
    ranks = [max(0, math.floor(p * n) - slack - 1) for p in prep.EIGHTHS]
    ranks += [min(n - 1, math.ceil(p * n) + slack) for p in prep.EIGHTHS]
    rows = []
    if n:
        _, values = quantiles.exact_percentiles(unit, [r / max(1, n - 1) for r in ranks])
        half = len(prep.EIGHTHS)
        rows = [(d, i, float(x[i]), float(x[half + i])) for d, x in enumerate(values) for i in range(half)]
    bounds = F.broadcast(spark.createDataFrame(rows, schema))  # a row for each dimension and cut
    cuts = quantiles.approx_percentiles(unit, prep.EIGHTHS, accuracy=ACCURACY)
    found = cuts.select("d", F.posexplode("cuts").alias("cut", "x")).join(bounds, ["d", "cut"])
    within = (F.col("lowest") <= F.col("x")) & (F.col("x") <= F.col("highest"))
    return found.select("d", "cut", _rounded("lowest").alias("lowest"), _rounded("highest").alias("highest"), within.alias("within"))


@_query("recall_at_k")
def recall_at_k(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32", "code_thermo4")
    sample = _sample(table)
    truth = knn.ground_truth(prep.as_queries(sample), table, K, "f32")
    found = knn.hamming_knn(prep.as_queries(sample, None, "thermo4"), table, K, "thermo4")
    return evaluate.recall_at_k(found, truth).select("qid", F.round("recall", 6).alias("recall"))


def _grid_query(name: str, methods: list[str]) -> None:
    @_query(name)
    def build(spark, sf_dir):
        raw = _raw(spark, sf_dir)
        asked = _sample(raw.select("vec_id"))
        return grid.run_grid(raw, asked, GRID_DIMS, FULL, GRID_PROFILE, methods)


_grid_query("benchmark_results", ["exact", "exact_rerank", "ivf", "ivf_rerank", "rabitq"])
_grid_query("benchmark_results_graph", ["graph", "graph_pruned", "graph_rerank"])


@_query("benchmark_recall")
def benchmark_recall(spark, sf_dir):
    """Recall of the grid's exact and seeded cells, which need no training."""
    raw = _raw(spark, sf_dir)
    asked = _sample(raw.select("vec_id"))
    cells = grid.recall_grid(raw, asked, GRID_DIMS, FULL, GRID_PROFILE, ["exact", "exact_rerank", "ivf_rerank"])
    return cells.withColumn("recall", F.round("recall", 6))


# --- exact search --------------------------------------------------------------------


@_query("ground_truth")
def ground_truth(spark, sf_dir):
    table = materialise(prep.prepare(_raw(spark, sf_dir), FULL, FULL), "unit")
    asked = _sample(table).select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    return knn.ground_truth(asked, table, K).select("qid", "rk", "vec_id", _rounded("dot").alias("dot"))


def _one_query(precision: str) -> None:
    @_query(f"exact_knn_{precision}")
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, DIM, precision)
        one = source.hash_sample(table, 1, "query").first()[precision]
        return knn.nearest_to(one, table, K, precision).select("vec_id", _rounded("dist").alias("dist"))


_one_query("f32")
_one_query("f16")


@_query("exact_knn_batch")
def exact_knn_batch(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    return _hits(knn.exact_knn(prep.as_queries(_sample(table)), table, K))


def _hamming(variant: str) -> None:
    @_query(f"hamming_topk_{variant}")
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, FULL, f"code_{variant}")
        return knn.hamming_knn(prep.as_queries(_sample(table), None, variant), table, K, variant)


def _rerank(variant: str, precision: str) -> None:
    @_query(f"rerank_{variant}_{precision}")
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, DIM, precision, f"code_{variant}")
        asked = prep.as_queries(_sample(table), precision, variant)
        return _hits(rerank.rerank_knn(asked, table, K, OVERFETCH, variant, precision))


for _variant in ("sign", "mean", "thermo4", "thermo8"):
    _hamming(_variant)
    for _precision in ("f32", "f16"):
        _rerank(_variant, _precision)


@_query("rerank_late_f32")
def rerank_late_f32(spark, sf_dir):
    table = _stored(spark, sf_dir, DIM, "f32", "code_thermo8")
    path = scratch_path(spark, "sorted")
    late.write_sorted(table, ivf.seed_centroids(table, LISTS), path)
    stored = late.read_sorted(spark, path)
    asked = prep.as_queries(_sample(stored), "f32", "thermo8")
    return _hits(late.rerank_late(asked, stored, K, OVERFETCH, "thermo8", "f32"))


# --- approximate search --------------------------------------------------------------


@_query("ivf_assign_seeded")
def ivf_assign_seeded(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    index = ivf.ivf_build(table, ivf.seed_centroids(table, LISTS))
    return index.postings.select("vec_id", "list_id")


@_query("ivf_lloyd_step")
def ivf_lloyd_step(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    means = ivf.lloyd_step(table, ivf.seed_centroids(table, LISTS))
    return means.select("list_id", "d", _rounded("mean").alias("mean"))


@_query("ivf_seed_parallel")
def ivf_seed_parallel(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    centres = seeding.draw_centres(table, LISTS, rounds=SEED_ROUNDS)
    names = [(i, int(v), int(r)) for i, (v, r) in enumerate(zip(centres.ids, centres.rounds, strict=True))]
    drawn = spark.createDataFrame(names, "list_id int, vec_id bigint, found_in int")
    n = seeding.weights(table, centres).select("list_id", "n")
    return drawn.join(n, "list_id", "left").select("list_id", "vec_id", "found_in", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@_query("ivf_train_kmeans")
def ivf_train_kmeans(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    index = ivf.ivf_build(table, ivf.train_kmeans(table, LISTS))
    return index.postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def _ivf(precision: str) -> None:
    @_query(f"ivf_knn_{precision}")
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, FULL, precision)
        index = ivf.ivf_build(table, ivf.train_centroids(table, LISTS, 1, precision), precision)
        asked = prep.as_queries(_sample(table), precision)
        return _hits(ivf.ivf_knn(asked, index, K, PROBES, precision))


def _reread(spark: SparkSession, index: ivf.IvfIndex) -> ivf.IvfIndex:
    """The index as it is stored: searches read the files of probed lists only."""
    path = scratch_path(spark, "index")
    ivf.write_index(index, path)
    return ivf.read_index(spark, path)


def _ivf_stored(precision: str) -> None:
    @_query(f"ivf_stored_knn_{precision}")
    def build(spark, sf_dir):
        table = _stored(spark, sf_dir, FULL, precision)
        lists = ivf.train_centroids(table, LISTS, 1, precision)
        index = _reread(spark, ivf.ivf_build(table, lists, precision))
        return _hits(ivf.ivf_knn(prep.as_queries(_sample(table), precision), index, K, PROBES, precision))


def _ivf_stored_rerank(variant: str) -> None:
    @_query(f"ivf_stored_rerank_{variant}_f32")
    def build(spark, sf_dir):
        code = f"code_{variant}"
        table = _stored(spark, sf_dir, FULL, "f32", code)
        lists = ivf.train_code_centroids(table, LISTS, ivf.code_bits(FULL, variant), 1, code)
        index = _reread(spark, ivf.ivf_build(table, lists, code))
        asked = prep.as_queries(_sample(table), "f32", variant)
        return _hits(ivf.ivf_rerank(asked, index, K, OVERFETCH, PROBES_CODES, variant, "f32"))


for _precision in ("f32", "f16"):
    _ivf(_precision)
    _ivf_stored(_precision)
for _variant in ("sign", "mean", "thermo4", "thermo8"):
    _ivf_stored_rerank(_variant)


@_query("hamming_topk_radius")
def hamming_topk_radius(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "code_thermo4")
    return radius.hamming_radius_knn(prep.as_queries(_sample(table), None, "thermo4"), table, K, "thermo4")


@_query("hamming_mih_knn")
def hamming_mih_knn(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "code_sign")
    index = multi_index.build(table, "sign", ivf.code_bits(FULL, "sign"))
    return multi_index.hamming_mih_knn(prep.as_queries(_sample(table), None, "sign"), index, K)


@_query("exact_knn_certified")
def exact_knn_certified(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    index = _reread(spark, ivf.ivf_build(table, ivf.train_centroids(table, LISTS, 1)))
    return _hits(certified.certified_knn(prep.as_queries(_sample(table)), index, certified.list_spread(index), K))


def _two_level(spark, sf_dir) -> tuple[DataFrame, two_level.TwoLevelIndex]:
    table = _stored(spark, sf_dir, FULL, "f32")
    coarse = ivf.seed_centroids(table, COARSE)
    return table, two_level.two_level_build(table, coarse, rows_per_list=ROWS_PER_LIST)


@_query("ivf_two_level_assign")
def ivf_two_level_assign(spark, sf_dir):
    return _two_level(spark, sf_dir)[1].postings.select("vec_id", "coarse_id", "list_id")


@_query("ivf_two_level_knn")
def ivf_two_level_knn(spark, sf_dir):
    table, index = _two_level(spark, sf_dir)
    return _hits(two_level.two_level_knn(prep.as_queries(_sample(table)), index, K, COARSE_PROBES, PROBES))


@_query("ivf_code_assign")
def ivf_code_assign(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "code_thermo4")
    bits = ivf.code_bits(FULL, "thermo4")
    lists = ivf.train_code_centroids(table, LISTS, bits, 1, "code_thermo4")
    return ivf.ivf_build(table, lists, "code_thermo4").postings.select("vec_id", "list_id")


def _ivf_rerank(variant: str, precision: str) -> None:
    @_query(f"ivf_rerank_{variant}_{precision}")
    def build(spark, sf_dir):
        code = f"code_{variant}"
        table = _stored(spark, sf_dir, FULL, precision, code)
        lists = ivf.train_code_centroids(table, LISTS, ivf.code_bits(FULL, variant), 1, code)
        index = ivf.ivf_build(table, lists, code)
        asked = prep.as_queries(_sample(table), precision, variant)
        return _hits(ivf.ivf_rerank(asked, index, K, OVERFETCH, PROBES_CODES, variant, precision))


def _graph_rerank(variant: str, precision: str) -> None:
    @_query(f"graph_rerank_{variant}_{precision}")
    def build(spark, sf_dir):
        code = f"code_{variant}"
        table = _stored(spark, sf_dir, FULL, precision, code)
        links = graph.undirected(graph.knn_graph(table, DEGREE, code), 2 * DEGREE)
        linked = materialise(graph.nodes(links, table, precision, code), "nodes")
        asked = prep.as_queries(_sample(table), precision, variant)
        return _hits(
            graph.graph_rerank(asked, linked, K, OVERFETCH, variant, precision, HOPS, ENTRIES, 2 * DEGREE)
        )


for _variant in ("mean", "thermo4", "thermo8"):
    for _precision in ("f32", "f16"):
        _ivf_rerank(_variant, _precision)
        _graph_rerank(_variant, _precision)
for _precision in ("f32", "f16"):
    _ivf_rerank("sign", _precision)
_hamming("onehot8")


def _rabitq_index(table: DataFrame, vec: str = "f32") -> rabitq.RabitqIndex:
    return rabitq.rabitq_build(ivf.ivf_build(table, ivf.seed_centroids(table, LISTS, vec), vec), vec=vec)


@_query("rabitq_encode")
def rabitq_encode(spark, sf_dir):
    coded = _rabitq_index(_stored(spark, sf_dir, FULL, "f32")).ivf.postings
    return coded.select(
        "vec_id",
        "list_id",
        codes.bits_to_string("rq_code", rabitq.padded_dim(FULL)).alias("code"),
        _rounded("rq_norm").alias("norm"),
        _rounded("rq_dot").alias("dot"),
    )


@_query("rabitq_estimate")
def rabitq_estimate(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    asked = prep.as_queries(_sample(table))
    return _hits(rabitq.rabitq_estimate(asked, _rabitq_index(table), K, PROBES, EPSILON))


@_query("rabitq_knn")
def rabitq_knn(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    asked = prep.as_queries(_sample(table))
    return _hits(rabitq.rabitq_knn(asked, _rabitq_index(table), K, PROBES, EPSILON))


@_query("rabitq_knn_f16")
def rabitq_knn_f16(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f16")
    asked = prep.as_queries(_sample(table), "f16")
    return _hits(rabitq.rabitq_knn(asked, _rabitq_index(table, "f16"), K, PROBES, EPSILON, "f16"))


@_query("rabitq_bits_knn")
def rabitq_bits_knn(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    asked = prep.as_queries(_sample(table))
    return _hits(rabitq.rabitq_knn(asked, _rabitq_index(table), K, PROBES, EPSILON, planes=True))


@_query("knn_graph_exact")
def knn_graph_exact(spark, sf_dir):
    return graph.edges(graph.knn_graph(_stored(spark, sf_dir, FULL, "f32"), DEGREE)).select("src", "dst", "rk")


def _blocked(table: DataFrame, vec: str = "f32") -> DataFrame:
    return graph.knn_graph(table, DEGREE, vec, ivf.seed_centroids(table, LISTS, vec), PROBES)


@_query("knn_graph_blocked")
def knn_graph_blocked(spark, sf_dir):
    return graph.edges(_blocked(_stored(spark, sf_dir, FULL, "f32"))).select("src", "dst", "rk")


@_query("knn_graph_blocked_f16")
def knn_graph_blocked_f16(spark, sf_dir):
    return graph.edges(_blocked(_stored(spark, sf_dir, FULL, "f16"), "f16")).select("src", "dst", "rk")


@_query("knn_graph_refined")
def knn_graph_refined(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    rough = graph.knn_graph(table, DEGREE, "f32", ivf.seed_centroids(table, LISTS), 2)
    refined = graph.refine(graph.undirected(rough, 2 * DEGREE), table, DEGREE)
    return graph.edges(refined).select("src", "dst", "rk")


@_query("knn_graph_pruned")
def knn_graph_pruned(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    return graph.edges(graph.prune(_blocked(table), table, DEGREE)).select("src", "dst", "rk")


@_query("knn_graph_two_sided")
def knn_graph_two_sided(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    return graph.edges(graph.two_sided(_blocked(table), table, DEGREE, 2 * DEGREE)).select("src", "dst", "rk")


@_query("knn_graph_descent")
def knn_graph_descent(spark, sf_dir):
    return graph.edges(descent.knn_graph_descent(_stored(spark, sf_dir, FULL, "f32"), DEGREE)).select("src", "dst", "rk")


@_query("graph_knn")
def graph_knn(spark, sf_dir):
    table = _stored(spark, sf_dir, FULL, "f32")
    links = graph.undirected(graph.knn_graph(table, DEGREE), 2 * DEGREE)
    linked = materialise(graph.nodes(links, table, "f32"), "nodes")
    asked = prep.as_queries(_sample(table))
    return _hits(graph.graph_knn(asked, linked, K, EF, HOPS, ENTRIES, max_degree=2 * DEGREE))
