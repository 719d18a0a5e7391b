import numpy as np
import pytest
from conftest import as_map, brute_knn, vectors
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import vectors as fv
from nearfield.operators import evaluate, knn, prep, rerank


def queries(table, condition="vec_id % 50 = 7", **kind):
    return prep.as_queries(table.filter(condition), **kind)


def test_matches_brute_force_on_any_partitioning(spark, unit):
    rows = unit.orderBy("vec_id").collect()
    x, ids = np.array([r.f32 for r in rows], float), np.array([r.vec_id for r in rows])
    want = {int(i): brute_knn(x, ids, x[i], 10) for i in ids if i % 50 == 7}
    for table in (unit, unit.repartition(13), unit.orderBy(F.desc("vec_id"))):
        assert as_map(knn.exact_knn(queries(unit), table, 10)) == want


def test_kernel_equals_column_expression_bit_for_bit(spark, unit):
    q = unit.filter("vec_id = 57").first().f32
    byexpr = knn.nearest_to(q, unit, 20).collect()
    bykernel = knn.exact_knn(queries(unit, "vec_id = 57"), unit.repartition(3), 20).orderBy("rk").collect()
    assert [(r.vec_id, r.dist) for r in byexpr] == [(r.vec_id, r.dist) for r in bykernel]


def test_copies_rank_by_id_whatever_the_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[::3] = x[0]  # a third of the table is one vector
    table = vectors(spark, x.tolist(), "f32").repartition(7)
    q = vectors(spark, [x[0].tolist(), x[1].tolist()], "f32")
    for cells in (settings.BLOCK_CELLS, 64):
        monkeypatch.setattr(settings, "BLOCK_CELLS", cells)
        got = as_map(knn.exact_knn(prep.as_queries(q), table, 25))
        assert got[0] == list(range(0, 75, 3))
        assert got[1] == brute_knn(x.astype(float), np.arange(900), x[1].astype(float), 25)


def test_edges(spark):
    table = vectors(spark, [[1, 0], [1, 0], None, [0, 1]], "f32")
    got = as_map(knn.exact_knn(prep.as_queries(table.filter("vec_id = 1")), table, 10))
    assert got == {1: [0, 1, 3]}
    assert knn.exact_knn(prep.as_queries(table.filter("vec_id > 90")), table, 10).isEmpty()
    assert knn.exact_knn(prep.as_queries(table), table.filter("vec_id > 90"), 10).isEmpty()
    with pytest.raises(ValueError, match="unknown metric"):
        knn.exact_knn(prep.as_queries(table), table, 3, metric="l1")


def test_many_queries_run_in_blocks(spark, conf, unit):
    whole = as_map(knn.exact_knn(queries(unit, "vec_id < 60"), unit, 5))
    conf(settings.QUERY_CHUNK_KEY, 7)
    assert as_map(knn.exact_knn(queries(unit, "vec_id < 60"), unit, 5)) == whole
    conf(settings.BROADCAST_LIMIT_KEY, 100)
    with pytest.raises(ValueError, match="queryChunkRows"):
        knn.exact_knn(queries(unit, "vec_id < 60"), unit, 5)


def test_salted_merge(spark, conf, unit):
    want = as_map(knn.exact_knn(queries(unit), unit, 10))
    conf("spark.sql.shuffle.partitions", 400)
    conf("spark.sql.adaptive.enabled", "true")
    assert as_map(knn.exact_knn(queries(unit), unit.repartition(16), 10)) == want


@pytest.fixture(scope="module")
def coded(embeddings, thresholds):
    columns = ("f32", "f16", "code_sign", "code_mean", "code_thermo4", "code_thermo8", "code_onehot8")
    return {d: prep.represent(embeddings, d, 64, columns, thresholds).cache() for d in (16, 32, 64)}


@pytest.fixture(scope="module")
def truth(coded):
    return knn.ground_truth(queries(coded[64]), coded[64], 10, "f32").cache()


# Recall of each method at 16, 32 and 64 of 64 dimensions.
RECALLS = {
    "exact": (0.22, 0.39, 1.0),
    "sign": (0.24, 0.38, 0.92),
    "mean": (0.20, 0.37, 0.90),
    "thermo4": (0.22, 0.40, 0.99),
    "thermo8": (0.22, 0.40, 1.0),
    "onehot8": (0.20, 0.32, 0.69),
}


@pytest.mark.parametrize("variant", RECALLS)
def test_recall_table(coded, truth, variant):
    for dim, want in zip((16, 32, 64), RECALLS[variant], strict=True):
        table = coded[dim]
        if variant == "exact":
            found = knn.exact_knn(queries(table), table, 10)
        else:
            found = rerank.rerank_knn(queries(table, variant=variant), table, 10, 10, variant, "f32")
        assert evaluate.mean_recall(found, truth).first().recall == pytest.approx(want)


@pytest.mark.parametrize(("variant", "want"), [("sign", 0.32), ("mean", 0.30), ("thermo4", 0.44), ("thermo8", 0.50)])
def test_recall_without_rerank(coded, truth, variant, want):
    found = knn.hamming_knn(queries(coded[64], precision=None, variant=variant), coded[64], 10, variant)
    assert evaluate.mean_recall(found, truth).first().recall == pytest.approx(want)


def test_rerank_beyond_the_broadcast_limit(coded, conf):
    asked = queries(coded[32], variant="thermo8")
    want = as_map(rerank.rerank_knn(asked, coded[32], 10, 10, "thermo8", "f16"))
    conf(settings.BROADCAST_LIMIT_KEY, 8000)
    assert as_map(rerank.rerank_knn(asked, coded[32], 10, 10, "thermo8", "f16")) == want


def test_all_candidates_make_rerank_exact(coded):
    asked = queries(coded[32], variant="sign")
    assert as_map(rerank.rerank_knn(asked, coded[32], 10, 50, "sign", "f32")) == as_map(
        knn.exact_knn(queries(coded[32]), coded[32], 10)
    )


def test_recall_counts_sets(spark):
    truth = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)] + [(2, 9)], "qid bigint, vec_id bigint")
    found = spark.createDataFrame([(1, i) for i in (2, 4, 9, 2)], "qid bigint, vec_id bigint")
    assert {r.qid: r.recall for r in evaluate.recall_at_k(found, truth).collect()} == {1: 0.5, 2: 0.0}


def test_column_distances(spark, unit):
    q = unit.first().f32
    rows = unit.select(
        "f32",
        fv.cosine_distance("f32", F.lit(q).cast("array<float>")).alias("c"),
        fv.inner_product("f32", F.lit(q).cast("array<float>")).alias("d"),
    ).collect()
    x, y = np.array([r.f32 for r in rows], float), np.array(q, float)
    assert [r.d for r in rows] == pytest.approx(x @ y)
    assert [r.c for r in rows] == pytest.approx(1 - x @ y / np.linalg.norm(x, axis=1) / np.linalg.norm(y), abs=1e-12)


def test_a_pilot_changes_the_shuffle_and_not_the_result(spark, coded, tmp_path):
    path = str(tmp_path / "items")
    coded[64].repartition(20).write.parquet(path)
    table, pilot = spark.read.parquet(path), knn.pilot_files(spark, path, 0.2)
    assert 0 < pilot.count() < 250
    asked = queries(coded[64], variant="sign")
    for run in (
        lambda p: knn.exact_knn(queries(coded[64]), table, 10, pilot=p),
        lambda p: knn.hamming_knn(asked, table, 10, "sign", p),
        lambda p: rerank.rerank_knn(asked, table, 5, 4, "sign", "f32", p),
    ):
        assert run(pilot).orderBy("qid", "rk").collect() == run(None).orderBy("qid", "rk").collect()
    block = next(knn.query_blocks(asked))
    bound = knn.pilot_bound(pilot, block, 10, "f32", "cosine")
    free, held = (knn.scan_block(table, block, 10, "f32", "cosine", b).count() for b in (None, bound))
    assert held < 0.7 * free
    # A pilot too small to hold k rows bounds nothing.
    few = knn.exact_knn(queries(coded[64]), table, 10, pilot=table.filter("vec_id < 5"))
    assert few.orderBy("qid", "rk").collect() == knn.exact_knn(queries(coded[64]), table, 10).orderBy("qid", "rk").collect()


def test_recall_takes_one_shuffle_of_pairs_and_counts_sets(spark):
    """Rows found twice count once, a query without a result counts, one without a true row does not, rows without id never match."""
    frame = lambda rows: spark.createDataFrame(rows, "qid bigint, vec_id bigint")
    truth = frame([(1, 10), (1, 11), (1, 11), (1, None), (2, 10), (None, 5)])
    found = frame([(1, 11), (1, 11), (1, 12), (1, None), (3, 10), (None, 5)])
    assert {r.qid: r.recall for r in evaluate.recall_at_k(found, truth).collect()} == {1: 1 / 3, 2: 0.0, None: 0.0}
    assert evaluate.recall_at_k(found, truth)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
