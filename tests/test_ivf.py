import numpy as np
import pytest
from conftest import as_map, vectors
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks, codes
from nearfield.operators import evaluate, ivf, knn, metrics, prep, rabitq


@pytest.fixture(scope="module")
def asked(unit):
    return prep.as_queries(unit.filter("vec_id % 50 = 7"))


@pytest.fixture(scope="module")
def truth(unit, asked):
    return knn.exact_knn(asked, unit, 10).cache()


@pytest.fixture(scope="module")
def index(unit):
    built = ivf.ivf_build(unit, ivf.train_centroids(unit, 50, 2))
    return built._replace(postings=built.postings.cache())


def recall(found, truth):
    return evaluate.mean_recall(found, truth).first().recall


def test_all_lists_are_exact_and_more_never_hurts(index, asked, truth):
    got = [recall(ivf.ivf_knn(asked, index, 10, p), truth) for p in (1, 4, 16, 50)]
    assert got == sorted(got) and got[-1] == 1.0 and got[0] < 1.0


def test_lists_are_nearest_centroids(index):
    rows = index.postings.collect()
    x = np.array([r.f32 for r in rows], float)
    dist = metrics.Cosine.coarse(x, index.centroids)
    assert [r.list_id for r in rows] == dist.argmin(1).tolist()


def test_equal_centroids_go_to_the_lower_list(spark):
    centroids = np.array([[0.0, 1.0, 3.0], [1.0, 2.0, 2.0], [1.0, 2.0, 2.0]])
    df = vectors(spark, [[1, 2, 2.1]] * 40, "f32").repartition(3)
    got = df.select(ivf.nearest_list(spark, F.col("f32"), centroids).alias("l"))
    assert {r.l for r in got.collect()} == {1}


def test_lloyd_lowers_the_distance(unit):
    start = ivf.seed_centroids(unit, 20)
    moved = ivf.updated_centroids(ivf.lloyd_step(unit, start), start)
    x = np.array([r.f32 for r in unit.collect()], float)
    cost = [metrics.Cosine.coarse(x, c).min(1).sum() for c in (start, moved)]
    assert cost[1] < cost[0]
    assert np.linalg.norm(moved, axis=1) == pytest.approx(np.ones(20))


def test_an_empty_list_keeps_its_centroid(spark):
    df = vectors(spark, [[1, 0], [0.9, 0.1]], "f32")
    start = np.array([[1.0, 0.0], [-1.0, 0.0]])
    moved = ivf.updated_centroids(ivf.lloyd_step(df, start), start)
    assert moved[1].tolist() == [-1.0, 0.0] and moved[0, 1] > 0


def test_sums_of_a_step_are_added_on_the_driver_or_by_a_shuffle(unit, conf, monkeypatch):
    seeds = ivf.seed_centroids(unit, 20)
    want = ivf.updated_centroids(ivf.lloyd_step(unit, seeds), seeds)
    assert np.allclose(ivf.gathered_step(unit, seeds), want, rtol=0, atol=1e-12)
    shuffled = []
    monkeypatch.setattr(ivf, "lloyd_step", lambda *args, step=ivf.lloyd_step: shuffled.append(1) or step(*args))
    small = ivf.train_centroids(unit, 20, 2)
    assert not shuffled
    conf(settings.BROADCAST_LIMIT_KEY, seeds.nbytes)
    assert np.allclose(ivf.train_centroids(unit, 20, 2), small, rtol=0, atol=1e-12) and len(shuffled) == 2


def test_training_reads_all_rows_unless_asked(spark, unit):
    assert ivf.train_sample(unit, "f32").count() == unit.count()
    assert 120 < ivf.train_sample(unit, "f32", 200).count() < 300
    assert ivf.train_centroids(unit, 10, 1, sample_rows=200).shape == (10, 64)
    long = spark.range(12_000).withColumnRenamed("id", "vec_id").withColumn("f32", F.array(F.lit(1.0)))
    assert ivf.train_sample(long, "f32").count() == 12_000


def test_kmeans_centroids_serve_as_an_index(unit, asked, truth):
    index = ivf.ivf_build(unit, ivf.train_kmeans(unit, 20))
    assert recall(ivf.ivf_knn(asked, index, 10, 20), truth) == 1.0


def test_centroids_above_the_limit_are_refused(unit, conf):
    conf(settings.BROADCAST_LIMIT_KEY, 1000)
    with pytest.raises(ValueError, match="fewer lists"):
        ivf.seed_centroids(unit, 50)


def scanned_partitions(df) -> int:
    """Partitions the scan really read, from the metrics of a finished run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stack, read = [plan], 0
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            stack.append(node.plan())
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            read += node.metrics().apply("numPartitions").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return read


def test_stored_index_reads_only_probed_lists(spark, index, asked, truth, tmp_path):
    path = str(tmp_path / "index")
    ivf.write_index(index, path)
    stored = ivf.read_index(spark, path)
    assert np.array_equal(stored.centroids, index.centroids)
    one = asked.filter("qid = 57")
    found = ivf.ivf_knn(one, stored, 10, 4)
    assert as_map(found) == as_map(ivf.ivf_knn(one, index, 10, 4))
    assert scanned_partitions(found) == 4
    assert recall(ivf.ivf_knn(asked, stored, 10, 50), truth) == 1.0


def test_a_hot_list_is_written_in_pieces(spark, conf, tmp_path):
    # Small test partitions would be merged again.
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile([1.0, 0, 0], (400, 1)), rng.normal(size=(200, 3))])
    table = vectors(spark, x.tolist(), "f32")
    index = ivf.ivf_build(table, np.eye(3))
    path = str(tmp_path / "hot")
    ivf.write_index(index, path, rows_per_file=60)
    hot = spark.read.parquet(f"{path}/postings/list_id=0")
    assert len(hot.inputFiles()) > 1
    assert spark.read.parquet(f"{path}/postings").count() == 600


@pytest.mark.parametrize("variant", ["mean", "thermo8"])
def test_code_lists(embeddings, thresholds, truth, variant):
    code, nbits = f"code_{variant}", 64 * codes.bits_per_dim(variant)
    table = prep.represent(embeddings, 64, 64, ("f32", code), thresholds).cache()
    both = prep.as_queries(table.filter("vec_id % 50 = 7"), "f32", variant)
    lists = ivf.train_code_centroids(table, 30, nbits, 2, code)
    index = ivf.ivf_build(table, lists, code)
    got = [recall(ivf.ivf_rerank(both, index, 10, 10, p, variant, "f32"), truth) for p in (5, 30)]
    assert got[0] <= got[1] and got[1] >= 0.9
    every = ivf.ivf_rerank(both, index, 10, 50, 30, variant, "f32")
    assert recall(every, truth) == 1.0


def test_rotation_keeps_lengths():
    assert [rabitq.padded_dim(d) for d in (1, 2, 3, 64, 65)] == [1, 2, 4, 64, 128]
    x = np.random.default_rng(0).normal(size=(5, 24))
    y = rabitq.rotate(x)
    assert y.shape == (5, 32)
    assert y @ y.T == pytest.approx(x @ x.T)


@pytest.mark.parametrize("residual", [True, False])
def test_rabitq(unit, index, asked, truth, residual):
    coded = rabitq.rabitq_build(index, residual)
    some, every = (recall(rabitq.rabitq_knn(asked, coded, 10, p), truth) for p in (8, 50))
    assert some <= recall(ivf.ivf_knn(asked, index, 10, 8), truth)
    assert every >= 0.98
    wide = rabitq.rabitq_knn(asked, coded, 10, 50, epsilon=50.0)
    assert recall(wide, truth) == 1.0
    rough = recall(rabitq.rabitq_estimate(asked, coded, 10, 50), truth)
    assert 0.2 < rough < 1.0


@pytest.mark.parametrize("residual", [True, False])
def test_rabitq_bounds_hold_mostly(unit, index, asked, residual):
    rows = rabitq.rabitq_build(index, residual).ivf.postings.collect()
    q = blocks.unit_rows(np.array([r.qv for r in asked.collect()], float))
    low = total = 0
    for row in rows:
        centre = blocks.unit_rows(index.centroids)[row.list_id] if residual else None
        score = rabitq._ListScore(q, centre, 1.9)
        signs = rabitq._signs(np.array([row.rq_code]), 64)
        estimate, error = score.parts(signs, np.array([row.rq_norm]), np.array([row.rq_dot]))
        true = metrics.Cosine.coarse(np.array([row.f32], float), q)
        low += (estimate - error > true + 1e-9).sum()
        total += estimate.size
    assert 0 <= low / total < 0.05


@pytest.mark.parametrize("residual", [True, False])
def test_rabitq_planes(unit, index, asked, truth, residual):
    coded = rabitq.rabitq_build(index, residual)
    every = recall(rabitq.rabitq_knn(asked, coded, 10, 50, planes=True), truth)
    assert every >= recall(rabitq.rabitq_knn(asked, coded, 10, 50), truth) - 0.01 and every >= 0.98
    assert recall(rabitq.rabitq_knn(asked, coded, 10, 50, epsilon=50.0, planes=True), truth) == 1.0


@pytest.mark.parametrize("dim", [5, 64, 130])
def test_rabitq_planes_stay_within_their_rounding(dim):
    rng = np.random.default_rng(dim)
    q = blocks.unit_rows(rng.normal(size=(7, dim)))
    q[3] = 0.0  # no direction
    turned, norms = rabitq._direction(rng.normal(size=(40, dim)))
    codes = blocks.pack_bits((turned > 0).astype(np.uint8))
    dots = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    plain = rabitq._ListScore(q, None, 1.9).of_codes(codes, norms, dots)
    score = rabitq._PlaneScore(q, None, 1.9)
    estimate, error = score.of_codes(codes, norms, dots)
    level = sum(blocks.unpack_bits(plane, turned.shape[1]).astype(int) << p for p, plane in enumerate(score.planes))
    bits = blocks.unpack_bits(codes, turned.shape[1]).astype(int)
    assert (score.common(codes) == bits @ level.T).all()
    # What the rounding moves an estimate by lies within what it adds to the bound.
    assert (np.abs(estimate - plain[0]) <= error - plain[1] + 1e-12).all()
    assert (np.abs(estimate - plain[0])[:, :3] > 0).any()


def test_rabitq_of_copies_and_centroids(spark):
    x = np.tile(np.array([[0.6, 0.8, 0.0, 0.0]], np.float32), (50, 1))
    x[10:20] = [[0.0, 0.6, 0.8, 0.0]]
    table = vectors(spark, x.tolist(), "f32").repartition(4)
    index = rabitq.rabitq_build(ivf.ivf_build(table, x[[0, 10]].astype(float)))
    assert index.ivf.postings.filter("rq_norm <> 0").isEmpty()
    asked = prep.as_queries(table.filter("vec_id = 30"))
    assert as_map(rabitq.rabitq_knn(asked, index, 12, 2)) == {30: [*range(10), 20, 21]}


def test_mixed_and_sorted_batches_agree(spark, index, asked, conf):
    want = as_map(ivf.ivf_knn(asked, index, 10, 6))
    by_list = index._replace(postings=index.postings.repartition(2, "list_id").sortWithinPartitions("list_id"))
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    assert as_map(ivf.ivf_knn(asked, by_list, 10, 6)) == want
    ivf_rows, ivf.ROWS_PER_STEP = ivf.ROWS_PER_STEP, 0
    try:
        assert as_map(ivf.ivf_knn(asked, index, 10, 6)) == want
    finally:
        ivf.ROWS_PER_STEP = ivf_rows
