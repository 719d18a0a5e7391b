import numpy as np
import pytest
from conftest import brute_knn, vectors
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.operators import evaluate, graph, ivf, knn, prep
from nearfield.plans import grid
from nearfield.session import materialise


def neighbours(links):
    return {r.vec_id: [n.dst for n in r.nbrs] for r in links.collect()}


def brute_graph(x, degree):
    ids = np.arange(len(x))
    return {int(i): brute_knn(np.delete(x, i, 0), np.delete(ids, i), x[i], degree) for i in ids}


@pytest.mark.parametrize("cell_rows", [4096, 37])
def test_exact_graph(spark, cell_rows):
    x = np.random.default_rng(1).normal(size=(200, 12)).astype(np.float32)
    table = vectors(spark, x.tolist(), "f32").repartition(3)
    got = neighbours(graph.knn_graph(table, 5, cell_rows=cell_rows))
    assert got == brute_graph(x.astype(float), 5)


def test_a_third_of_the_table_is_one_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[::3] = x[0]
    x[[1, 4]] = x[7]
    table = vectors(spark, x.tolist(), "f32").repartition(5)
    got = neighbours(graph.knn_graph(table, 4, cell_rows=50))
    assert got == brute_graph(x.astype(float), 4)
    # Only the first copies take part in the comparison of rows.
    crowd = graph.crowds(table, "f32", 5)
    assert [(r.first, r.last) for r in crowd.collect()] == [(0, 12)]
    targets, sources = graph._sides(table, "f32", crowd, 1)
    assert (targets.count(), sources.count()) == (300 - 95, 300 - 99)


def test_blocked_graph_with_all_lists_is_exact(spark):
    x = np.random.default_rng(6).normal(size=(150, 8)).astype(np.float32)
    table = vectors(spark, x.tolist(), "f32")
    lists = ivf.seed_centroids(table, 6)
    whole = neighbours(graph.knn_graph(table, 4, "f32", lists, 6, cell_rows=20))
    assert whole == brute_graph(x.astype(float), 4)
    part = neighbours(graph.knn_graph(table, 4, "f32", lists, 2))
    assert sum(part[i] == whole[i] for i in whole) < 150


def test_refinement_rounds_approach_the_exact_graph(spark):
    x = np.random.default_rng(11).normal(size=(200, 8)).astype(np.float32)
    table = vectors(spark, x.tolist(), "f32")
    exact = brute_graph(x.astype(float), 5)

    def hits(links):
        return sum(len(set(near) & set(exact[i])) for i, near in neighbours(links).items())

    rough = materialise(graph.knn_graph(table, 5, "f32", ivf.seed_centroids(table, 10), 2), "rough")
    once = materialise(graph.refine(graph.undirected(rough, 10), table, 5), "refined")
    twice = graph.refine(graph.undirected(once, 10), table, 5)
    got = [hits(links) for links in (rough, once, twice)]
    assert got[0] < got[1] < got[2] <= 1000


def test_undirected_bounds_a_hub(spark):
    rows = [(i, [(0.1 + i / 1000, 0)]) for i in range(1, 200)] + [(0, [(0.101, 1)])]
    links = spark.createDataFrame(rows, "vec_id bigint, nbrs array<struct<dist:double,dst:bigint>>")
    got = neighbours(graph.undirected(links, 6))
    assert got[0] == [1, 2, 3, 4, 5, 6]
    assert all(got[i] == [0] for i in range(1, 200))


def test_pruning_rule(spark):
    x = np.random.default_rng(8).normal(size=(80, 3)).astype(np.float32)
    table = vectors(spark, x.tolist(), "f32")
    links = graph.knn_graph(table, 10)
    got = neighbours(graph.prune(links, table, 10, alpha=1.2))
    norm = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - norm.astype(float) @ norm.T.astype(float)
    for i, near in neighbours(links).items():
        kept = []
        for j in near:
            if all(1.2 * dist[p, j] > dist[i, j] for p in kept):
                kept.append(j)
        assert got[i] == kept
    capped = neighbours(graph.prune(links, table, 2, alpha=1.2))
    assert all(capped[i] == got[i][:2] for i in got)


@pytest.fixture(scope="module")
def linked(unit):
    links = graph.undirected(graph.knn_graph(unit, 8), 16)
    return materialise(graph.nodes(links, unit, "f32"), "nodes")


def test_beam_search(unit, linked):
    asked = prep.as_queries(unit.filter("vec_id % 50 = 7"))
    truth = knn.exact_knn(asked, unit, 10).cache()
    got = [
        evaluate.mean_recall(graph.graph_knn(asked, linked, 10, ef, hops, max_degree=16), truth).first().recall
        for ef, hops in ((10, 1), (20, 3), (100, 6))
    ]
    assert got == sorted(got) and got[1] > 0.9 and got[2] == 1.0


def test_beam_beyond_the_broadcast_limit(unit, linked, conf):
    asked = prep.as_queries(unit.filter("vec_id % 100 = 7"))
    rows = lambda found: found.orderBy("qid", "rk").collect()
    want = rows(graph.graph_knn(asked, linked, 10, 20, 2, max_degree=16))
    conf(settings.BROADCAST_LIMIT_KEY, 6000)
    assert rows(graph.graph_knn(asked, linked, 10, 20, 2, max_degree=16)) == want


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_hop_of_a_small_beam_ships_its_rows_and_scans_once(spark, unit, linked):
    """A beam that is a table took a shuffle for its new rows, another for its best ones and a write for every hop."""
    asked = prep.as_queries(unit.filter("vec_id % 100 = 7"))
    few, many = (
        jobs_of(spark, f"hops-{hops}", lambda hops=hops: graph.graph_knn(asked, linked, 10, 20, hops, max_degree=16).collect())
        for hops in (1, 4)
    )
    assert many - few <= 2 * 3


@pytest.mark.parametrize("hops", [0, 1, 3])
def test_small_and_large_beams_agree(embeddings, thresholds, conf, hops):
    """On codes, whose distances tie, with rows whose links are few, missing or lead nowhere."""
    table = prep.represent(embeddings, 64, 64, ("f32", "code_mean"), thresholds)
    links = graph.undirected(graph.knn_graph(table, 4, "code_mean"), 8)
    few = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<bigint>")).when(F.col("vec_id") % 7 == 1, F.array(F.lit(10**6)))
    stored = graph.nodes(links, table, "f32", "code_mean").withColumn("nbr_ids", few.otherwise(F.col("nbr_ids")))
    stored = materialise(stored, "nodes")
    asked = prep.as_queries(table.filter("vec_id % 60 = 7"), "f32", "mean")
    rows = lambda: graph.graph_rerank(asked, stored, 10, 3, "mean", "f32", hops, max_degree=8).orderBy("qid", "rk").collect()
    held = rows()
    conf(settings.BROADCAST_LIMIT_KEY, 20_000)
    assert rows() == held and len(held) == 10 * asked.count()


def test_undirected_shuffles_links_by_pair_and_by_row(spark):
    links = spark.createDataFrame([(0, [(0.1, 1)])], "vec_id bigint, nbrs array<struct<dist:double,dst:bigint>>")
    text = graph.undirected(links, 6)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 2 and "WindowGroupLimit" in text


def test_code_graph_with_rerank(embeddings, thresholds, unit):
    table = prep.represent(embeddings, 64, 64, ("f32", "code_thermo8"), thresholds)
    links = graph.undirected(graph.knn_graph(table, 8, "code_thermo8"), 16)
    stored = materialise(graph.nodes(links, table, "f32", "code_thermo8"), "nodes")
    asked = prep.as_queries(table.filter("vec_id % 50 = 7"), "f32", "thermo8")
    found = graph.graph_rerank(asked, stored, 10, 10, "thermo8", "f32", 4, max_degree=16)
    truth = knn.exact_knn(prep.as_queries(unit.filter("vec_id % 50 = 7")), unit, 10)
    assert evaluate.mean_recall(found, truth).first().recall > 0.9
    assert found.groupBy("qid").count().filter(F.col("count") != 10).isEmpty()


def test_rows_are_placed_in_one_pass(spark):
    """A row took one look for the list that holds it and another for those it looks into, each in a scan of its own."""
    x = np.random.default_rng(9).normal(size=(120, 6)).astype(np.float32)
    table = materialise(vectors(spark, x.tolist(), "f32"), "rows")
    lists = ivf.seed_centroids(table, 5)
    text = graph.knn_graph(table, 4, "f32", lists, 2)._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and text.count("FileScan") == 1


def test_a_grid_releases_what_an_index_has_left(spark, embeddings, monkeypatch):
    """After every index, not every cell; else the driver's heap holds the broadcasts of hundreds of jobs."""
    calls = []
    monkeypatch.setattr(grid, "release", lambda session, release=grid.release: calls.append(release(session)))
    profile = grid.Profile(k=5, overfetch=2, lists=4, steps=1)
    found = grid.run_grid(embeddings, embeddings.select("vec_id").limit(3), [16], 64, profile, ["exact"], False).collect()
    assert [r.status for r in found] == ["ok", "ok"] and len(calls) == 2
