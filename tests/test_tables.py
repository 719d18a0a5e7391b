import pytest
from conftest import vectors
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.operators import prep
from nearfield.plans import grid
from nearfield.sources import tables
from nearfield.sources.vectors import hash_sample


def test_unified_and_single_precision(embeddings, thresholds):
    wide = tables.unified_table(embeddings, 16, 64, thresholds)
    assert wide.columns == ["vec_id", "f32", "f16", "code_sign", "code_mean", "code_thermo4", "code_thermo8"]
    onehot = tables.unified_table(embeddings, 16, 64, thresholds, "onehot")
    assert "code_onehot8" in onehot.columns
    single = tables.single_precision_table(wide, "halfvec")
    assert single.columns[:2] == ["vec_id", "embedding"]
    for call in (lambda: tables.single_precision_table(wide, "int8"), lambda: tables.unified_table(embeddings, 16, 64, thresholds, "gray")):
        with pytest.raises(ValueError, match="unknown"):
            call()
    with pytest.raises(ValueError, match="unknown representation"):
        prep.represent(embeddings, 16, 64, ("f64",))


def test_catalog_rebuilds_only_on_a_new_key(spark, embeddings, thresholds, tmp_path):
    catalog = tables.TableCatalog(spark, str(tmp_path / "catalog"))
    build = lambda corpus=embeddings, **kw: catalog.build("items_16", corpus, 16, 64, thresholds, **kw)
    assert build(data_source="a.parquet")
    assert not build(data_source="a.parquet")
    first = catalog.table("items_16").inputFiles()
    assert build(data_source="b.parquet")
    assert build(data_source="b.parquet", encoding="onehot")
    assert not build(data_source="b.parquet", encoding="onehot")
    assert build(data_source="b.parquet", encoding="onehot", skip_if_exists=False)
    changed = embeddings.withColumn(
        "embedding", F.when(F.col("vec_id") == 3, F.reverse("embedding")).otherwise(F.col("embedding"))
    )
    assert build(changed, data_source="b.parquet", encoding="onehot")
    assert build(data_source=None) and build(data_source=None)
    assert catalog.metadata().count() == 1
    assert catalog.table("items_16").inputFiles() != first and spark.read.parquet(*first).count() == 500
    assert catalog.thresholds("items_16").count() == 64
    assert catalog.size_bytes("items_16") > 0
    moved = thresholds._replace(t4=thresholds.t4 + 0.5)
    again = lambda cuts: catalog.build("items_16", embeddings, 16, 64, cuts, data_source="moved")
    assert [again(thresholds), again(thresholds), again(moved), again(moved)] == [True, False, True, False]
    assert str(tmp_path / "catalog") in catalog.table("items_16").inputFiles()[0]
    with pytest.raises(ValueError, match="no table"):
        catalog.table("items_99")


def test_fingerprint_ignores_order(embeddings):
    mark = tables.fingerprint(embeddings)
    assert mark == tables.fingerprint(embeddings.repartition(5))
    assert mark != tables.fingerprint(embeddings.filter("vec_id <> 7"))


def test_sizes_and_checks(spark):
    table = prep.represent(vectors(spark, [[1, 2], [3, 4], [0, 0]]), 2, 2, ("f32", "f16", "code_sign"))
    got = {r.representation: (r.num_rows, r.bytes) for r in tables.index_size(table).collect()}
    assert got == {"f32": (2, 16), "f16": (2, 8), "code_sign": (2, 16)}
    check = {r.column_name: r.usable for r in tables.table_check(table, 2, ("f32", "code_mean")).collect()}
    assert check == {"f32": True, "code_mean": False}
    assert not tables.table_check(table, 3, ("f32",)).first().usable


def test_grid_is_complete(embeddings):
    cells = grid.config_grid(embeddings, settings.DIMENSIONS)
    per_dim = {r.dimension: r["count"] for r in cells.groupBy("dimension").count().collect()}
    assert per_dim == {256: 27, 512: 27, 1024: 27}
    assert cells.filter("variant is null").count() == 27


@pytest.fixture(scope="module")
def small_run(embeddings):
    profile = grid.Profile(
        k=10, overfetch=10, lists=50, probes=8, probes_codes=24, rabitq_lists=50, rabitq_probes=8, degree=8, ef=20, hops=3, steps=1
    )
    asked = hash_sample(embeddings.select("vec_id"), 10, "query")
    return grid.run_grid(embeddings, asked, [64], 64, profile, warm_up=False, parallel=4).cache()


def test_every_cell_runs(small_run):
    rows = {(r.method, r.variant, r.storage): r for r in small_run.collect()}
    assert len(rows) == 27
    assert {r.status for r in rows.values()} == {"ok"}
    assert rows["exact", None, "float32"].recall == 1.0
    assert rows["exact_rerank", "thermo8", "float32"].recall == 0.99
    for (method, _, _), row in rows.items():
        assert (row.index_bytes == 0) == method.startswith("exact")
        assert row.recall > 0.3


def test_markdown(small_run):
    text = grid.markdown_table(small_run).splitlines()
    assert len(text) == 29 and text[0].startswith("| Index | Recall (%)")
    line = next(row for row in text if row.startswith("| exact | 100.0") and "float32" in row)
    assert line.count("|") == 9 and line.endswith("| 64 | float32 | 0.00 | 0.1 | 0.0 |")


def test_a_failed_cell_reports(embeddings):
    asked = hash_sample(embeddings.select("vec_id"), 3, "query")
    bad = grid.Profile(k=5, lists=0)
    rows = grid.run_grid(embeddings, asked, [16], 64, bad, ["exact", "ivf"], warm_up=False).collect()
    by_method = {r.method: r.status for r in rows}
    assert by_method["exact"] == "ok" and by_method["ivf"] != "ok"
    with pytest.raises(ValueError, match="unknown method"):
        grid.run_grid(embeddings, asked, [16], 64, methods=["ivfflat"])
