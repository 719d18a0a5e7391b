"""Every registered query against its SQL statement in an embedded database."""

import pathlib

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry
from nearfield.plans import oracles, registry

SF_DIR = f"{TESTDATA}/sf0.001"
QUERIES, ORACLES = registry.queries(), oracles.oracle_sql()
# Measured times, Spark ML's own clustering and rounds until nothing changes have no SQL form.
ROWS_ONLY = {"benchmark_results", "benchmark_results_graph", "ivf_train_kmeans", "knn_graph_descent"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in pathlib.Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_registries_agree():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    want = db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: str(got[c].dtype) for c in columns} == {c: str(want[c].dtype) for c in columns}
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rk", "vec_id", "dist"] and df.count() == 100


def test_kmeans_covers_the_corpus(spark):
    rows = QUERIES["ivf_train_kmeans"](spark, SF_DIR).collect()
    assert sum(r.n for r in rows) == 500


def test_registered_grids_have_every_dimension(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.grid, "run_grid", lambda corpus, ids, dims, *rest, **named: asked.append((dims, rest, named)))
    for name in ("benchmark_results", "benchmark_results_graph"):
        QUERIES[name](spark, SF_DIR)
    held = {m for _, rest, _ in asked for m in rest[2]}
    assert held == {*registry.grid.FLOAT_METHODS, *registry.grid.CODE_METHODS}
    assert all(dims == [16, registry.DIM, registry.FULL] for dims, _, _ in asked)
    # Latencies are measured warm and alone.
    assert all(named.get("warm_up", True) and named.get("parallel", 1) == 1 for _, _, named in asked)


def test_recall_grid_cells(db):
    rows = db.execute(ORACLES["benchmark_recall"]).df()
    assert len(rows) == 42 and rows.groupby("dimension").size().to_dict() == {16: 14, registry.DIM: 14, registry.FULL: 14}
