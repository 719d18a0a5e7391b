"""Rerank from row groups that hold candidates."""

import numpy as np
import pytest
from conftest import TESTDATA, as_map
from pyspark.sql import functions as F

from nearfield.operators import ivf, late, prep, rerank


def test_merged_ranges():
    assert late.merged_ranges(np.array([], int)) == []
    assert late.merged_ranges(np.array([5, 3, 4, 3])) == [(3, 5)]
    assert late.merged_ranges(np.array([1, 2, 9, 50, 51]), 8) == [(1, 2), (9, 9), (50, 51)]
    assert late.merged_ranges(np.array([1, 2, 9, 50, 51]), 2) == [(1, 9), (50, 51)]
    assert late.merged_ranges(np.array([1, 2, 9, 50, 51]), 1) == [(1, 51)]
    assert late.merged_ranges(np.arange(0, 2000, 2), 64)[0][0] == 0 and len(late.merged_ranges(np.arange(0, 2000, 2), 64)) == 64


@pytest.fixture(scope="module")
def stored(spark, thresholds, tmp_path_factory):
    # Parquet's row groups have a hundred rows or more, so the table needs many of these.
    raw = spark.read.parquet(f"{TESTDATA}/sf0.1/embeddings.parquet")
    table = prep.represent(raw, 64, 64, ("f32", "code_thermo4"), thresholds)
    path = str(tmp_path_factory.mktemp("late") / "sorted")
    late.write_sorted(table, ivf.train_centroids(table, 40, 2), path, group_bytes=1 << 14, files=2)
    return late.read_sorted(spark, path)


def scanned(df) -> int:
    """Rows that the only scan of ``df`` gave, before any filter of Spark's own."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_sorted_by_list(stored):
    rows = stored.select("list_id", "vec_id", F.input_file_name().alias("file")).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == stored.count()
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append((r.list_id, r.vec_id))
    # Every file is sorted, and no two overlap.
    assert len(files) == 2 and sum(sorted(files.values(), key=lambda f: f[0]), []) == sorted((r.list_id, r.vec_id) for r in rows)


@pytest.mark.parametrize("most", [1, 64])
def test_same_answer_as_the_plain_rerank(stored, most):
    asked = prep.as_queries(stored.filter("vec_id % 100 = 3"), "f32", "thermo4")
    want = as_map(rerank.rerank_knn(asked, stored, 5, 4, "thermo4", "f32"))
    assert as_map(late.rerank_late(asked, stored, 5, 4, "thermo4", "f32", most)) == want and len(want) > 3


def test_only_row_groups_of_candidates_are_read(stored):
    count = stored.count()
    some = stored.filter("list_id = 7").select("vec_id")
    lists = late.lists_of(stored, some, some.count())
    assert lists.tolist() == [7]
    near = late.rows_near(stored, lists).select("vec_id", "f32")
    assert near.count() == some.count()
    assert some.count() <= scanned(near) < count / 3
    assert scanned(stored.select("vec_id", "f32")) == count
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(list_id,7)" in plan and "code_thermo4" not in plan


def test_no_candidates(stored):
    assert late.rows_near(stored, np.array([], int)).isEmpty()
    none = prep.as_queries(stored.filter("vec_id < 0"), "f32", "thermo4")
    assert late.rerank_late(none, stored, 5, 4, "thermo4", "f32").isEmpty()
