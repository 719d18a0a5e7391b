"""Shapes of physical plans, which decide whether a query survives a large table."""

import pytest
from pyspark.sql import functions as F

from nearfield.operators import knn, prep, rerank
from nearfield.session import materialise


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(embeddings, thresholds):
    return materialise(prep.represent(embeddings, 64, 64, ("f32", "f16", "code_sign", "code_thermo8"), thresholds), "t")


def test_top_k_is_limited_before_the_shuffle(stored):
    text = plan(knn.exact_knn(prep.as_queries(stored.filter("vec_id = 7")), stored, 10))
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("Exchange") == 1


def test_rerank_broadcasts_candidates_and_keeps_the_corpus_in_place(stored):
    asked = prep.as_queries(stored.filter("vec_id = 7"), "f32", "thermo8")
    text = plan(rerank.rerank_knn(asked, stored, 10, 10, "thermo8", "f32"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_a_code_scan_reads_no_floats(stored):
    asked = prep.as_queries(stored.filter("vec_id = 7"), None, "sign")
    text = plan(knn.hamming_knn(asked, stored, 10, "sign"))
    assert "code_sign" in text and "f32" not in text and "f16" not in text and "thermo8" not in text


def test_one_query_is_an_ordered_limit(stored):
    text = plan(knn.nearest_to([0.1] * 64, stored, 5))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_preparation_does_not_shuffle(embeddings, thresholds):
    text = plan(prep.represent(embeddings, 32, 64, ("f32", "code_mean"), thresholds))
    assert "Exchange" not in text and text.count("MapInArrow") == 1


def test_id_filters_reach_the_scan(stored):
    text = plan(stored.filter(F.col("vec_id") <= 9).select("vec_id"))
    assert "PushedFilters: [IsNotNull(vec_id), LessThanOrEqual(vec_id,9)]" in text
