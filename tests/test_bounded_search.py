"""Searches that bound what they read or hand on: counted radii, certified lists, two-level lists."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import as_map, vectors
from pyspark.sql import functions as F

from nearfield.operators import certified, ivf, knn, radius, two_level
from nearfield.operators.knn import query_blocks
from nearfield.operators.metrics import Hamming

# --- counted radii ------------------------------------------------------------------------


def code_rows(n=600, words=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(2**63), 2**63, (n, words), dtype=np.int64)
    x[: n // 3] = x[0]  # a third of the rows share a code
    x[n // 3 : n // 2] = x[0] ^ (1 << rng.integers(0, 20, (n // 2 - n // 3, words)))
    return x


def code_table(spark, x, ids):
    rows = [(int(i), None if c is None else [int(w) for w in c]) for i, c in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, code_sign array<bigint>")


def asked_codes(table, ids):
    return table.filter(F.col("vec_id").isin(ids)).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("qid"), F.col("code_sign").alias("qcode"))


def brute_hamming(x, ids, asked, k):
    out = {}
    for qid in asked:
        dist = Hamming.coarse(x, x[ids.index(qid)][None])[:, 0]
        out[qid] = sorted(zip(dist.tolist(), ids, strict=True))[:k]
    return out


@pytest.mark.parametrize("k", [1, 7, 50, 5000])
def test_counted_radius_equals_brute_force(spark, k):
    x = code_rows()
    ids = [int(i) for i in np.random.default_rng(2).permutation(np.arange(-300, 300) * 10**15)]
    table = code_table(spark, x, ids).union(code_table(spark, [None], [77])).repartition(9).cache()
    asked = [ids[0], ids[5], ids[250], ids[599]]
    found = radius.hamming_radius_knn(asked_codes(table, asked), table, k, "sign").collect()
    got = {q: [(r.dist, r.vec_id) for r in sorted(found, key=lambda r: r.rk) if r.qid == q] for q in asked}
    assert got == brute_hamming(x, ids, asked, k)
    same = knn.hamming_knn(asked_codes(table, asked), table, k, "sign")
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in found}


def test_rows_handed_on_do_not_grow_with_tasks(spark):
    x, ids = code_rows(3000), list(range(3000))
    table = code_table(spark, x, ids)
    asked, k = [0, 1, 1400, 2999], 10
    handed = []
    for tasks in (4, 64):
        dealt = table.repartition(tasks)
        (block,) = query_blocks(asked_codes(table, asked))
        rows = radius.rows_within(dealt, block, "code_sign", k)
        handed.append(sorted(map(tuple, rows.collect())))
    assert handed[0] == handed[1] and len(handed[0]) <= len(asked) * 3 * k


def test_counted_radius_of_odd_tables(spark):
    table = code_table(spark, code_rows(20), [5] * 12 + list(range(8)))  # ids that repeat
    found = radius.hamming_radius_knn(asked_codes(table, [5]), table, 4, "sign").collect()
    assert [(r.rk, r.dist) for r in sorted(found)] == [(i, 0) for i in range(1, 5)]
    none = table.limit(0)
    assert radius.hamming_radius_knn(asked_codes(table, [3]), none, 4, "sign").count() == 0
    assert radius.hamming_radius_knn(asked_codes(none, [3]), table, 4, "sign").count() == 0


def test_radii():
    counts = np.array([[0, 2, 3, 0, 9], [0, 0, 0, 1, 0], [4, 0, 0, 0, 0]])
    within, below, tied = radius.radii(counts, 4)
    assert within.tolist() == [2, 4, 0] and below.tolist() == [2, 1, 0] and tied.tolist() == [3, 0, 4]


# --- certified lists ------------------------------------------------------------------------


def clustered(n=1200, centres=24, width=16, noise=0.05, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return middle, middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * noise


def float_table(spark, x):
    return vectors(spark, [r.tolist() for r in x], "f32").repartition(6).cache()


def asked_floats(table, ids):
    return table.filter(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("qid"), F.col("f32").alias("qv"))


@pytest.mark.parametrize("noise", [0.05, 5.0])
def test_certified_lists_give_the_full_answer(spark, noise):
    middle, x = clustered(noise=noise)
    table = float_table(spark, x)
    asked = asked_floats(table, list(range(0, 1200, 100)))
    index = ivf.ivf_build(table, middle)
    spread, read = certified.list_spread(index), []
    found = certified.certified_knn(asked, index, spread, 10, read=read)
    assert as_map(found) == as_map(knn.exact_knn(asked, table, 10))
    assert spread.rows.sum() == 1200
    ((pairs, every),) = read
    assert pairs < every / 4 if noise < 1 else pairs <= every


def test_certified_lists_of_few_rows(spark):
    middle, x = clustered(n=30)
    x[3:20] = x[3]
    table = float_table(spark, x)
    asked = asked_floats(table, [0, 4, 29])
    index = ivf.ivf_build(table, middle)
    for k in (1, 5, 100):
        found = certified.certified_knn(asked, index, certified.list_spread(index), k)
        assert as_map(found) == as_map(knn.exact_knn(asked, table, k))
    none = ivf.ivf_build(table.limit(0), middle)
    assert certified.certified_knn(asked, none, certified.list_spread(none), 5).count() == 0
    assert certified.certified_knn(asked.limit(0), index, certified.list_spread(index), 5).count() == 0


# --- two-level lists ------------------------------------------------------------------------


def test_two_levels_with_every_list_are_exact(spark):
    _, x = clustered(noise=0.5)
    table = float_table(spark, x)
    index = two_level.two_level_build(table, ivf.seed_centroids(table, 5), rows_per_list=40, cell_rows=64)
    asked = asked_floats(table, [0, 17, 500, 1199])
    found = two_level.two_level_knn(asked, index, 10, 5, 10_000)
    assert as_map(found) == as_map(knn.exact_knn(asked, table, 10))
    assert two_level.two_level_knn(asked.limit(0), index, 10, 2, 4).count() == 0


def test_two_level_assignment(spark):
    _, x = clustered(noise=0.5)
    table = float_table(spark, x)
    coarse = ivf.seed_centroids(table, 5)
    index = two_level.two_level_build(table, coarse, rows_per_list=40, cell_rows=64)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    fine = {}
    for r in index.fine.collect():
        fine.setdefault(r.coarse_id, []).append(r.list_id)
    rows = index.postings.collect()
    assert sorted(r.vec_id for r in rows) == list(range(1200))
    for r in rows:
        assert r.coarse_id == np.argmax(coarse / np.linalg.norm(coarse, axis=1)[:, None] @ unit[r.vec_id])
        near = fine[r.coarse_id]
        assert unit[near] @ unit[r.vec_id] @ np.eye(len(near))[near.index(r.list_id)] >= (unit[near] @ unit[r.vec_id]).max() - 1e-9
    again = two_level.two_level_build(table.repartition(3), coarse, rows_per_list=40, cell_rows=1000)
    assert {tuple(r[:3]) for r in again.postings.collect()} == {tuple(r[:3]) for r in rows}


def test_lists_stay_bounded_as_rows_grow(spark):
    """Twice the rows make about twice the lists, not longer ones; nothing that is broadcast grows."""
    mean = []
    for n in (600, 2400):
        _, x = clustered(n=n, noise=0.5)
        table = float_table(spark, x)
        index = two_level.two_level_build(table, ivf.seed_centroids(table, 4), rows_per_list=30)
        sizes = [r["count"] for r in index.postings.groupBy("list_id").count().collect()]
        mean.append(np.mean(sizes))
        assert index.fine.count() >= n / 30 / 2 and len(index.coarse) == 4
    assert mean[1] < 2 * mean[0]


def test_two_levels_of_odd_rows(spark):
    rows = [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 3 + [None]
    table = vectors(spark, rows, "f32").union(spark.createDataFrame([(None, [1.0, 0.0])], "vec_id bigint, f32 array<float>"))
    index = two_level.two_level_build(table, np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), rows_per_list=8)
    assert index.postings.count() == 43
    found = two_level.two_level_knn(asked_floats(table, [0]), index, 5, 3, 100)
    assert as_map(found) == {0: [0, 1, 2, 3, 4]}
    none = two_level.two_level_build(table.limit(0), np.array([[1.0, 0.0]]))
    assert none.postings.count() == 0
    assert two_level.two_level_knn(asked_floats(table, [0]), none, 5, 1, 4).count() == 0
