"""Centroid seeds by oversampling."""

import numpy as np
import pytest
from conftest import vectors

from nearfield.functions import blocks
from nearfield.operators import seeding


def nearest(x, centres):
    return 1 - (blocks.unit_rows(x) @ blocks.unit_rows(centres).T).max(axis=1)


def test_draw_depends_on_rows_alone(unit):
    one, other = (seeding.draw_centres(t, 10, rounds=2) for t in (unit, unit.repartition(7, "vec_id")))
    assert (one.ids == other.ids).all() and (one.rounds == other.rounds).all() and (one.vectors == other.vectors).all()
    assert len(set(one.ids.tolist())) == len(one.ids) and one.rounds[0] == 0 and set(one.rounds.tolist()) == {0, 1, 2}
    # About two centres for each list in each round.
    assert 20 <= len(one.ids) <= 60
    rows = unit.collect()
    x = np.array([r.f32 for r in rows], float)
    held = seeding.weights(unit, one).collect()
    at = np.argmax(blocks.unit_rows(x) @ blocks.unit_rows(one.vectors).T, axis=1)
    assert {r.list_id: r.n for r in held} == {i: n for i, n in enumerate(np.bincount(at).tolist()) if n}


def test_small_clusters_beside_a_hot_one_are_found(spark):
    rng = np.random.default_rng(3)
    middle = np.eye(16)[:12]
    sizes = [900, *[8] * 11]
    x = np.repeat(middle, sizes, axis=0) + rng.normal(scale=0.01, size=(sum(sizes), 16))
    x[:600] = x[0]  # two thirds of the rows are copies
    table = vectors(spark, x.tolist(), "f32").repartition(4)
    centres = seeding.parallel_centroids(table, 12)
    assert centres.shape == (12, 16) and nearest(x, centres).max() < 0.05
    assert sorted(np.argmax(centres @ middle.T, axis=1).tolist()) == list(range(12))


def test_few_different_rows_unsound_rows_and_repeated_ids(spark):
    table = vectors(spark, [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 3 + [None], "f32")
    centres = seeding.draw_centres(table, 5)
    assert len(set(centres.ids.tolist())) == len(centres.ids) and {tuple(v) for v in centres.vectors.tolist()} == {(1.0, 0.0), (0.0, 1.0)}
    assert nearest(np.array([[1.0, 0.0], [0.0, 1.0]]), seeding.parallel_centroids(table, 5)) == pytest.approx([0.0, 0.0])
    # One id on every row gives one centre, the least of its vectors.
    same = table.selectExpr("7L AS vec_id", "f32")
    assert seeding.draw_centres(same, 5).ids.tolist() == [7] and seeding.draw_centres(same, 5).vectors.tolist() == [[0.0, 1.0]]
    for empty in (table.filter("vec_id < 0"), table.selectExpr("CAST(NULL AS BIGINT) AS vec_id", "f32")):
        assert len(seeding.parallel_centroids(empty, 5)) == 0


def test_copies_of_a_centre_are_not_drawn_again(spark):
    table = vectors(spark, [[0.3, 0.4]] * 50, "f32")
    assert len(seeding.draw_centres(table, 5).ids) == 1


def test_reduction_weighs_centres():
    x = np.array([[1.0, 0.0], [0.99, 0.14], [0.0, 1.0], [-1.0, 0.0]])
    weight = np.array([100.0, 1.0, 50.0, 0.0])
    out = seeding.reduce_centres(x, weight, 2)
    assert nearest(x[[0, 2]], out).max() < 1e-3
    assert seeding.reduce_centres(x, weight, 9).shape == (4, 2)


def test_size_is_checked(unit, conf):
    conf("nearfield.maxBroadcastBytes", 4096)
    with pytest.raises(ValueError, match="fewer lists|use fewer"):
        seeding.draw_centres(unit, 100)
