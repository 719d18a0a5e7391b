"""Versions of a stored table: what is encoded, what is read, what is removed."""

from __future__ import annotations

import pathlib

import pytest
from conftest import vectors

from nearfield.operators import prep
from nearfield.sources.versions import VersionedTable


def table_rows(table):
    return sorted((r.vec_id, tuple(r.f32), tuple(r.code_thermo4)) for r in table.collect())


@pytest.fixture
def made(spark, tmp_path):
    rows = [[float(i % 7 + 1), float(i % 5), 1.0, -2.0] for i in range(60)]
    cuts = prep.fit_thresholds(vectors(spark, rows), 4)
    return rows, cuts, VersionedTable(spark, str(tmp_path / "versions"))


def full(corpus, cuts):
    return table_rows(prep.represent(corpus, 4, 4, ("f32", "code_thermo4"), cuts))


def log(versions):
    return {r.version: (r.num_vectors, r.encoded, r.removed) for r in versions.versions().collect()}


def test_only_new_and_changed_rows_are_encoded(spark, made):
    rows, cuts, versions = made
    first = vectors(spark, rows)
    assert versions.build(first, 4, 4, cuts) == 1
    changed = [*rows[:50], *[[9.0, 1.0, 1.0, 1.0]] * 5, *[[1.0, 2.0, 3.0, 4.0]] * 15]  # 5 changed, 5 gone to others, 10 new
    second = vectors(spark, changed).repartition(5)
    assert versions.build(second, 4, 4, cuts) == 2
    assert log(versions) == {1: (60, 60, 0), 2: (70, 20, 10)}
    assert versions.build(second, 4, 4, cuts) == 3 and log(versions)[3] == (70, 0, 0)
    assert versions.build(second.filter("vec_id < 3"), 4, 4, cuts) == 4 and log(versions)[4] == (3, 0, 67)
    assert table_rows(versions.table(1)) == full(first, cuts)
    assert table_rows(versions.table(2)) == table_rows(versions.table(3)) == full(second, cuts)
    assert table_rows(versions.table()) == full(second.filter("vec_id < 3"), cuts)
    shifted = cuts._replace(mean=cuts.mean + 0.1)
    assert versions.build(second, 4, 4, shifted) == 5 and log(versions)[5] == (70, 70, 0)


def test_dropped_versions_leave_the_disk(spark, made):
    rows, cuts, versions = made
    held = lambda: {p.name for p in pathlib.Path(versions.root, "segments").iterdir()}
    for part in (rows, rows[:30], rows[:30] + [[5.0, 5.0, 5.0, 5.0]], rows[:10]):
        versions.build(vectors(spark, part), 4, 4, cuts)
    want, stored = table_rows(versions.table(3)), held()
    assert len(stored) == 4
    assert versions.drop_versions(keep=2) == [1, 2]
    assert set(log(versions)) == {3, 4} and held() < stored and held() == set(versions.segments())
    assert table_rows(versions.table(3)) == want
    with pytest.raises(ValueError, match="no version"):
        versions.table(1)
    assert versions.drop_versions(keep=2) == [] and versions.drop_versions() == [3]
    assert table_rows(versions.table()) == full(vectors(spark, rows[:10]), cuts)
    assert versions.build(vectors(spark, rows[:11]), 4, 4, cuts) == 5 and log(versions)[5] == (11, 1, 0)
    with pytest.raises(ValueError):
        versions.drop_versions(keep=0)


def test_odd_rows(spark, made):
    rows, cuts, versions = made
    odd = spark.createDataFrame(
        [(1, rows[0]), (1, rows[0]), (1, rows[1]), (None, rows[0]), (2, None), (3, [0.0] * 4)], "vec_id bigint, embedding array<float>"
    )
    versions.build(odd, 4, 4, cuts)
    assert log(versions) == {1: (2, 2, 0)} and [r[0] for r in table_rows(versions.table())] == [1, 1]
    versions.build(odd.limit(0), 4, 4, cuts)
    assert versions.table().count() == 0 and log(versions)[2] == (0, 0, 2)
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, versions.root + "-none").table()
