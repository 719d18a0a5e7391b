"""Nearest targets inside a cell, and how many cells a build deals its rows to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from nearfield import settings
from nearfield.operators import graph, metrics
from nearfield.operators.cells import Cell, _CodeTiles, nearest_in_cell, nearest_of_cells


def plain(sources, targets, ids, k, metric):
    """From every pair, measured exactly."""
    rows, cols = (a.ravel() for a in np.indices((len(sources), len(targets))))
    with np.errstate(invalid="ignore"):
        dist = metrics.metric_of(metric).exact(targets, sources, cols, rows)
    out = []
    for i in range(len(sources)):
        of = dist[rows == i]
        order = [j for j in np.lexsort((ids, of)) if not np.isnan(of[j])][:k]
        out += [(i, int(ids[j]), of[j]) for j in order]
    return out


@pytest.mark.parametrize("metric", ["cosine", "hamming"])
@pytest.mark.parametrize("rows", [5, 700])
def test_cell_is_exact(metric, rows):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(rows, 6)), rng.normal(size=(300, 6))
    x[::3] = x[0]  # copies, and rows nearer to each other than single precision tells
    x[1::3] = x[0] * rng.uniform(0.5, 2, size=(len(x[1::3]), 1)) + rng.normal(scale=1e-8, size=(len(x[1::3]), 6))
    q[:100] = x[0] + rng.normal(scale=1e-7, size=(100, 6))
    x[2], q[7] = 0, 0
    if metric == "hamming":
        x, q = ((a * 4).astype(np.int64) for a in (x, q))
    ids = rng.permutation(5 * rows)[:rows]
    got = list(zip(*(c.tolist() for c in nearest_in_cell(q, x, ids, 9, metric)), strict=True))
    assert got == plain(q, x, ids, 9, metric)


def test_cells_grow_with_the_table():
    """A row is repeated once per cell of the other side: 151 times for 615,384 rows in cells of 4,096."""
    edge = lambda n, width=64: graph._cell_edge(pa.table({"s": [n], "t": [n], "width": [width]}))
    assert -(-615_384 // edge(615_384)) <= 20
    assert edge(10_256) == settings.CELL_ROWS
    assert edge(615_384, 4096) * 4096 * 8 <= settings.CELL_BYTES
    assert graph._cell_edge(pa.table({"s": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "width": pa.array([], pa.int32())})) >= 1


def test_bits_that_no_row_varies_are_not_compared():
    """One bit of eight is never set in an 8-step thermometer: seven words are left of eight."""
    codes = np.random.default_rng(1).integers(0, 2**63, (500, 8), np.int64) & 0x7F7F7F7F7F7F7F7F
    tiles = _CodeTiles(codes, codes[:40])
    assert tiles.targets.shape == (7, 500)
    want = np.bitwise_count((codes[:40, None] ^ codes).view(np.uint64)).sum(axis=2)
    assert (tiles.tile(slice(0, 40), slice(0, 500)) == want).all()


@pytest.mark.parametrize("metric", ["cosine", "hamming"])
def test_targets_pass_in_chunks(metric):
    """Thresholds of earlier chunks hold for later ones, in whatever order ids come."""
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(900, 6)), rng.normal(size=(300, 6))
    x[::4], q[:50] = x[0], x[0]
    if metric == "hamming":
        x, q = ((a * 4).astype(np.int64) for a in (x, q))
    ids = rng.permutation(2000)[:900]
    cell = Cell(q, 9, metric)
    for at in np.array_split(np.arange(900), 7):
        cell.meet(x[at], ids[at])
    assert list(zip(*(c.tolist() for c in cell.found()), strict=True)) == plain(q, x, ids, 9, metric)


def test_cells_come_one_after_the_other():
    """Batches may end anywhere; a cell without sources or without targets gives nothing."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    sides = [(0, False, 20), (0, True, 40), (1, True, 10), (2, False, 5), (3, False, 7), (3, True, 60)]
    cell, side, ids = (np.concatenate(c) for c in zip(*[(np.full(n, c), np.full(n, s), np.arange(n)) for c, s, n in sides], strict=True))
    rows = pa.table({"cell": cell, "is_target": side, "vec_id": ids, "vec": x[ids].tolist()}).to_batches(max_chunksize=13)
    found = pa.Table.from_batches(nearest_of_cells(iter(rows), 3, "cosine", 16)).to_pylist()
    want = [(i, plain(x[:n].astype(float), x[:t].astype(float), np.arange(t), 3, "cosine")) for n, t in ((20, 40), (7, 60)) for i in range(n)]
    assert [(f["src"], [(n["dst"], n["dist"]) for n in f["nbrs"]]) for f in found] == [
        (i, [(dst, dist) for row, dst, dist in of if row == i]) for i, of in want
    ]


def test_a_source_hands_on_few_rows():
    """One row for every run of targets, where it were k for each of 19 cells of 615,384 rows."""
    lists = pa.table({"list_id": [0], "s": [615_384], "t": [615_384], "width": [64]})
    [(_, s, t, _)] = graph._cell_sizes(lists, graph._cell_edge(lists))
    assert s <= 20 and t <= 6 and s * t >= settings.CELLS_LEAST
    many = pa.table({"list_id": [0, 1], "s": [100, 10_000], "t": [50, 40_000], "width": [64, 64]})
    assert [first for *_, first in graph._cell_sizes(many, 4096)] == [0, 1]


@pytest.mark.parametrize("rows", [700, 2050, 3000])
def test_a_short_list_is_compared_once(monkeypatch, rows):
    """The part that gives the first thresholds is not compared again, and a long list is not left with a tiny part."""
    rng, seen = np.random.default_rng(7), []
    whole = _CodeTiles.tile
    monkeypatch.setattr(_CodeTiles, "tile", lambda self, strip, part: seen.append((strip, part)) or whole(self, strip, part))
    codes = rng.integers(0, 2**63, (rows, 2), np.int64)
    nearest_in_cell(codes[:100], codes, np.arange(rows), 3, "hamming")
    assert sum(min(part.stop, rows) - part.start for _, part in seen) == rows
    assert min(part.stop - part.start for _, part in seen) >= 512


def test_small_cells_share_tasks(spark):
    """10,256 rows that look into 8 of 50 lists: 50 tasks of 0.3 million pairs took longer to start than to compare."""
    lists = pa.table({"list_id": list(range(50)), "s": [1641] * 50, "t": [205] * 50, "width": [64] * 50})
    sizes = graph._cell_sizes(lists, graph._cell_edge(lists))
    assert graph._cell_tasks(spark, lists, sizes) == graph.CELL_WAVES * spark.sparkContext.defaultParallelism
    large = pa.table({"list_id": list(range(50)), "s": [98_460] * 50, "t": [12_300] * 50, "width": [64] * 50})
    sizes = graph._cell_sizes(large, graph._cell_edge(large))
    assert graph._cell_tasks(spark, large, sizes) == sum(s * t for _, s, t, _ in sizes)


@pytest.mark.parametrize("metric", ["cosine", "hamming"])
def test_few_targets_make_long_strips(metric):
    """A list of 200 rows took 40 strips of 128 for 5,000 sources; later chunks, however long, fit the tiles all the same."""
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(5200, 6)), rng.normal(size=(600, 6))
    if metric == "hamming":
        x, q = ((a * 4).astype(np.int64) for a in (x, q))
    cell = Cell(q, 9, metric)
    cell.meet(x[:200], np.arange(200))
    assert len(cell.strips) == 1
    cell.meet(x[200:], np.arange(200, 5200))
    assert list(zip(*(c.tolist() for c in cell.found()), strict=True)) == plain(q, x, np.arange(5200), 9, metric)
