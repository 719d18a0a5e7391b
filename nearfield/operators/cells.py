"""The k nearest targets of many sources inside one cell of rows.

A cell holds its sources and lets its targets pass in chunks, so it can be as long
as the table; thresholds of earlier chunks hold for later ones.  Tiles of the pair
matrix stay small enough for a core's cache and are compared with one threshold a
source, so a pair costs little more than its product.  What is left of a chunk is
measured exactly; rounding of the tiles is in the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from nearfield.functions import blocks
from nearfield.operators import metrics
from nearfield.operators.topk import RunningTopK

FIRST_ROWS = 2048  # targets that give the first thresholds
CROWDED = 4  # times k: more rows of a source within rounding of its k-th are measured at once
LEAST_COLS = 256  # targets that a strip of sources reckons with at least, which bounds its length
UNIT_STEP = 4096  # rows widened to double at once
FOUND = "src bigint, nbrs array<struct<dist:double,dst:bigint>>"


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit rows in single precision, divided in double; NaN where a row has no direction."""
    out = np.empty(x.shape, np.float32)
    for start in range(0, len(x), UNIT_STEP):
        part = x[start : start + UNIT_STEP].astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            out[start : start + UNIT_STEP] = part / np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
    return out


def _has_direction(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1) & (np.einsum("ij,ij->i", x, x, dtype=np.float64) > 0)


def _rounding(dim: int) -> float:
    """Products and sums of unit rows are off by (dim + 4) * 2**-24 at most; this is twice that and more."""
    return (dim + 8) * 2.0**-23


class ListDistances:
    """Distances inside many short lists of rows at once, off by ``slack`` at most; NaN without a direction."""

    def __init__(self, x: np.ndarray, metric: str):
        self.coded = metric == "hamming"
        self.rows = x.view(np.uint64) if self.coded else _unit_rows(x)
        self.slack = 0.0 if self.coded else _rounding(x.shape[1])

    def of(self, at: np.ndarray) -> np.ndarray:
        """(lists, places, places) of the rows ``at`` (lists, places)."""
        rows = self.rows[at]
        if not self.coded:
            return np.float32(1) - rows @ rows.swapaxes(1, 2)
        total = np.zeros((*at.shape, at.shape[1]), np.uint32)
        for w in range(rows.shape[2]):
            total += np.bitwise_count(rows[:, :, None, w] ^ rows[:, None, :, w])
        return total


class _FloatTiles:
    """Cosine distances of unit rows in single precision, off by ``slack`` at most.

    A further column holds a source's threshold against ones, so that hits are the products that are not negative.
    """

    shape = (256, 2048)
    farthest = 2.001  # no distance is beyond; bounds the sums that round

    def __init__(self, targets: np.ndarray, sources: np.ndarray):
        self.targets, self.sources = (np.pad(_unit_rows(x), ((0, 0), (0, 1)), constant_values=1) for x in (targets, sources))
        cells = self.shape[0] * self.shape[1]
        self._own, self._hits = np.empty(cells, np.float32), np.empty(cells, bool)
        self.slack = _rounding(targets.shape[1] + 1)

    def _products(self, strip: slice, part: slice, least: np.ndarray | float) -> np.ndarray:
        self.sources[strip, -1] = -least
        mine, theirs = self.sources[strip], self.targets[part]
        out = self._own[: len(mine) * len(theirs)].reshape(len(mine), len(theirs))
        return np.matmul(mine, theirs.T, out=out)

    def tile(self, strip: slice, part: slice) -> np.ndarray:
        out = self._products(strip, part, 0)
        return np.subtract(np.float32(1), out, out=out)

    def near(self, strip: slice, part: slice, bound: np.ndarray, nearer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, target, rough distance) of the pairs within ``bound``, by source."""
        least = np.nextafter((1 - np.minimum(bound, self.farthest)).astype(np.float32), np.float32(-np.inf))
        out = self._products(strip, part, least).ravel()
        places = _set_places(np.greater_equal(out, np.float32(0), out=self._hits[: len(out)]))
        rows, cols = np.divmod(places, len(out) // len(bound))
        return rows, cols + part.start, 1 - (out[places].astype(np.float64) + least[rows])


class _CodeTiles:
    """Differing bits; exact."""

    shape = (128, 4096)
    step = 8  # sources whose words are compared at once, more of them with few targets
    slack = 0.0

    def __init__(self, targets: np.ndarray, sources: np.ndarray):
        targets, sources = self._varying(targets, sources)
        self.targets = np.ascontiguousarray(targets.view(np.uint64).T)
        self.sources = np.ascontiguousarray(sources.view(np.uint64).T)
        count = np.uint16 if 64 * targets.shape[1] < 2**16 else np.uint32
        cells, whole = self.step * self.shape[1], self.shape[0] * self.shape[1]
        self._own, self._hits = (np.empty(whole, count), np.empty(cells, np.uint64), np.empty(cells, np.uint8)), np.empty(whole, bool)

    @staticmethod
    def _varying(*sides: np.ndarray) -> list[np.ndarray]:
        """Codes without the bits that all rows share, as the unused ones of thermometers."""
        some, every = (one(np.stack([one(x, axis=0) for x in sides]), axis=0) for one in (np.bitwise_or.reduce, np.bitwise_and.reduce))
        nbits = 64 * len(some)
        varying = blocks.unpack_bits((some & ~every)[None, :], nbits)[0].astype(bool)
        return [blocks.pack_bits(blocks.unpack_bits(x, nbits)[:, varying]) for x in sides]

    def tile(self, strip: slice, part: slice) -> np.ndarray:
        mine, theirs = self.sources[:, strip], self.targets[:, part]
        rows, cols = mine.shape[1], theirs.shape[1]
        total = self._own[0][: rows * cols].reshape(rows, cols)
        total[:] = 0
        step = max(self.step, len(self._own[1]) // cols)
        for start in range(0, rows, step):
            some = total[start : start + step]
            differ, ones = (own[: some.size].reshape(some.shape) for own in self._own[1:])
            for a, b in zip(mine[:, start : start + step], theirs, strict=True):
                np.bitwise_xor(a[:, None], b, out=differ)
                np.add(some, np.bitwise_count(differ, out=ones), out=some)
        return total

    def near(self, strip: slice, part: slice, bound: np.ndarray, nearer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, target, distance) of the pairs within ``bound``, below it if only ``nearer`` ones are wanted."""
        tile = self.tile(strip, part)
        most = np.minimum(bound, np.iinfo(tile.dtype).max).astype(tile.dtype)[:, None]
        hits = self._hits[: tile.size].reshape(tile.shape)
        places = _set_places((np.less if nearer else np.less_equal)(tile, most, out=hits))
        rows, cols = np.divmod(places, tile.shape[1])
        return rows, cols + part.start, tile.ravel()[places].astype(np.float64)


def _parts(rows: int, first: int, most: int) -> Iterator[slice]:
    """Few targets first, as the thresholds they leave are still loose."""
    # Two like parts rather than one and a small rest.
    start, step = 0, -(-rows // 2) if first < rows < 2 * first else first
    while start < rows:
        yield slice(start, min(start + step, rows))
        start, step = start + step, min(2 * step, most)


def _set_places(mask: np.ndarray) -> np.ndarray:
    """Places of the few set entries, found eight at a time."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    near = (8 * words[:, None] + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


def _strip_nearest(tiles, strip: slice, ids: np.ndarray, exact, state: RunningTopK, higher: bool) -> None:
    """Offers the targets ``ids`` of a chunk, in order, to the sources of a strip.

    Candidates are held by their rough distance, down to the k-th and twice the
    slack.  Where crowds are closer together than that, they are measured at once.
    ``higher``: the state holds lower ids only.
    """
    count, k, slack = strip.stop - strip.start, state.k, tiles.slack
    bound, measured = state.bound + slack, slack == 0
    warm = bool(np.isfinite(bound).all())
    held, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    widest = tiles.shape[0] * tiles.shape[1] // max(count, tiles.shape[0])
    for part in _parts(len(ids), widest if warm else min(FIRST_ROWS, widest), widest):
        if not warm and part.start == 0:
            first = tiles.tile(strip, part)
            if first.shape[1] >= k:
                bound = np.minimum(bound, np.partition(first, k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * slack)
            rows, cols = np.divmod(np.flatnonzero(first <= bound[:, None]), first.shape[1])
            rough = first[rows, cols].astype(np.float64)
        else:
            # Targets with higher ids lose a tie against the k rows that are there.
            rows, cols, rough = tiles.near(strip, part, bound, part.start > 0 or higher)
        if measured:
            state.offer(rows, rough if not slack else exact(rows, cols), ids[cols])
            bound = np.minimum(bound, state.bound + slack)
            continue
        held.append((rows, cols, rough))
        waiting += len(rows)
        if waiting > 3 * k * count:
            held = [_within(held, bound, k, 2 * slack)]
            waiting = len(held[0][0])
            if waiting > CROWDED * k * count:
                rows, cols, _ = held[0]
                state.offer(rows, exact(rows, cols), ids[cols])
                held, measured = [tuple(column[:0] for column in held[0])], True
                state.settle()
                bound = np.minimum(bound, state.bound + slack)
    if not measured:
        rows, cols, _ = _within(held, bound, k, 2 * slack)
        state.offer(rows, exact(rows, cols), ids[cols])
    state.settle()


def _within(held: list[tuple[np.ndarray, ...]], bound: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, ...]:
    """Candidates no farther than the k-th of their source and the margin; lowers ``bound`` to that."""
    held = [np.concatenate(column) for column in zip(*held, strict=True)]
    rows, _, rough = held
    # Distances are below 4; what a sum of both rounds off is far below the slack.
    order = np.argsort(rows + rough / 4)
    rows, rough = rows[order], rough[order]
    last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows, "left") == k - 1)
    bound[rows[last]] = np.minimum(bound[rows[last]], rough[last] + margin)
    kept = order[rough <= bound[rows]]
    return tuple(column[kept] for column in held)


class Cell:
    """Sources, and the k nearest of the targets met so far, ties to the lower id.

    Rows without a direction have no cosine distance and take no part.
    """

    def __init__(self, sources: np.ndarray, k: int, metric: str):
        self.coded, self.measure = metric == "hamming", metrics.metric_of(metric)
        self.rows = np.arange(len(sources)) if self.coded else np.flatnonzero(_has_direction(sources))
        self.sources, self.k = sources[self.rows], k
        self.strips: list[tuple[slice, RunningTopK]] = []
        self.last = None

    def _cut(self, targets: int) -> list[tuple[slice, RunningTopK]]:
        """Strips of sources that make whole tiles with the first targets; fewer targets, longer strips."""
        rows, cols = (_CodeTiles if self.coded else _FloatTiles).shape
        step, count = rows * max(1, cols // max(targets, LEAST_COLS)), len(self.sources)
        cuts = [slice(at, min(at + step, count)) for at in range(0, count, step)]
        return [(at, RunningTopK(at.stop - at.start, self.k)) for at in cuts]

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return x if self.coded else x.astype(np.float64)

    def meet(self, targets: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        if not self.coded:
            order = order[_has_direction(targets)[order]]
        if not len(order) or not len(self.sources):
            return
        targets, ids = targets[order], ids[order]
        higher, self.last = self.last is None or ids[0] > self.last, max(ids[-1], ids[-1] if self.last is None else self.last)
        tiles = (_CodeTiles if self.coded else _FloatTiles)(targets, self.sources)
        self.strips = self.strips or self._cut(len(ids))
        for strip, state in self.strips:
            own = self._wide(self.sources[strip])

            def exact(rows: np.ndarray, cols: np.ndarray, own=own) -> np.ndarray:
                used, at = np.unique(cols, return_inverse=True)
                return self.measure.exact(self._wide(targets[used]), own, at, rows)

            _strip_nearest(tiles, strip, ids, exact, state, higher)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source row, target id, distance), by source and nearest first."""
        parts = [(self.rows[at.start + s.query], s.ids, s.dist) for at, s in self.strips]
        parts = parts or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def nearest_in_cell(
    sources: np.ndarray, targets: np.ndarray, target_ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source row, target id, distance) of the k nearest targets of every source, ties to the lower id."""
    cell = Cell(sources, k, metric)
    cell.meet(targets, target_ids)
    return cell.found()


def _runs(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(cell, is_target, ids, vectors) of neighbouring rows of one side of one cell."""
    for batch in batches:
        cell, side, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x, _ = blocks.read_vectors(batch.column(3), dtype)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1
        for rows in np.split(np.arange(len(cell)), cuts) if len(cell) else []:
            at = slice(rows[0], rows[-1] + 1)
            yield int(cell[at.start]), bool(side[at.start]), ids[at], x[at]


def _listed(src: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    at, dst, dist = found
    held, starts = np.unique(at, return_index=True)
    links = pa.StructArray.from_arrays([pa.array(dist), pa.array(dst)], names=["dist", "dst"])
    nbrs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), links)
    return pa.RecordBatch.from_arrays([pa.array(src[held]), nbrs], names=["src", "nbrs"])


def nearest_of_cells(
    batches: Iterator[pa.RecordBatch], k: int, metric: str, chunk_rows: int
) -> Iterator[pa.RecordBatch]:
    """``FOUND`` rows of cells that come one after the other as (cell, is_target, vec_id, vec).

    The sources of a cell come before its targets, and targets by id.  Held at once are the
    sources and a chunk of targets.
    """
    dtype = np.int64 if metric == "hamming" else np.float32
    now, cell, src = None, None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def pass_on() -> None:
        nonlocal cell, src
        if held:
            ids, x = (np.concatenate(column) for column in zip(*held, strict=True))
            held.clear()
            if now[1]:
                if cell is not None:
                    cell.meet(x, ids)
            else:
                cell, src = Cell(x, k, metric), ids

    for number, is_target, ids, x in _runs(batches, dtype):
        if now != (number, is_target):
            pass_on()
            if now is not None and now[0] != number and cell is not None:
                yield _listed(src, cell.found())
                cell = None
            now = (number, is_target)
        held.append((ids, x))
        if is_target and sum(len(part) for part, _ in held) >= chunk_rows:
            pass_on()
    pass_on()
    if cell is not None:
        yield _listed(src, cell.found())
