"""Exact order statistics without gathering a column.

Means and extremes come from one aggregate of per-task sums.  For percentiles the
engine keeps, per dimension, the few value ranges that hold a wanted rank, counts
rows in ever finer bins of those ranges, and reads single values only once few are
left.  A range shrinks to the values it really spans, so a value that a third of
the rows share is found as fast as any other.  Half of the bins are equally wide
in value, half in the order of all doubles; the latter end every search after a
bounded number of passes, however the values are spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks

BINS = 64
VALUES_LEFT = 1_000_000
_LOW_BITS = (1 << 63) - 1


def dim_moments(vectors: DataFrame, vec: str = "v") -> DataFrame:
    """Per dimension: d, n, mean, low, high.  Each task hands on one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0))
            if len(x) == 0:
                continue
            if n == 0:
                total, low, high = np.zeros(x.shape[1]), np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf)
            n += len(x)
            total += x.sum(axis=0)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [np.arange(len(total), dtype=np.int32), np.full(len(total), n), total, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "total", "low", "high"])

    return (
        vectors.select(vec)
        .mapInArrow(run, "d int, n bigint, total double, low double, high double")
        .groupBy("d")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("total") / F.sum("n")).alias("mean"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )


def dim_means(vectors: DataFrame, vec: str = "v") -> DataFrame:
    return dim_moments(vectors, vec).select("d", "mean")


def _ranks(n: int, probs: list[float]) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, weight of the upper) of every probability."""
    spots = []
    for p in probs:
        at = p * (n - 1)
        low = math.floor(at)
        spots.append((low, min(low + 1, n - 1), at - low))
    return spots


def _place(x: float) -> int:
    """Where a double stands in the order of all doubles."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else bits ^ _LOW_BITS


def _at_place(place: int) -> float:
    return float(np.int64(place if place >= 0 else place ^ _LOW_BITS).view(np.float64))


class _Range:
    """Values in [low, high] of one dimension; ``below`` values lie under it."""

    __slots__ = ("low", "high", "below", "count")

    def __init__(self, low: float, high: float, below: int, count: int):
        self.low, self.high, self.below, self.count = low, high, below, count

    def edges(self) -> np.ndarray:
        """Lower edges of its bins, and the first value beyond it."""
        half = BINS // 2
        wide = np.linspace(self.low, self.high, half + 1)[:-1]
        first, last = _place(self.low), _place(self.high)
        dense = [_at_place(first + (last - first) * i // half) for i in range(half)]
        return np.concatenate([wide, dense, [np.nextafter(self.high, np.inf)]])


def _bins(vectors: DataFrame, vec: str, edges: list[np.ndarray]) -> pa.Table:
    """(d, bin, n, low, high): rows of each bin and the values it really spans.

    Bin ``b`` of a dimension starts at its edge ``b - 1``; bin 0 lies below all.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shipped.value
        counts = [np.zeros(len(e) + 1, np.int64) for e in local]
        lows = [np.full(len(e) + 1, np.inf) for e in local]
        highs = [np.full(len(e) + 1, -np.inf) for e in local]
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0))
            x = np.sort(x, axis=0)
            for d in range(x.shape[1]):
                ends = np.append(np.searchsorted(x[:, d], local[d], "left"), len(x))
                starts = np.append(0, ends[:-1])
                held = np.flatnonzero(ends > starts)
                counts[d][held] += (ends - starts)[held]
                lows[d][held] = np.minimum(lows[d][held], x[starts[held], d])
                highs[d][held] = np.maximum(highs[d][held], x[ends[held] - 1, d])
        for d, count in enumerate(counts):
            held = np.flatnonzero(count)
            if len(held):
                columns = [np.full(len(held), d, np.int32), held.astype(np.int32), count[held], lows[d][held], highs[d][held]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "bin", "n", "low", "high"])

    return (
        vectors.select(vec)
        .mapInArrow(run, "d int, bin int, n bigint, low double, high double")
        .groupBy("d", "bin")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .toArrow()
        .sort_by([("d", "ascending"), ("bin", "ascending")])
    )


def _refine(bins: pa.Table, inner: int, wanted: set[int]) -> list[_Range]:
    """Ranges of the next pass: the bins of one dimension that hold a wanted rank."""
    below, kept = 0, []
    for b, n, low, high in zip(*(bins.column(c).to_pylist() for c in ("bin", "n", "low", "high")), strict=True):
        if 0 < b < inner and any(below <= rank < below + n for rank in wanted):
            kept.append(_Range(low, high, below, n))
        below += n
    return kept


def _values_left(vectors: DataFrame, vec: str, ranges: list[list[_Range]]) -> DataFrame:
    """(d, x, n): distinct values inside the ranges with their counts."""
    shipped = vectors.sparkSession.sparkContext.broadcast(
        [[(r.low, r.high) for r in of_dim] for of_dim in ranges]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0))
            dims, values, counts = [], [], []
            for d in range(x.shape[1]):
                column = x[:, d]
                inside = np.zeros(len(column), bool)
                for low, high in shipped.value[d]:
                    inside |= (column >= low) & (column <= high)
                distinct, count = np.unique(column[inside], return_counts=True)
                dims.append(np.full(len(distinct), d, np.int32))
                values.append(distinct)
                counts.append(count)
            if dims:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(dims)),
                        pa.array(np.concatenate(values)),
                        pa.array(np.concatenate(counts).astype(np.int64)),
                    ],
                    names=["d", "x", "n"],
                )

    return (
        vectors.select(vec)
        .mapInArrow(run, "d int, x double, n bigint")
        .groupBy("d", "x")
        .agg(F.sum("n").alias("n"))
    )


def exact_percentiles(
    vectors: DataFrame, probs: list[float], vec: str = "v", values_left: int = VALUES_LEFT
) -> tuple[np.ndarray, np.ndarray]:
    """(means (D,), percentiles (D, len(probs))), linear between neighbours."""
    vectors = vectors.select(vec).filter(F.col(vec).isNotNull())
    moments = dim_moments(vectors, vec).toArrow().sort_by("d")
    if moments.num_rows == 0:
        raise ValueError("no vectors to learn thresholds from")
    n = moments.column("n")[0].as_py()
    lows, highs = moments.column("low").to_numpy(), moments.column("high").to_numpy()
    dims = len(lows)
    spots = _ranks(n, probs)
    wanted = {rank for low, high, _ in spots for rank in (low, high)}
    ranges = [[_Range(float(lows[d]), float(highs[d]), 0, n)] for d in range(dims)]

    ranges = narrowed(vectors, vec, ranges, wanted, values_left)
    table = _values_left(vectors, vec, ranges).toArrow()
    return moments.column("mean").to_numpy(), cuts_within(table, ranges, spots)


def narrowed(
    vectors: DataFrame,
    vec: str,
    ranges: list[list[_Range]],
    wanted: set[int],
    values_left: int,
    edges: list[np.ndarray] | None = None,
) -> list[list[_Range]]:
    """Ranges that hold the wanted ranks and few values; the first pass counts between ``edges`` where given."""
    while edges is not None or sum(r.count for of_dim in ranges for r in of_dim if r.low < r.high) > values_left:
        if edges is None:
            edges = [np.unique(np.concatenate([r.edges() for r in of_dim])) for of_dim in ranges]
        bins = _bins(vectors, vec, edges)
        firsts = np.searchsorted(bins.column("d").to_numpy(), np.arange(len(edges) + 1))
        ranges = [
            _refine(bins.slice(firsts[d], firsts[d + 1] - firsts[d]), len(edges[d]), wanted) for d in range(len(edges))
        ]
        edges = None
    return ranges


def cuts_within(table: pa.Table, ranges: list[list[_Range]], spots: list[tuple[int, int, float]]) -> np.ndarray:
    """Percentiles from the distinct values (d, x, n) inside the ranges."""
    table = table.sort_by([("d", "ascending"), ("x", "ascending")])
    d_col, x_col, n_col = (table.column(c).to_numpy() for c in ("d", "x", "n"))
    cuts = np.empty((len(ranges), len(spots)))
    for d in range(len(ranges)):
        first, last = np.searchsorted(d_col, [d, d + 1])
        values, counts = x_col[first:last], n_col[first:last]

        def value_at(rank: int, d=d, values=values, counts=counts) -> float:
            for r in ranges[d]:
                if r.below <= rank < r.below + r.count:
                    a, b = np.searchsorted(values, r.low), np.searchsorted(values, r.high, "right")
                    upto = r.below + np.cumsum(counts[a:b])
                    return values[a + np.searchsorted(upto, rank, "right")]
            raise AssertionError("a wanted rank lies in no range")

        for i, (low, high, weight) in enumerate(spots):
            a, b = value_at(low), value_at(high)
            cuts[d, i] = a + (b - a) * weight
    return cuts


def approx_percentiles(vectors: DataFrame, probs: list[float], vec: str = "v", accuracy: int = 10000) -> DataFrame:
    """(d, cuts): percentiles of bounded rank error from mergeable sketches."""
    return (
        vectors.select(F.posexplode(vec).alias("d", "x"))
        .groupBy("d")
        .agg(F.percentile_approx("x", probs, accuracy).alias("cuts"))
    )
