"""Whitening of embeddings with an exact covariance by polarisation.

Entries become whole numbers ``x = floor(64 c) + 1000000``.  With ``S`` the sum of
a dimension over the n vectors, ``S = n m + r`` and ``u = x - m``, the centred value
is ``z = n x - S = n u - r``, and ``u`` is small.  Every task sums ``u_i ** 2`` for each
dimension and ``(u_i + u_j) ** 2`` for each pair of dimensions in integers; since the
``u`` of a dimension add up to its ``r``, the sums of squared centred values are

    sum (z_i + z_j) ** 2 = n ** 2 sum (u_i + u_j) ** 2 - n (r_i + r_j) ** 2

exactly.  Polarisation, ``2 z_i z_j = (z_i + z_j) ** 2 - z_i ** 2 - z_j ** 2``, turns
differences of these into all cross-covariances, which are rounded once, when they
are divided into doubles for ``eigh``.  What reaches the driver has a row for each
pair of dimensions, whatever the number of vectors.

Vectors that are NULL, empty, or hold a NULL or non-finite entry drop out; zero
vectors stay, repeated rows count each time, a NULL ``vec_id`` stays NULL.  Vectors
of different width, and entries of 2 ** 24 or more, raise.  A direction without
variance has a NULL ``whitened`` and takes no part in the error; ``explained`` is NULL
if nothing varies at all.  A deviation beyond a long is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import broadcast_limit

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LARGEST = 1 << 24  # entries below it keep every square of a pair sum within a long
OUT_ROWS = 1 << 16  # rows of one result batch
LOW = (1 << 32) - 1
RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def sound_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, integer rows) of the vectors that take part."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    bad = np.asarray(flat.is_null()) | ~np.isfinite(np.asarray(flat.fill_null(0.0)))
    ends = np.cumsum(sizes)
    faults = np.concatenate([[0], np.cumsum(bad)])
    good = np.flatnonzero((sizes > 0) & (faults[ends] == faults[ends - sizes]))
    if len(good) == 0:
        return good, np.zeros((0, 0), np.int64)
    if len(np.unique(sizes[good])) > 1:
        raise ValueError("vectors of one column must share one width")
    picked = column if len(good) == len(column) else column.take(pa.array(good))
    entries = np.asarray(picked.flatten())
    if np.abs(entries).max() >= LARGEST:
        raise ValueError(f"entries of {LARGEST} or more cannot be summed exactly")
    return good, np.floor(entries * SCALE).astype(np.int64).reshape(len(good), -1)


class Sums(NamedTuple):
    """Rows, and per dimension the exact sum of x without ``SHIFT``."""

    n: int
    total: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """(m, r) of every dimension: the sum is ``n m + r`` with ``0 <= r < n``."""
        parts = [divmod(t, self.n) for t in self.total]
        return np.array([m for m, _ in parts], np.int64), np.array([r for _, r in parts], np.int64)


def dimension_sums(rows: DataFrame) -> Sums:
    """Rows and sums of ``rows`` (one list column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            _, x = sound_rows(batch.column(0))
            if len(x) == 0:
                continue
            if total is not None and len(total) != x.shape[1]:
                raise ValueError("vectors of one column must share one width")
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if total is not None:
            d = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"d": d, "n": np.full(len(d), n), "total": total})

    partial = rows.mapInArrow(run, "d int, n bigint, total bigint")
    added = partial.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    table = added.orderBy("d").collect()
    if not table:
        return Sums(0, [])
    if len({row.n for row in table}) > 1:
        raise ValueError("vectors of one column must share one width")
    return Sums(table[0].n, [int(row.total) for row in table])


def square_sums(u: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of ``(u_i + u_j) ** 2`` for all i <= j, row by row of the triangle; i = j has ``u_i ** 2``."""
    width, out = u.shape[1], []
    for i in range(width):
        pairs = u[:, i + 1 :] + u[:, i : i + 1]
        out.append(np.einsum("ij,ij->j", u[:, i : i + 1], u[:, i : i + 1]))
        out.append(np.einsum("ij,ij->j", pairs, pairs))
    return np.concatenate(out)


def row_step(u: np.ndarray) -> int:
    """Rows whose squared pair sums surely add up below 2 ** 62."""
    largest = 2 * int(np.abs(u).max()) + 1
    return max(1, min(1 << 14, (1 << 62) // (largest * largest)))


def pair_sums(rows: DataFrame, sums: Sums) -> list[int]:
    """``square_sums`` of all rows, centred by the whole part of the mean."""
    m, _ = sums.centre()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A total is kept in two halves of 32 bits, so any number of tasks adds up exactly.
        high, low = None, None
        for batch in batches:
            _, x = sound_rows(batch.column(0))
            if len(x) == 0:
                continue
            u = x - m
            step = row_step(u)
            for first in range(0, len(u), step):
                part = square_sums(u[first : first + step])
                if high is None:
                    high, low = np.zeros_like(part), np.zeros_like(part)
                high += part >> 32
                low += part & LOW
        if high is not None:
            pair = np.arange(len(high), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"pair": pair, "high": high + (low >> 32), "low": low & LOW})

    partial = rows.mapInArrow(run, "pair int, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    table = partial.groupBy("pair").agg(*wide).orderBy("pair").collect()
    return [(int(row.high) << 32) + int(row.low) for row in table]


def covariance(squares: list[int], sums: Sums) -> np.ndarray:
    """Covariance of x from the exact sums; each entry is rounded once."""
    n, width = sums.n, len(sums.total)
    _, remainders = sums.centre()
    r = [int(v) for v in remainders]
    centred = iter(squares)
    exact: dict[tuple[int, int], int] = {}
    for i in range(width):
        for j in range(i, width):
            offset = r[i] if i == j else r[i] + r[j]
            exact[i, j] = n * n * next(centred) - n * offset * offset
    out = np.empty((width, width))
    for (i, j), both in exact.items():
        product = both if i == j else (both - exact[i, i] - exact[j, j]) // 2
        out[i, j] = out[j, i] = product / n**3
    return out


class Whitener(NamedTuple):
    """``axes`` (dimensions x components) already over the root of the eigenvalue; NaN without variance."""

    sums: Sums
    covariance: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        m, r = self.sums.centre()
        return ((x - m) - r / self.sums.n) @ self.axes


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitening transform of ``rows`` (one list column); None without a vector."""
    sums = dimension_sums(rows)
    if sums.n == 0:
        return None
    width = len(sums.total)
    if width * width * 16 > broadcast_limit(rows.sparkSession):
        raise ValueError(f"a covariance of {width} dimensions exceeds the broadcast limit")
    v = covariance(pair_sums(rows, sums), sums)
    values, vectors = np.linalg.eigh(v)
    kept = min(components, width)
    values, vectors = values[::-1][:kept], vectors[:, ::-1][:, :kept]
    trace = float(np.trace(v))
    noise = width * np.finfo(float).eps * max(float(values[0]), 0.0)
    varied = values > noise
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(varied, vectors / np.sqrt(np.where(varied, values, 1.0)), np.nan)
        explained = np.where(varied, values, 0.0) / trace if trace > 0 else np.full(kept, np.nan)
    return Whitener(sums, v, axes, explained)


def identity_error(rows: DataFrame, whitener: Whitener) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity, as measured on them."""
    shipped = rows.sparkSession.sparkContext.broadcast(whitener)
    varied = np.flatnonzero(~np.isnan(whitener.axes).any(axis=0))
    if len(varied) == 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(varied) * (len(varied) + 1))
        for batch in batches:
            _, x = sound_rows(batch.column(0))
            if len(x):
                # The projection is centred already; what is left of a mean is taken off below.
                y = shipped.value.project(x)[:, varied]
                total += np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "total": total})

    table = rows.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    means = np.asarray(table.sort_by("at").column("total")) / whitener.sums.n
    square, mean = means[: len(varied) ** 2].reshape(len(varied), -1), means[len(varied) ** 2 :]
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(varied))).max())


def deviations(x: np.ndarray, sums: Sums) -> pa.Array:
    """Exact sum over the dimensions of ``(n x - S) ** 2`` for each row."""
    m, r = sums.centre()
    u, n = x - m, sums.n
    # Of |n u - r|, as r < n.
    largest = n * (int(np.abs(u).max()) + 1) if len(u) else 0
    if largest * largest * max(1, x.shape[1]) < 1 << 63:
        z = n * u - r
        return pa.array(np.einsum("ij,ij->i", z, z))
    z = n * u.astype(object) - r.astype(object)
    return pa.array([None if d >= 1 << 63 else int(d) for d in (z * z).sum(axis=1)], pa.int64())


def whiten(vectors: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(vec)
    whitener = fit(rows, components)
    if whitener is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(rows, whitener)
    shipped = spark.sparkContext.broadcast(whitener)

    def repeated(column: pa.Array, kept: int) -> pa.Array:
        return column.take(pa.array(np.repeat(np.arange(len(column)), kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        kept = len(model.explained)
        step = max(1, OUT_ROWS // kept)
        for batch in batches:
            good, x = sound_rows(batch.column(1))
            ids = batch.column(0).take(pa.array(good))
            for first in range(0, len(good), step):
                part = x[first : first + step]
                tiled = lambda c: np.tile(c, len(part))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        repeated(ids.slice(first, len(part)), kept),
                        pa.array(tiled(np.arange(1, kept + 1, dtype=np.int32))),
                        pa.array(np.full(len(part) * kept, model.sums.n, np.int64)),
                        repeated(deviations(part, model.sums), kept),
                        pa.array(model.project(part).ravel(), from_pandas=True),  # NaN becomes NULL
                        pa.array(tiled(model.explained), from_pandas=True),
                        pa.array(np.full(len(part) * kept, error)),
                    ],
                    names=[field.split()[0] for field in RESULT.split(", ")],
                )

    wanted = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec)
    return wanted.mapInArrow(run, RESULT)
