"""RaBitQ: one bit per dimension with a distance bound, reranked exactly.

Method of Gao and Long, "RaBitQ" (SIGMOD 2024).  Vectors are rotated by random
signs and a Hadamard transform, so the rotation needs no stored matrix.

A query may itself be quantised, to ``PLANES`` bits per dimension.  Its inner product
with a code is then a few counts of common bits on packed words, and the rounding of
the query, which is known exactly, widens the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions import blocks
from nearfield.operators import metrics
from nearfield.operators.ivf import IvfIndex, Probes, by_list, probe_lists
from nearfield.operators.knn import HITS, QueryBlock, hits_batch, per_block
from nearfield.operators.topk import RunningTopK, merge_salts, top_k


PLANES = 4
# Offsets below this are rounding noise of a vector that is its own centroid.
NO_LENGTH = 1e-9


class RabitqIndex(NamedTuple):
    """An inverted-list index whose postings also hold rq_code, rq_norm, rq_dot."""

    ivf: IvfIndex
    residual: bool


def padded_dim(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


def rotation_signs(dim: int) -> np.ndarray:
    """A sign per dimension, drawn by hash: the same on every machine."""
    odd = [int(hashlib.md5(f"sign|{d}".encode()).hexdigest()[:8], 16) % 2 for d in range(dim)]
    return np.where(odd, 1.0, -1.0)


def rotate(matrix: np.ndarray) -> np.ndarray:
    """Random signs, then the normalised Walsh-Hadamard transform of each row."""
    dim = padded_dim(matrix.shape[1])
    rows = blocks.widen(matrix * rotation_signs(matrix.shape[1]), dim)
    half = 1
    while half < dim:
        pairs = rows.reshape(len(rows), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([a + b, a - b], axis=2).reshape(len(rows), dim)
        half *= 2
    return rows / np.sqrt(dim)


def _direction(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotated unit vectors, lengths); a vector on its centroid has no direction."""
    norms = np.sqrt(np.einsum("ij,ij->i", r, r))
    norms[norms < NO_LENGTH] = 0.0
    r = np.where(norms[:, None] == 0, 0.0, r)
    return rotate(r / np.where(norms == 0, 1.0, norms)[:, None]), norms


def rabitq_build(ivf: IvfIndex, residual: bool = True, vec: str = "f32") -> RabitqIndex:
    """Add the code, length and code alignment of every posting; one narrow pass.

    ``residual`` codes the offset from the list's centroid, else the vector.
    """
    postings = ivf.postings
    keep = [c for c in postings.columns if not c.startswith("rq_")]
    at_list, at_vec = keep.index("list_id"), keep.index(vec)
    shipped = postings.sparkSession.sparkContext.broadcast(blocks.unit_rows(ivf.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = blocks.unit_rows(blocks.read_vectors(batch.column(at_vec))[0])
            if residual:
                x = x - shipped.value[batch.column(at_list).to_numpy()]
            turned, norms = _direction(x)
            dots = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
            codes = blocks.pack_bits((turned > 0).astype(np.uint8))
            made = [
                blocks.write_vectors(codes, np.ones(len(x), bool), pa.int64()),
                pa.array(norms),
                pa.array(np.where(norms == 0, 1.0, dots)),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*keep, "rq_code", "rq_norm", "rq_dot"]
            )

    types = {f.name: f.dataType.simpleString() for f in postings.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    coded = postings.select(*keep).mapInArrow(
        run, f"{schema}, rq_code array<bigint>, rq_norm double, rq_dot double"
    )
    return RabitqIndex(ivf._replace(postings=coded), residual)


class _ListScore:
    """Estimated cosine distances between coded rows of a list and its queries."""

    def __init__(self, queries: np.ndarray, centroid: np.ndarray | None, epsilon: float):
        offset = queries - centroid if centroid is not None else queries
        self.turned, self.norms = _direction(offset)
        self.dim, self.epsilon = queries.shape[1], epsilon

    def parts(self, signs: np.ndarray, norms: np.ndarray, dots: np.ndarray):
        """(estimate, error) as matrices rows x queries."""
        width = self.turned.shape[1]
        aligned = (signs @ self.turned.T) / np.sqrt(width) / dots[:, None]
        spread = self.epsilon * np.sqrt((1.0 - dots**2).clip(0.0) / dots**2) / np.sqrt(self.dim - 1)
        reach = norms[:, None] * self.norms[None, :]
        estimate = (norms[:, None] ** 2 + self.norms[None, :] ** 2 - 2.0 * reach * aligned) / 2.0
        return estimate, reach * spread[:, None]

    def of_codes(self, codes: np.ndarray, norms: np.ndarray, dots: np.ndarray):
        return self.parts(_signs(codes, self.turned.shape[1]), norms, dots)


class _PlaneScore(_ListScore):
    """The same from queries of ``PLANES`` bits per dimension; codes stay packed."""

    def __init__(self, queries: np.ndarray, centroid: np.ndarray | None, epsilon: float):
        super().__init__(queries, centroid, epsilon)
        self.low = self.turned.min(axis=1)
        step = (self.turned.max(axis=1) - self.low) / ((1 << PLANES) - 1)
        self.step = np.where(step == 0, 1.0, step)
        level = np.floor((self.turned - self.low[:, None]) / self.step[:, None] + 0.5).astype(np.int64)
        self.planes = [blocks.pack_bits((level >> p & 1).astype(np.uint8)) for p in range(PLANES)]
        kept = self.low[:, None] + self.step[:, None] * level
        self.total = kept.sum(axis=1)
        # No signs can turn the rounding into more than this.
        self.rounding = np.abs(self.turned - kept).sum(axis=1)

    def common(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the levels at the set bits of each code, rows x queries."""
        out = np.zeros((len(codes), len(self.low)), np.int64)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                both = codes[:, w][:, None] & plane[:, w][None, :]
                out += np.bitwise_count(both.view(np.uint64)).astype(np.int64) << p
        return out

    def of_codes(self, codes: np.ndarray, norms: np.ndarray, dots: np.ndarray):
        width = self.turned.shape[1]
        ones = np.bitwise_count(codes.view(np.uint64)).astype(np.int64).sum(axis=1)
        at_ones = self.low[None, :] * ones[:, None] + self.step[None, :] * self.common(codes)
        scale = np.sqrt(width) * dots[:, None]
        aligned = (2.0 * at_ones - self.total[None, :]) / scale
        spread = self.epsilon * np.sqrt((1.0 - dots**2).clip(0.0) / dots**2) / np.sqrt(self.dim - 1)
        reach = norms[:, None] * self.norms[None, :]
        estimate = (norms[:, None] ** 2 + self.norms[None, :] ** 2 - 2.0 * reach * aligned) / 2.0
        return estimate, reach * (spread[:, None] + self.rounding[None, :] / scale)


def _signs(codes: np.ndarray, width: int) -> np.ndarray:
    return blocks.unpack_bits(codes, width) * 2.0 - 1.0


def _scan(
    index: RabitqIndex, block: QueryBlock, probes: Probes, epsilon: float, k: int, vec: str, pick, scoring=_ListScore
) -> DataFrame:
    """Run ``pick`` on every (list, rows) of the probed postings.

    ``pick(state, queries, list_queries, rows, estimate, error)`` offers what it
    wants to keep; it sees whole blocks, never single pairs.
    """
    postings, centroids = index.ivf.postings, blocks.unit_rows(index.ivf.centroids)
    residual = index.residual
    shipped = postings.sparkSession.sparkContext.broadcast(
        (block._replace(floats=blocks.unit_rows(block.floats)), probes.by_list, centroids)
    )
    columns = ["list_id", "vec_id", "rq_code", "rq_norm", "rq_dot"] + ([vec] if vec else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, wanted, centres = shipped.value
        state, scores = RunningTopK(len(local.ids), k), {}
        for batch in batches:
            codes, _ = blocks.read_vectors(batch.column(2), np.int64)
            ids, norms, dots = (batch.column(i).to_numpy() for i in (1, 3, 4))
            x = blocks.read_vectors(batch.column(5))[0] if vec else None
            for one, rows in by_list(batch.column(0).to_numpy()):
                if one not in wanted:
                    continue
                if one not in scores:
                    centre = centres[one] if residual else None
                    scores[one] = scoring(local.floats[wanted[one]], centre, epsilon)
                step = max(1, settings.BLOCK_CELLS // max(1, len(wanted[one])))
                for some in np.split(rows, range(step, len(rows), step)):
                    estimate, error = scores[one].of_codes(codes[some], norms[some], dots[some])
                    part = x[some] if vec else None
                    pick(state, local, wanted[one], ids[some], part, estimate, error)
        yield hits_batch(state, local.ids)

    rows = probes.only(postings, len(centroids)).select(*columns)
    return rows.mapInArrow(run, HITS)


def _offer(state: RunningTopK, columns: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
    rows, cols = np.nonzero(value <= state.bound[columns][None, :])
    state.offer(columns[cols], value[rows, cols], ids[rows])


def rabitq_estimate(
    queries: DataFrame, index: RabitqIndex, k: int, probes: int, epsilon: float = 1.9
) -> DataFrame:
    """The k rows of smallest estimated distance; vectors are not read."""

    def pick(state, local, columns, ids, x, estimate, error):
        # Equal codes get equal estimates whatever block they sit in.
        _offer(state, columns, ids, np.round(estimate, 12))

    def answer(block: QueryBlock) -> DataFrame:
        hits = _scan(index, block, probe_lists(block, index.ivf, probes), epsilon, k, "", pick)
        return top_k(hits, k, salts=merge_salts(hits, len(block.ids)))

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")


def rabitq_knn(
    queries: DataFrame, index: RabitqIndex, k: int, probes: int, epsilon: float = 1.9, vec: str = "f32", planes: bool = False
) -> DataFrame:
    """k nearest rows among those whose lower bound may still reach the top k.

    The first pass reads codes and finds, per query, the k-th smallest upper
    bound.  The second drops every row whose lower bound lies above it and
    scores the rest exactly where they are.  ``planes`` quantises the queries.
    """
    scoring = _PlaneScore if planes else _ListScore

    def uppers(state, local, columns, ids, x, estimate, error):
        _offer(state, columns, ids, estimate + error)

    def answer(block: QueryBlock) -> DataFrame:
        probed = probe_lists(block, index.ivf, probes)
        upper = top_k(_scan(index, block, probed, epsilon, k, "", uppers, scoring), k)
        kth = upper.filter(F.col("rk") == k).select("qid", "dist").toArrow()
        order = np.argsort(block.ids)
        limit = np.full(len(block.ids), np.inf)
        at = np.searchsorted(block.ids[order], kth.column("qid").to_numpy())
        limit[order[at]] = kth.column("dist").to_numpy()

        def survivors(state, local, columns, ids, x, estimate, error):
            rows, cols = np.nonzero(estimate - error <= limit[columns][None, :])
            dist = metrics.Cosine.exact(x, local.floats[columns], rows, cols)
            state.offer(columns[cols], dist, ids[rows])

        hits = _scan(index, block, probed, epsilon, k, vec, survivors, scoring)
        return top_k(hits, k, salts=merge_salts(hits, len(block.ids)))

    return per_block(queries, answer).select("qid", "rk", "vec_id", "dist")
