"""Distances between the rows of two matrices.

``coarse`` scores a whole block with one matrix product.  Its last bits depend
on where a row sits in the block, so near-ties are settled by ``exact``, which
sums each pair from the first element to the last: equal vectors get equal
distances and the id decides, whatever the partitioning.
"""

from __future__ import annotations

import numpy as np

PAIR_CHUNK = 1 << 16
DOT_ROWS = 2048  # products turned round at once, for sums of whole columns


def _chunks(total: int):
    for start in range(0, total, PAIR_CHUNK):
        yield slice(start, min(start + PAIR_CHUNK, total))


def ordered_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed in element order."""
    total = np.zeros(len(a))
    for start in range(0, len(a), DOT_ROWS):
        part = slice(start, start + DOT_ROWS)
        for products in np.ascontiguousarray((a[part] * b[part]).T):
            total[part] += products
    return total


class Cosine:
    slack = 1e-9

    @staticmethod
    def coarse(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        xn = np.sqrt(np.einsum("ij,ij->i", x, x))
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        return 1.0 - (x @ q.T) / (xn[:, None] * qn[None, :])

    @staticmethod
    def exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        used_x, at_x = np.unique(rows, return_inverse=True)
        used_q, at_q = np.unique(cols, return_inverse=True)
        xu, qu = x[used_x], q[used_q]
        xn, qn = np.sqrt(ordered_dots(xu, xu)), np.sqrt(ordered_dots(qu, qu))
        for part in _chunks(len(rows)):
            i, j = at_x[part], at_q[part]
            out[part] = 1.0 - ordered_dots(xu[i], qu[j]) / (xn[i] * qn[j])
        return out


class NegatedDot:
    slack = 1e-9

    @staticmethod
    def coarse(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return -(x @ q.T)

    @staticmethod
    def exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for part in _chunks(len(rows)):
            out[part] = -ordered_dots(x[rows[part]], q[cols[part]])
        return out


class Hamming:
    """Differing bits; words are read unsigned, as a signed count drops the sign."""

    slack = 0.0

    @staticmethod
    def coarse(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, q = x.view(np.uint64), q.view(np.uint64)
        total = np.zeros((len(x), len(q)), np.int32)
        for w in range(x.shape[1]):
            total += np.bitwise_count(x[:, w, None] ^ q[None, :, w])
        return total

    @staticmethod
    def exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for part in _chunks(len(rows)):
            out[part] = np.bitwise_count((x[rows[part]] ^ q[cols[part]]).view(np.uint64)).sum(axis=1)
        return out


METRICS = {"cosine": Cosine, "dot": NegatedDot, "hamming": Hamming}
DTYPES = {"cosine": np.float64, "dot": np.float64, "hamming": np.int64}


def metric_of(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name]
