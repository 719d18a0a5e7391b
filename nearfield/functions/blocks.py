"""Arrow lists as matrices, and the small matrix steps shared by the operators.

An Arrow batch of vectors is one flat buffer, so a batch becomes a matrix
without touching single rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def read_vectors(column: pa.Array, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the valid rows, mask of valid rows) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    column = column.drop_null()
    if len(column) == 0:
        return np.zeros((0, 0), dtype), valid
    widths = pc.list_value_length(column)
    width = widths[0].as_py()
    if pc.any(pc.not_equal(widths, width)).as_py():
        raise ValueError("vectors of one column must share one width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width).astype(dtype, copy=False), valid


def write_vectors(matrix: np.ndarray, valid: np.ndarray, element: pa.DataType) -> pa.Array:
    """A list column from the valid rows; a row holding NaN becomes NULL."""
    if matrix.dtype.kind == "f" and matrix.size:
        sound = ~np.isnan(matrix).any(axis=1)
        if not sound.all():
            valid = valid.copy()
            valid[np.flatnonzero(valid)[~sound]] = False
            matrix = matrix[sound]
    width = matrix.shape[1] if matrix.ndim == 2 else 0
    offsets = np.zeros(len(valid) + 1, np.int32)
    np.cumsum(np.where(valid, width, 0), out=offsets[1:])
    values = pa.array(np.ascontiguousarray(matrix).ravel(), type=element)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))


def widen(matrix: np.ndarray, width: int) -> np.ndarray:
    """Zero-pad or truncate every row to ``width``."""
    missing = width - matrix.shape[1]
    return np.pad(matrix, ((0, 0), (0, missing))) if missing > 0 else matrix[:, :width]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero or unsound row turns into NaN."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[(norms == 0) | ~np.isfinite(norms)] = np.nan
    return matrix / norms[:, None]


def half_rows(matrix: np.ndarray) -> np.ndarray:
    """Values rounded to IEEE half precision, overflow to infinity."""
    with np.errstate(over="ignore"):
        return matrix.astype(np.float16).astype(np.float32)


def prepared_rows(matrix: np.ndarray, full_dim: int, dim: int) -> np.ndarray:
    """Widen, normalise, take the prefix, normalise again."""
    full = unit_rows(widen(matrix, full_dim))
    return full if dim == full_dim else unit_rows(full[:, :dim])


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """0/1 rows as 64-bit words; bit ``i`` sits at bit ``i % 64`` of word ``i // 64``."""
    octets = np.packbits(bits, axis=1, bitorder="little")
    missing = -octets.shape[1] % 8
    return np.ascontiguousarray(np.pad(octets, ((0, 0), (0, missing)))).view(np.int64)


def unpack_bits(words: np.ndarray, nbits: int) -> np.ndarray:
    octets = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(octets, axis=1, count=nbits, bitorder="little")
