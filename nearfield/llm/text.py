"""Words of Arrow text columns as hashes, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
TEXT_ROWS = 1024
TEXT_BYTES = 4 << 20
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_BYTES_DEFAULT = "67108864b"
_HASHED_BYTES = 64  # longer words are hashed one by one
_PRIME = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; its session sends texts to Python ``TEXT_ROWS`` rows or ``TEXT_BYTES`` bytes at a time, unless it is set lower.

    A batch is held by the JVM and by Python at once, and texts are long.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_KEY)) <= TEXT_ROWS:
        conf.set(_ROWS_KEY, TEXT_ROWS)
    if conf.get(_BYTES_KEY) == _BYTES_DEFAULT:
        conf.set(_BYTES_KEY, TEXT_BYTES)
    return docs


class Words(NamedTuple):
    """Words of some consecutive rows: ``row`` counts from ``first``."""

    first: int
    rows: int
    hashes: np.ndarray
    row: np.ndarray
    starts: list[tuple[np.ndarray, np.ndarray]] = []  # (hash, row) of the words' first bytes, by wanted length


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the words of lower-cased ``data``; rows begin at ``offsets``."""
    inside = ~_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - start
    return start, length, np.searchsorted(offsets, start, "right") - 1


def hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray, beginnings: tuple[int, ...] = ()):
    """(hash of each word, [hash of its first bytes, for words longer than that])."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    h = np.full(len(at), _SEED)
    many, taken = len(at), {}
    for k in range(min(_HASHED_BYTES, int(size[0]) if many else 0)):
        many = int(np.searchsorted(-size[:many], -k, "left"))
        if k in beginnings:
            taken[k] = order[:many], mixed(h[:many] ^ np.uint64(k))
        h[:many] = (h[:many] ^ data[at[:many] + k].astype(np.uint64)) * _PRIME
    for i in range(int(np.searchsorted(-size, -_HASHED_BYTES, "left"))):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(h)
    out[order] = mixed(h)
    return out, [taken[k] for k in beginnings if k in taken]


def words(column: pa.Array, beginnings: tuple[int, ...] = ()) -> Iterator[Words]:
    """Hashed words of a text column, in runs of rows of about a megabyte.

    ``beginnings`` also asks for the first so many bytes of every longer word.
    """
    data, offsets = byte_rows(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        part = _LOWER[data[offsets[first] : offsets[last]]]
        start, length, row = spans(part, offsets[first : last + 1] - offsets[first])
        whole, firsts = hashed(part, start, length, beginnings)
        yield Words(first, last - first, whole, row, [(h, row[at]) for at, h in firsts])
        first = last
