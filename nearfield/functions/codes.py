"""Binary codes of vectors: sign, mean, thermometer and one-hot.

A code is a packed ``array<bigint>``.  Thresholds ascend, so a thermometer or
one-hot code is fixed by the bucket index of each dimension.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.functions.vectors import _col, vector_function

VARIANTS = ("sign", "mean", "thermo4", "thermo8", "onehot4", "onehot8")


class Thresholds(NamedTuple):
    """Learned cut points of every dimension, and how they were learned."""

    mean: np.ndarray  # (D,)
    t4: np.ndarray  # (D, 3)
    t8: np.ndarray  # (D, 7)
    mode: str  # "full" or "slice"
    exact: bool = True

    def cuts(self, variant: str) -> np.ndarray:
        return self.t4 if variant.endswith("4") else self.t8


def bits_per_dim(variant: str) -> int:
    """Code bits spent on one dimension."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown code variant: {variant}")
    return int(variant[-1]) if variant[-1].isdigit() else 1


def bucket_rows(matrix: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bucket index of every element: how many of its cut points it reaches."""
    return (matrix[:, :, None] >= cuts[None, : matrix.shape[1], :]).sum(axis=2, dtype=np.int8)


def bit_rows(
    matrix: np.ndarray, variant: str, thresholds: Thresholds | None, width: int | None = None
) -> np.ndarray:
    """0/1 rows of a variant, ``width`` bits for each dimension."""
    dims = matrix.shape[1]
    if variant == "sign":
        return (matrix > 0).astype(np.uint8)
    if variant == "mean":
        return (matrix >= thresholds.mean[None, :dims]).astype(np.uint8)
    width = width or bits_per_dim(variant)
    buckets = bucket_rows(matrix, thresholds.cuts(variant))[:, :, None]
    slots = np.arange(width, dtype=np.int8)[None, None, :]
    bits = slots < buckets if variant.startswith("thermo") else slots == buckets
    return bits.astype(np.uint8).reshape(len(matrix), dims * width)


def code_rows(
    matrix: np.ndarray, variant: str, thresholds: Thresholds | None, width: int | None = None
) -> np.ndarray:
    return blocks.pack_bits(bit_rows(matrix, variant, thresholds, width))


def code(
    c: Column | str, variant: str, thresholds: Thresholds | None = None, width: int | None = None
) -> Column:
    """Packed code of a normalised vector column."""
    if width is not None and width < bits_per_dim(variant) - variant.startswith("thermo"):
        raise ValueError(f"{variant} needs more than {width} bits for each dimension")
    return vector_function(lambda m: code_rows(m, variant, thresholds, width), "bigint")(_col(c))


def buckets(c: Column | str, variant: str, thresholds: Thresholds) -> Column:
    """Bucket indexes as ``array<tinyint>``, the compact form of a code."""
    cuts = thresholds.cuts(variant)
    return vector_function(lambda m: bucket_rows(m, cuts), "tinyint")(_col(c))


def bits_to_string(words: Column | str, nbits: int) -> Column:
    """Packed code as a string of 0 and 1, first dimension first."""
    one_word = lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))
    return F.substring(F.array_join(F.transform(_col(words), one_word), ""), 1, nbits)


def string_to_words(text: Column | str) -> Column:
    """Packed code read back from its bit string."""
    text = _col(text)
    count = F.ceil(F.length(text) / 64).cast("int")
    padded = F.rpad(text, count * 64, "0")

    def word(i: Column) -> Column:
        chunk = F.reverse(F.substr(padded, i * 64 + 1, F.lit(64)))
        # conv() reads 64 unsigned bits; the halves keep every word in range.
        high = F.conv(F.substr(chunk, F.lit(1), F.lit(32)), 2, 10).cast("bigint")
        low = F.conv(F.substr(chunk, F.lit(33), F.lit(32)), 2, 10).cast("bigint")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.transform(F.sequence(F.lit(0), count - 1), word)
