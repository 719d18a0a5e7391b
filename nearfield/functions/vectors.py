"""Column functions on vectors.

Per-element work on whole vectors runs as Arrow functions (one matrix step per
batch).  Reshaping, text and pair distances are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import blocks

_ELEMENTS = {"double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "tinyint": pa.int8()}


def vector_function(step: Callable[[np.ndarray], np.ndarray], element: str):
    """A column function ``array -> array<element>`` from a matrix step."""
    arrow_type = _ELEMENTS[element]

    @F.arrow_udf(f"array<{element}>")
    def apply(column: pa.Array) -> pa.Array:
        matrix, valid = blocks.read_vectors(column)
        return blocks.write_vectors(step(matrix), valid, arrow_type)

    return apply


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_normalize(c: Column | str) -> Column:
    """Unit-length vector in double; a zero vector gives NULL."""
    return vector_function(blocks.unit_rows, "double")(_col(c))


def pad_truncate(c: Column | str, width: int) -> Column:
    """Zero-pad or truncate to ``width`` elements."""
    padded = F.concat(_col(c), F.array_repeat(F.lit(0.0).cast("float"), width))
    return F.slice(padded, 1, width)


def matryoshka_slice(c: Column | str, dim: int) -> Column:
    """The first ``dim`` elements, normalised again."""
    return l2_normalize(F.slice(_col(c), 1, dim))


def prepared(c: Column | str, full_dim: int, dim: int) -> Column:
    """Widen to ``full_dim``, normalise, take the ``dim`` prefix, normalise."""
    return vector_function(lambda m: blocks.prepared_rows(m, full_dim, dim), "double")(_col(c))


def to_float32(c: Column | str) -> Column:
    return _col(c).cast("array<float>")


def to_half(c: Column | str) -> Column:
    """Values rounded to half precision, held as float."""
    return vector_function(blocks.half_rows, "float")(_col(c))


def vector_to_text(c: Column | str) -> Column:
    """``[a,b,...]`` with the shortest digits that read back unchanged."""
    return F.concat(F.lit("["), F.array_join(_col(c).cast("array<string>"), ","), F.lit("]"))


def text_to_vector(c: Column | str) -> Column:
    return F.from_json(_col(c), "array<float>")


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Dot product in double, summed from the first element to the last."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.lit(1.0) - inner_product(a, b) / norms


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two packed codes."""
    counts = F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)


def hash_order(seed: str, c: Column | str) -> Column:
    """A seeded pseudo-random order key that every engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(seed), _col(c).cast("string")))
