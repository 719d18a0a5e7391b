"""Near-duplicate embeddings by int8 tile products with rigorous bounds.

Only vectors of one label are compared.  Equal vectors of a label are one class,
so copies cost one row.  Classes of a label are dealt into tiles of bounded size;
each pair of tiles is one small group.  A unit vector is ``x = s q + e`` with
8-bit integers ``q``; the product of the integer matrices is exact, and with
Cauchy-Schwarz on the remainders

    |x . y - s_x s_y q_x . q_y| <= |e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|

holds for every pair.  Pairs whose bound stays under the threshold are decided;
the others are computed again in double precision from the vectors themselves.
A group hands on link counts per class and a spanning forest of its links, never
the links, so a task's output is no longer than its input.

NULL labels, NULL, zero or non-finite vectors and vectors with NULL components
link with nothing.  Vectors of different width never link.  Repeated rows, and rows
that share a ``vec_id`` under other vectors or labels, are vectors of their own.  A
row with a NULL ``vec_id`` links with nothing; its component_id and kept are NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import connected
from nearfield.session import materialise

TILE_ROWS = 2048
EXACT_PAIRS = 1 << 15
SLAB = 1024  # dimensions per product: 127 * 127 * 1024 stays exact in single precision
ROUNDING = 1e-9  # room for rounding in the bounds themselves


def read_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Sound vectors of a list column as doubles, None for the others; -0.0 becomes 0.0."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    gap = np.asarray(flat.is_null())
    values = np.asarray(flat.fill_null(0.0)) + 0.0
    bad = gap | ~np.isfinite(values)
    out: list[np.ndarray | None] = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        row = values[end - size : end]
        out.append(row if size and row.any() and not bad[end - size : end].any() else None)
    return out


def with_keys(vectors: DataFrame, keep: tuple[str, ...] = (), vec: str = "embedding") -> DataFrame:
    """(vec_id, *keep, vkey, v): ``vkey`` names the content, NULL where no sound vector is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = read_rows(batch.column(batch.num_columns - 1))
            keys = [None if r is None else xxhash.xxh3_128_hexdigest(r.tobytes()) for r in rows]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(keys, pa.string()), pa.array(rows, kind)],
                names=[*batch.schema.names[:-1], "vkey", "v"],
            )

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), *keep, F.col(vec).cast("array<double>"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}vkey string, v array<double>")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |s q|, |e|) of unit rows."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    near = q * s[:, None]
    return q, s, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    total = 0.0
    for first in range(0, a.shape[1], SLAB):
        part = a[:, first : first + SLAB].astype(np.float32) @ b[:, first : first + SLAB].astype(np.float32).T
        total = total + part.astype(np.float64)
    return total


def tile_links(x: np.ndarray, y: np.ndarray, least: float, counted: list[int] | None = None) -> np.ndarray:
    """Boolean matrix of cosine >= ``least`` between the rows of ``x`` and of ``y``."""
    xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    xu, yu = x / xn[:, None], y / yn[:, None]
    qx, sx, nx, ex = quantised(xu)
    qy, sy, ny, ey = quantised(yu)
    rough = integer_product(qx, qy) * (sx[:, None] * sy[None, :])
    slack = ex[:, None] * (ny + ey)[None, :] + nx[:, None] * ey[None, :] + ROUNDING
    linked = np.zeros(rough.shape, bool)
    rows, cols = np.nonzero(rough + slack >= least)
    for first in range(0, len(rows), EXACT_PAIRS):
        i, j = rows[first : first + EXACT_PAIRS], cols[first : first + EXACT_PAIRS]
        cosine = np.einsum("ij,ij->i", x[i], y[j]) / (xn[i] * yn[j])
        linked[i, j] = cosine >= least
    if counted is not None:
        counted.append(len(rows))
    return linked


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``linked`` joins: each row and column to the smallest id it reaches."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part, a, b = linked[np.ix_(rows, cols)], left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while len(rows):
        a2 = np.minimum(a, np.where(part, b[None, :], top).min(axis=1))
        b2 = np.minimum(b, np.where(part, a2[:, None], top).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return np.concatenate([left[rows], right[cols]]), np.concatenate([a, b])


CELL = "node bigint, other bigint, links bigint"


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, vec: str = "embedding", label: str = "label", tile: int = TILE_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    keyed = with_keys(vectors.withColumn("_label", F.col(label).cast("string")), ("_label",), vec)
    # The width is part of a class's label, so a tile holds rows of one width.
    group = F.concat_ws(":", F.size("v").cast("string"), "_label")
    sound = F.col("vkey").isNotNull() & F.col("_label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = materialise(keyed.withColumn("grp", F.when(sound, group)).drop("_label"), "vectors")
    classes = keyed.filter("grp IS NOT NULL").groupBy("grp", "vkey").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")
    )
    # A class has a number of its own, as ids may occur in several classes; it is fixed when it is written.
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(sizes, "grp").withColumn("t", F.pmod(F.xxhash64("vkey"), F.col("tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    spread = dealt.select("grp", "rep", "n", "v", "t", others)
    cells = spread.select("grp", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "rep", "n", "v", "t")

    def run(table: pa.Table) -> pa.Table:
        rep, n = np.asarray(table.column("rep")), np.asarray(table.column("n"))
        t = np.asarray(table.column("t"))
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(rep), -1)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        a, b = np.flatnonzero(t == lo), np.flatnonzero(t == hi)
        linked = tile_links(x[a], x[b], least)
        if lo == hi:
            np.fill_diagonal(linked, False)
        to_a, to_b = linked @ n[b], linked.T @ n[a]
        node, count = (rep[a], to_a) if lo == hi else (np.append(rep[a], rep[b]), np.append(to_a, to_b))
        some = count > 0
        ends, tops = forest(linked, rep[a], rep[b])
        return pa.table(
            {
                "node": np.append(node[some], ends).astype(np.int64),
                "other": pa.array(np.append(np.zeros(some.sum(), np.int64), tops), mask=np.arange(some.sum() + len(ends)) < some.sum()),
                "links": np.append(count[some], np.zeros(len(ends), np.int64)).astype(np.int64),
            }
        )

    found = materialise(cells.groupBy("grp", "lo", "hi").applyInArrow(run, CELL), "cells")
    links = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected(found.filter("other IS NOT NULL"), "node", "other")
    result = classes.select("grp", "vkey", "rep", "least", "n").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    result = materialise(result.withColumn("component", F.coalesce("component", "rep")).drop("rep"), "linked")
    named = result.groupBy("component").agg(F.min("least").alias("component_id"))
    result = result.join(named, "component").select(
        "grp", "vkey", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = keyed.select("vec_id", "grp", "vkey").join(result, ["grp", "vkey"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), (component == F.col("vec_id")).alias("kept"),
    )
