"""Shards of near equal bytes by histogram sort.

Documents are sorted by id and cut at the byte quantiles.  The sort key is a pair
of longs, (id, tie); ties of an id go by a hash of the text and then by a number of
the row itself, so even a crowd of equal rows is cut anywhere.  The splitters are
found without sorting: every round counts the exact bytes below a few hundred probe
keys between the bounds of each open splitter, in all partitions at once, and keeps
the two probes around the target, until one of them meets the tolerance or a single
row lies between them.  Then the rows, whose place is known by then, are exchanged
once: each shard in pieces of near equal bytes, each piece sorted on its own, and a
slot is the exact number of rows before the piece plus the place in it.

NULL texts have no bytes, a NULL id sorts as the smallest long, every row counts one byte more than
its text.  Repeated rows are rows of their own; which of them comes first is open.
An empty table has no rows, and with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import broadcast_limit, materialise, shuffle_partitions

SHARDS = 16
TOLERANCE = 0.001  # of a shard's bytes, on either side of a splitter
PROBES = 256  # parts into which a round divides the range of an open splitter
PIECE_TOLERANCE = 0.25
PIECE_PROBES = 16
SIGN = 1 << 63
HASHED = -(1 << 32)  # the upper half of a long


def document_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def with_keys(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``rows`` plus the sort key (_a, _b).  The row number is fixed only once the result is written."""
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(~HASHED))
    tie = F.xxhash64(text).bitwiseAND(F.lit(HASHED)).bitwiseOR(row)
    return rows.withColumns({"_a": F.coalesce(F.col(key).cast("bigint"), F.lit(-SIGN)), "_b": tie})


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort as the pairs do."""
    parts = [c.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN) for c in (a, b)]
    return np.stack(parts, axis=1).astype(">u8").view("S16").ravel()


def as_bytes(keys: list[int]) -> np.ndarray:
    """The same from whole numbers; 2 ** 128 lies above all keys."""
    above = max(keys, default=0) >> 128
    return np.array([b"\xff" * 17 if k >> 128 else k.to_bytes(16, "big") for k in keys], "S17" if above else "S16")


class Counts(NamedTuple):
    """Exact bytes and rows below each probe."""

    size: list[int]
    rows: list[int]


def count_below(keyed: DataFrame, probes: list[int]) -> Counts:
    """Bytes and rows of ``keyed`` (_a, _b, size) below each of the ascending ``probes``.

    Every task adds up its rows between two probes; so many sums are shuffled.
    """
    shipped = keyed.sparkSession.sparkContext.broadcast(as_bytes(probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shipped.value
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            a, b, n = (np.asarray(c) for c in batch.columns)
            at = np.searchsorted(bounds, packed(a, b), "right")
            np.add.at(size, at, n)
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"at": held.astype(np.int32), "size": size[held], "rows": rows[held]})

    partial = keyed.select("_a", "_b", "size").mapInArrow(run, "at int, size bigint, rows bigint")
    table = partial.groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toArrow()
    between = np.zeros((2, len(probes) + 1), np.int64)
    between[:, np.asarray(table.column("at"))] = np.asarray(table.column("size")), np.asarray(table.column("rows"))
    below = np.cumsum(between, axis=1)[:, :-1]
    return Counts(below[0].tolist(), below[1].tolist())


class Bound(NamedTuple):
    key: int
    size: int  # bytes below
    rows: int  # rows below


def find_splitters(
    keyed: DataFrame, targets: list[float], tolerance: float, low: Bound, high: Bound, probes: int = PROBES
) -> list[Bound]:
    """For each target a key with about so many bytes below it.

    A splitter is off by at most ``tolerance`` bytes, or by the row that holds the
    target.  ``low`` and ``high`` have nothing and everything below them.
    """
    spans = [(low, high)] * len(targets)

    def nearer(target: float, span: tuple[Bound, Bound]) -> Bound:
        return min(span, key=lambda bound: abs(bound.size - target))

    def is_open(target: float, span: tuple[Bound, Bound]) -> bool:
        off = abs(nearer(target, span).size - target)
        return off > tolerance and span[1].rows - span[0].rows > 1 and span[1].key - span[0].key > 1

    while True:
        asked = set()
        for target, span in zip(targets, spans, strict=True):
            if is_open(target, span):
                first, width = span[0].key, span[1].key - span[0].key
                asked.update(first + width * i // probes for i in range(1, probes))
        if not asked:
            return [nearer(*pair) for pair in zip(targets, spans, strict=True)]
        keys = sorted(asked)
        known = [Bound(*bound) for bound in zip(keys, *count_below(keyed, keys), strict=True)]
        sizes = [bound.size for bound in known]
        for i, (target, (before, after)) in enumerate(zip(targets, spans, strict=True)):
            # Probes of other splitters narrow a range as well.
            at = int(np.searchsorted(sizes, target, "right"))
            if at > 0 and known[at - 1].key > before.key:
                before = known[at - 1]
            if at < len(known) and known[at].key < after.key:
                after = known[at]
            spans[i] = before, after


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    keep: list[str] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) plus ``size``, ``shard`` and ``slot``.

    Columns of ``docs`` named size, shard or slot, or as the keys made here, are left out.
    """
    body = F.col(text).cast("string")
    made = {"size", "shard", "slot", "_a", "_b", "_at", "_piece"}
    kept = [c for c in keep or docs.columns if c not in made]
    keyed = with_keys(docs.drop(*(made - {key, text})).withColumn("_size", document_bytes(body)), key, body)
    rows = materialise(keyed.select(*kept, F.col("_size").alias("size"), "_a", "_b"), "shard_keys")
    total, count, least, most = rows.agg(F.sum("size"), F.count("*"), F.min("_a"), F.max("_a")).first()
    if not count:
        empty = rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("bigint"))
        return empty.drop("_a", "_b")
    low = Bound((least + SIGN) << 64, 0, 0)
    high = Bound((most + SIGN + 1) << 64, total, count)
    cuts = find_splitters(rows, [total * i / shards for i in range(1, shards)], tolerance * total / shards, low, high)
    # Each shard is sorted in pieces, so many that all partitions of a shuffle have work.
    pieces = -(-shuffle_partitions(rows.sparkSession) // shards)
    inner, edges = [], [low, *cuts, high]
    for one, next_one in zip(edges, edges[1:], strict=False):
        inner += [one.size + (next_one.size - one.size) * i / pieces for i in range(1, pieces)]
    inner = find_splitters(rows, inner, PIECE_TOLERANCE * total / shards / pieces, low, high, PIECE_PROBES)
    # A shard without rows repeats the cut before it: the rows at a key belong to the last one.
    bounds = sorted({bound.key: bound for bound in inner + cuts}.values())
    if 32 * len(bounds) > broadcast_limit(rows.sparkSession):
        raise ValueError("the pieces exceed the broadcast limit; use fewer shuffle partitions")
    ends = as_bytes([bound.key for bound in cuts])
    of_piece = np.searchsorted(ends, as_bytes([bound.key for bound in [low, *bounds]]), "right").astype(np.int32)
    starts = np.array([0, *(bound.rows for bound in cuts)], np.int64)
    base = np.array([0, *(bound.rows for bound in bounds)], np.int64) - starts[of_piece]
    shipped = rows.sparkSession.sparkContext.broadcast((as_bytes([b.key for b in bounds]), of_piece, base))

    @F.arrow_udf("struct<piece:int,shard:int,base:bigint>")
    def place(a: pa.Array, b: pa.Array) -> pa.Array:
        keys, shard_of, before = shipped.value
        at = np.searchsorted(keys, packed(np.asarray(a), np.asarray(b)), "right")
        made = [pa.array(at.astype(np.int32)), pa.array(shard_of[at]), pa.array(before[at])]
        return pa.StructArray.from_arrays(made, ["piece", "shard", "base"])

    placed = rows.withColumn("_at", place("_a", "_b"))
    placed = placed.select("*", F.col("_at.piece").alias("_piece"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy("_a", "_b"))
    out = placed.withColumn("slot", F.col("_at.base") + within - 1).withColumn("shard", F.col("_at.shard"))
    return out.drop("_a", "_b", "_at", "_piece")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=N`` per shard; its files hold runs of consecutive slots."""
    sharded.write.partitionBy("shard").parquet(path)
