"""Token ids in files of patched frame-of-reference blocks.

A block holds ``BLOCK`` ids: its minimum is taken off, the rest is packed at the
width that the chosen percentile of its values needs, and wider values stand in
an exception list.  A file keeps the start of every block, so one block can be
read alone, and the ids and lengths of its documents in ascending order.

Layout, all little-endian: magic, block length u32, number of ids u64, number of
blocks u64, number of exceptions u64, number of documents u64, then the columns
minimum u32, width u8, block starts u64 (one more than blocks), exception starts
u64 (one more), exception places u16, exception values u32, document keys i64,
document key valid u8, document lengths u32, and the packed bits.

Documents come in ascending key order, NULL keys first, rows of one key by a hash of the text;
a NULL text is an empty one and still gets its end id.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.text import in_small_batches
from nearfield.session import scratch_path, shuffle_partitions

MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<8sIQQQQ")
BLOCK = 256
PERCENTILE = 0.9
FILE_IDS = 1 << 22
_STEP = 1 << 9  # blocks handled at once
KEPT_CHUNKS = 1 << 19
TEXTS_AT_ONCE = 256
WORDS_AT_ONCE = 500
WORD_END = "</w>"
KEPT_CHARS = 48


def pack(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> dict[str, np.ndarray]:
    """Columns of the blocks of ``values`` (unsigned 32-bit)."""
    blocks = -(-len(values) // block)
    padded = np.empty(blocks * block, np.uint32)
    padded[: len(values)] = values
    if blocks:
        padded[len(values) :] = values[(blocks - 1) * block :].min()
    grid = padded.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    needed = np.frexp(rest.astype(np.float64))[1]
    at = max(0, int(np.ceil(percentile * block)) - 1)
    width = np.partition(needed, at, axis=1)[:, at].astype(np.uint8) if blocks else np.zeros(0, np.uint8)
    wide = needed > width[:, None]
    where, place = np.nonzero(wide)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (block // 8))])
    bits = np.empty(starts[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for first in range(0, len(rows) if w else 0, _STEP):
            some = rows[first : first + _STEP]
            each = np.unpackbits(np.ascontiguousarray(rest[some]).astype("<u4").view(np.uint8), bitorder="little")
            each = each.reshape(len(some), block, 32)[:, :, :w].reshape(len(some), -1)
            packed = np.packbits(each, axis=1, bitorder="little")
            bits[starts[some][:, None] + np.arange(packed.shape[1])] = packed
    return {
        "low": low.astype("<u4"),
        "width": width,
        "starts": starts.astype("<u8"),
        "patches": np.concatenate([[0], np.cumsum(wide.sum(axis=1))]).astype("<u8"),
        "place": place.astype("<u2"),
        "patch": rest[where, place].astype("<u4"),
        "bits": bits,
    }


def unpack(columns: dict[str, np.ndarray], count: int, block: int = BLOCK) -> np.ndarray:
    width, starts = columns["width"], columns["starts"].astype(np.int64)
    rest = np.zeros((len(width), block), np.uint32)
    for w in np.unique(width):
        rows, size = np.flatnonzero(width == w), int(w) * (block // 8)
        for first in range(0, len(rows) if w else 0, _STEP):
            some = rows[first : first + _STEP]
            packed = columns["bits"][starts[some][:, None] + np.arange(size)]
            each = np.zeros((len(some), block, 32), np.uint8)
            each[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), block, w)
            rest[some] = np.packbits(each.reshape(len(some), -1), axis=1, bitorder="little").view("<u4")
    where = np.repeat(np.arange(len(width)), np.diff(columns["patches"].astype(np.int64)))
    rest[where, columns["place"]] = columns["patch"]
    return (rest + columns["low"][:, None]).reshape(-1)[:count]


def read_block(columns: dict[str, np.ndarray], i: int, block: int = BLOCK) -> np.ndarray:
    """Ids of block ``i`` alone, by the index of block starts."""
    bits = slice(int(columns["starts"][i]), int(columns["starts"][i + 1]))
    patches = slice(int(columns["patches"][i]), int(columns["patches"][i + 1]))
    one = {"low": columns["low"][i : i + 1], "width": columns["width"][i : i + 1], "bits": columns["bits"][bits]}
    one |= {"starts": np.zeros(1, np.int64), "patches": np.array([0, patches.stop - patches.start])}
    one |= {"place": columns["place"][patches], "patch": columns["patch"][patches]}
    return unpack(one, block, block)


def to_bytes(ids: np.ndarray, keys: list[int | None], lengths: list[int]) -> bytes:
    c = pack(ids)
    valid = np.array([k is not None for k in keys], np.uint8)
    named = np.array([k or 0 for k in keys], "<i8")
    head = HEAD.pack(MAGIC, BLOCK, len(ids), len(c["width"]), len(c["patch"]), len(keys))
    parts = [c[n] for n in ("low", "width", "starts", "patches", "place", "patch")]
    return b"".join([head, *(p.tobytes() for p in (*parts, named, valid, np.array(lengths, "<u4"), c["bits"]))])


def open_bytes(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """(columns, header) of a file; columns are views on ``data``."""
    magic, block, ids, blocks, patches, docs = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    layout = [("low", "<u4", blocks), ("width", "u1", blocks), ("starts", "<u8", blocks + 1)]
    layout += [("patches", "<u8", blocks + 1), ("place", "<u2", patches), ("patch", "<u4", patches)]
    layout += [("keys", "<i8", docs), ("valid", "u1", docs), ("lengths", "<u4", docs)]
    columns, at = {}, HEAD.size
    for name, kind, count in layout:
        columns[name] = np.frombuffer(data, kind, count, at)
        at += columns[name].nbytes
    columns["bits"] = np.frombuffer(data, np.uint8, offset=at)
    return columns, {"block": block, "ids": ids, "docs": docs}


@functools.cache
def tokenizer(path: str):
    # A task has one core.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def chunks(path: str) -> _Chunks:
    """What a worker process keeps from task to task; two generations of ``KEPT_CHUNKS`` at most."""
    return _Chunks(path)


# A stop or comma between an ASCII letter and a blank is a piece of its own.
_AFTER_WORD = re.compile(r"(?<=[A-Za-z])(?=[.,](?:[ \n]|$))")


class _Chunks(dict):
    """Ids by text between blanks, in two generations.

    No token of this vocabulary holds white space, letters are lower-cased first
    and stops never join the letters before them, so texts are cut at blanks and
    before stops and encoded chunk by chunk.
    """

    def __init__(self, path: str):
        super().__init__()
        self.coder, self.older = tokenizer(path), {}
        names = self.coder.get_vocab()
        self.final = np.zeros(max(names.values()) + 1, bool)
        self.final[[i for name, i in names.items() if name.endswith(WORD_END)]] = True

    @staticmethod
    def cut(text: str) -> list[str]:
        if "<|" not in text:  # special entries are found as they are written
            text = text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")
        text = _AFTER_WORD.sub(" ", text)
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _encode(self, chunks: list[str]) -> None:
        """Words of Latin-1 letters are one piece each: encoded side by side, a final token ends each."""
        plain = [c for c in chunks if c.isalpha() and max(c) <= "\xff"]
        other = [c for c in chunks if not (c.isalpha() and max(c) <= "\xff")]
        for first in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[first : first + WORDS_AT_ONCE]
            code = self.coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(code.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
            if len(ends) != len(part):
                other += part
                continue
            packed = ids.tobytes()
            self.update(zip(part, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for chunk, code in zip(other, self.coder.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self[chunk] = struct.pack(f"<{len(code.ids)}I", *code.ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; chunks not met lately go to the library together."""
        cut = [self.cut(text) for text in texts]
        missing = {c for chunks in cut for c in chunks if c not in self}
        if len(self) + len(missing) > KEPT_CHUNKS:
            self.older = dict(self)
            self.clear()
            missing = {c for chunks in cut for c in chunks}
        new = []
        for chunk in missing:
            known = self.older.get(chunk)
            if known is None:
                new.append(chunk)
            else:
                self[chunk] = known
        self._encode(new)
        out = [b"".join(map(self.__getitem__, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del self[chunk]
        return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


MANIFEST = "part int, file int, path string, docs bigint, ids bigint"


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    text: str = "text",
    key: str = "doc_id",
    parts: int | None = None,
) -> str:
    """Write the ids of every row in ascending key order; returns the folder.

    Rows are dealt by ranges of the key, so a source or a key of any weight only
    fills its own range.  Each task writes files of about ``FILE_IDS`` ids under
    names of its own; the manifest, which Spark commits, names the files that
    count, so a task that is run again leaves at most unnamed files behind.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = chunks(tokenizer_path), np.array([end_id], "<u4").tobytes()
        system, where = _open(folder)
        system.create_dir(where, recursive=True)
        part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        packed, keys, lengths = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.frombuffer(b"".join(packed), "<u4")
            name = f"part-{part:06d}-{number:05d}-{attempt}.pfor"
            with system.open_output_stream(f"{where}/{name}") as out:
                out.write(to_bytes(ids, keys, lengths))
            row = [[part], [number], [f"{folder}/{name}"], [len(keys)], [len(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            number += 1
            packed.clear(), keys.clear(), lengths.clear()
            names = ["part", "file", "path", "docs", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(first, TEXTS_AT_ONCE)
                texts = [value or "" for value in some.column(1).to_pylist()]
                for name, ids in zip(some.column(0).to_pylist(), coder.texts(texts), strict=True):
                    packed.append(ids + end)
                    keys.append(name)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        held = 0
                        yield flush()
        if keys:
            yield flush()

    rows = in_small_batches(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    by = [F.col("key"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts or shuffle_partitions(spark), *by)
    written = dealt.sortWithinPartitions(*by).mapInArrow(run, MANIFEST)
    written.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file with ``start``, the number of ids in all files before it."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("bigint"))


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) per document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = _open(path)
                with system.open_input_stream(where) as file:
                    columns, head = open_bytes(file.read())
                ids = unpack(columns, head["ids"], head["block"]).astype("<u4").tobytes()
                ends = np.cumsum(columns["lengths"].astype(np.int64))
                begins = ends - columns["lengths"]
                cut = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = {
                    "key": pa.array(columns["keys"].astype(np.int64), mask=columns["valid"] == 0),
                    "start": pa.array(begins + start),
                    "n_tokens": pa.array(columns["lengths"].astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cut, pa.binary())} if keep_ids else {}))

    files = manifest(spark, folder).select("path", "start")
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    # A file is one task's work; dealt by name, so none waits for another.
    dealt = files.repartition(shuffle_partitions(spark), "path")
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)
