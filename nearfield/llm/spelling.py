"""Spelling variants: words one edit apart, found by products of letter counts.

Words are counted over all documents, task by task.  A word's letters are counted
into a vector; one inserted or deleted letter moves it by a squared distance of 1,
one replaced letter by 2.  Words are compared in blocks: one product of NumPy
matrices gives the squared distances of a block, pairs at most 2 apart whose lengths
are equal or adjacent are kept, and their letters are compared.

A block holds words of one length, or of two adjacent ones, that also agree on the
counts of most letters: the alphabet is dealt into ``GROUPS`` groups of about equal
use, and an edit changes the counts of one group or two.  So words of one length
that are near agree on all groups but two, words of adjacent lengths on all but
one; for every choice of the groups left out (a family) the counts of the others
are a block's key.  Every near pair meets, and it is counted in the first family
in which it does.  A block of more than ``TILE`` words is dealt into tiles, each two
of which meet in a cell of their own; small blocks share a product.

A cell hands on a row for each of its words that is near another, never the pairs.
Letters are ``[A-Za-z]`` and U+00C0 to U+00FF, one byte each in Latin-1, which is
how words are kept until the end; the order of bytes is that of code points.  NULL
and empty texts have no words; a NULL doc_id is written as nothing in the hash.
Repeated rows count again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import broadcast_limit, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LEAST_LETTERS = 5
LEAST_SEEN = 3
SLIPS = 97  # of so many (document, word) pairs one loses a letter
RATIO = 2  # a form is so many times as frequent
HELD_WORDS = 1 << 17  # words a task counts before it hands them on
GROUPS = 5
TILE = 512
TILE_BYTES = 1 << 24  # letters of a tile
CHECKED = 1 << 20  # letters compared at once
LISTED = 1 << 20  # code points of a text whose runs are listed at once
LETTERS = 26 + 64
BIG_BYTES = 24  # of a large block's row

# Column of each Latin-1 byte in a vector of letter counts.
COLUMN = np.zeros(256, np.int64)
COLUMN[97:123] = np.arange(26)
COLUMN[0xC0:] = np.arange(26, LETTERS)


def slipped(key: str, word: str) -> str:
    """``word``, or without one letter where the hash of document and word says so."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % SLIPS:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def runs(text: str) -> Counter:
    """Lower-cased runs of a text and how often they occur."""
    # A very long text isn't held a second time as a list of its runs.
    found = Counter(RUN.findall(text) if len(text) <= LISTED else (match.group() for match in RUN.finditer(text)))
    out: Counter = Counter()
    for run, n in found.items():
        out[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return out


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(code, n): words of ``LEAST_LETTERS`` and more, in Latin-1, seen ``LEAST_SEEN`` times and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            codes = [word.encode("latin-1") for word in held]
            return pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.binary()), "n": np.array([*held.values()], np.int64)})

        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                if not body.is_valid:
                    continue
                name = doc.as_py() or ""
                for word, n in runs(body.as_py()).items():
                    if len(word) >= LEAST_LETTERS:
                        word = slipped(name, word)
                        if len(word) >= LEAST_LETTERS:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    counted = texts.filter("text <> ''").mapInArrow(run, "code binary, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)


class Words:
    """Latin-1 words of an Arrow column and their letter counts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.letters = data[offsets[0] : offsets[-1]]
        self.starts = offsets[:-1] - offsets[0]
        self.lengths = np.diff(offsets)
        row = np.repeat(np.arange(len(column)), self.lengths)
        at = row * LETTERS + COLUMN[self.letters]
        self.counts = np.bincount(at, minlength=len(column) * LETTERS).reshape(-1, LETTERS)

    def edited_once(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words ``i`` and ``j`` (no shorter) differ by exactly one edit; lengths differ by 0 or 1."""
        out = np.zeros(len(i), bool)
        order = np.argsort(self.lengths[j], kind="stable")
        first = 0
        while first < len(order):
            # Pairs of like lengths share a matrix as wide as the longest of them.
            last = min(len(order), first + max(1, CHECKED // int(self.lengths[j[order[first]]])))
            width = int(self.lengths[j[order[last - 1]]])
            last = min(last, first + max(1, CHECKED // width))
            part = order[first:last]
            out[part] = self._edited_once(i[part], j[part], int(self.lengths[j[part]].max()))
            first = last
        return out

    def _edited_once(self, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(width)
        short, long = self.lengths[i], self.lengths[j]
        last = len(self.letters) - 1
        a = self.letters[np.minimum(self.starts[i][:, None] + at, last)]
        b = self.letters[np.minimum(self.starts[j][:, None] + at, last)]
        inside = at < short[:, None]
        same = (a == b) | ~inside
        replaced = (short == long) & ((~same).sum(axis=1) == 1)
        # A letter more: equal up to some place, and from there on with a shift of one.
        b = np.concatenate([b[:, 1:], b[:, :1]], axis=1)
        shifted = (a == b) | ~inside
        prefix = np.minimum(np.where(same.all(axis=1), width, np.argmin(same, axis=1)), short)
        suffix = np.where(shifted.all(axis=1), width, np.argmin(shifted[:, ::-1], axis=1))
        suffix = np.minimum(suffix - (width - short), short)
        return replaced | ((long == short + 1) & (prefix + suffix >= short))


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each letter: the letters dealt by falling use to the group used least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += Words(batch.column(0)).counts.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"letter": np.arange(LETTERS, dtype=np.int32), "n": total})

    used = words.select("code").mapInArrow(run, "letter int, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    table = used.toArrow().sort_by("letter")
    groups, load = np.zeros(LETTERS, np.int64), np.zeros(GROUPS, np.int64)
    uses = np.zeros(LETTERS, np.int64)
    uses[np.asarray(table.column("letter"))] = np.asarray(table.column("n"))
    for letter in np.argsort(-uses, kind="stable"):
        groups[letter] = np.argmin(load)
        load[groups[letter]] += uses[letter] + 1
    return groups


#: Groups a family leaves out: two for words of one length, one for adjacent lengths.
SAME_LENGTH = list(combinations(range(GROUPS), 2))
FAMILIES = [*SAME_LENGTH, *((g,) for g in range(GROUPS))]


def first_families() -> np.ndarray:
    """The first family in which a pair meets, by difference of lengths and bit mask of the groups that differ; else -1."""
    out = np.full((2, 1 << GROUPS), -1)
    for number, left_out in reversed(list(enumerate(FAMILIES))):
        hidden = sum(1 << g for g in left_out)
        masks = [mask for mask in range(1, 1 << GROUPS) if mask & ~hidden == 0]
        out[0 if len(left_out) == 2 else 1, masks] = number
    return out


FIRST_FAMILY = first_families()


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_keys(words: Words, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every block each word is in; a key's remainder by 16 is its family."""
    weights = mixed(np.arange(1, LETTERS + 1, dtype=np.uint64))
    sums = np.zeros((GROUPS, len(words.lengths)), np.uint64)
    for g in range(GROUPS):
        own = groups == g
        sums[g] = mixed((words.counts[:, own].astype(np.uint64) * weights[own]).sum(axis=1, dtype=np.uint64) + np.uint64(g))
    rows, keys = [], []
    everyone = np.arange(len(words.lengths))
    for family, left_out in enumerate(FAMILIES):
        kept = sums[[g for g in range(GROUPS) if g not in left_out]].sum(axis=0, dtype=np.uint64)
        # Adjacent lengths meet under the shorter one: a word is in one block as the shorter, in one as the longer.
        for length in (words.lengths,) if len(left_out) == 2 else (words.lengths, words.lengths - 1):
            h = mixed(kept ^ mixed(length.astype(np.uint64) * np.uint64(64) + np.uint64(family)))
            keys.append((h & ~np.uint64(15)) | np.uint64(family))
            rows.append(everyone)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def near_pairs(words: Words, block: np.ndarray, family: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): near pairs of one block, each in its first family; j is no shorter."""
    used = np.flatnonzero(words.counts.any(axis=0))
    counts = words.counts[:, used].astype(np.float32 if words.lengths.max(initial=0) < 2048 else np.float64)
    norms = np.einsum("ij,ij->i", counts, counts)
    # -(squared distance) of all pairs in one product, the norms as two more columns.
    left = np.column_stack([2 * counts, -norms, np.ones_like(norms)])
    right = np.column_stack([counts, np.ones_like(norms), -norms])
    product = left @ right.T
    # Equal counts are never one edit apart.
    i, j = np.divmod(np.flatnonzero((product >= -2) & (product < 0)), len(product))
    gap = words.lengths[j] - words.lengths[i]
    fits = (gap == (family[i] >= len(SAME_LENGTH))) & ((gap > 0) | (i < j)) & (block[i] == block[j])
    i, j, gap = i[fits], j[fits], gap[fits]
    # Which groups differ tells the first family in which the pair meets.
    of_group = (groups[used][:, None] == np.arange(GROUPS)).astype(np.float32)
    touched = ((counts[i] != counts[j]).astype(np.float32) @ of_group > 0) @ (1 << np.arange(GROUPS))
    own = FIRST_FAMILY[gap, touched] == family[i]
    i, j = i[own], j[own]
    real = words.edited_once(i, j)
    return i[real], j[real]


NEAR = "code binary, n_near bigint, n bigint, form binary"


def cell_rows(
    codes: pa.Array, column: dict[str, np.ndarray], cell: np.ndarray, groups: np.ndarray
) -> pa.RecordBatch | None:
    """What some whole cells hand on: each word's near words there, and the best of them."""
    n, own, lo, hi = (column[c] for c in ("n", "own", "lo", "hi"))
    i, j = near_pairs(Words(codes), cell, column["key"] & 15, groups)
    # A cell of two tiles leaves out pairs within one of them; those meet in the tile's own cell.
    across = (lo[i] == hi[i]) | (own[i] != own[j])
    i, j = i[across], j[across]
    word, other = np.concatenate([i, j]), np.concatenate([j, i])
    if len(word) == 0:
        return None
    # Ties of n go to the smaller word: the place in sorted order stands for the word.
    place = np.empty(len(codes), np.int64)
    place[np.asarray(pc.sort_indices(codes))] = np.arange(len(codes))
    order = np.lexsort((place[other], -n[other], word))
    word, other = word[order], other[order]
    some, at, many = np.unique(word, return_index=True, return_counts=True)
    best = other[at]
    return pa.RecordBatch.from_arrays(
        [codes.take(pa.array(some)), pa.array(many.astype(np.int64)), pa.array(n[best]), codes.take(pa.array(best))],
        names=["code", "n_near", "n", "form"],
    )


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(code, n_near, best struct<n, form>) of the words of ``words`` (code, n) that have a near one."""
    spark = words.sparkSession
    groups = letter_groups(words)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.slice(first, 4096)
                row, key = block_keys(Words(part.column(0)), groups)
                copied = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*copied.columns, pa.array(key)], names=["code", "n", "key"])

    spread = words.select("code", "n").mapInArrow(blocks, "code binary, n bigint, key bigint")
    # Large blocks, of which there are at most rows / tile, are dealt into tiles.
    room = F.greatest(F.lit(2), F.least(F.lit(tile), F.lit(TILE_BYTES) / F.max(F.length("code")))).cast("int")
    sizes = spread.select("key", "code").groupBy("key").agg(F.count("*").alias("rows"), room.alias("room"))
    big = sizes.filter("rows > room").select("key", F.ceil(F.col("rows") / F.col("room")).cast("int").alias("tiles"))
    big = materialise(big, "big_blocks")
    if big.count() * BIG_BYTES <= broadcast_limit(spark):
        big = F.broadcast(big)
    dealt = spread.join(big, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("code"), F.col("tiles")).cast("int"))
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = dealt.withColumn("other", F.explode(others))
    met = met.select("key", "code", "n", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = 0

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole cells of what is held, about ``tile`` rows at a time; the last cell may go on."""
            nonlocal held, kept
            table = pa.Table.from_batches(held).combine_chunks()
            begins = np.zeros(len(table), bool)
            for name in cell:
                begins[1:] |= np.diff(np.asarray(table.column(name))) != 0
            numbers = np.cumsum(begins)
            edges = np.append(np.flatnonzero(begins), len(table))
            end = int(edges[-1] if last else edges[-2] if len(edges) > 1 else 0)
            edges = edges[edges <= end]
            first = 0
            while first < end:
                stop = int(edges[max(np.searchsorted(edges, first + tile, "right") - 1, np.searchsorted(edges, first, "right"))])
                part = table.slice(first, stop - first)
                column = {c: np.asarray(part.column(c)) for c in ("n", "key", "own", "lo", "hi")}
                made = cell_rows(part.column("code").combine_chunks(), column, numbers[first:stop], groups)
                if made is not None:
                    yield made
                first = stop
            rest = table.slice(end)
            held, kept = rest.to_batches(), len(rest)

        for batch in batches:
            if len(batch):
                held.append(batch)
                kept += len(batch)
                if kept >= 8 * tile:
                    yield from closed(False)
        if held:
            yield from closed(True)

    cell = ["key", "lo", "hi"]
    found = met.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("form")))
    return found.groupBy("code").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(code, root) of (code, form): the end of each chain of forms, found by doubling the step.

    A form is at least twice as frequent as its word, so chains are short and end.
    """
    steps = materialise(forms.select("code", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("code").alias("_at"), F.col("root").alias("_next"))
        moved = steps.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = materialise(moved.select("code", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if moved.filter("_moved").isEmpty():
            return moved.select("code", "root")
        steps = moved.select("code", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialise(count_words(docs, key, text), "words")
    near = near_words(words, tile)
    is_form = -F.col("best.n") >= RATIO * F.col("n")
    rows = words.join(near, "code", "left").select(
        "code",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    rows = materialise(rows, "variants")
    out = rows.join(roots(rows.filter("form IS NOT NULL")), "code", "left")
    as_text = lambda c: F.decode(c, "ISO-8859-1")
    return out.select(
        as_text(F.col("code")).alias("word"),
        as_text(F.col("form")).alias("form"),
        as_text(F.coalesce("root", "code")).alias("root"),
        "n",
        "n_near",
        "form_n",
    )
