"""N-gram Jaccard join: grouped prefix join on word shingles.

A document is the set of its distinct shingles of ``WIDTH`` words; one with fewer
words is its whole word sequence as a single element, one without words is empty
and links with nothing.  Two documents link if 100 * |common| >= percent * |union|.

All sets are put in one global order, rare shingles first.  Sets that link then
share a shingle among their first few, the prefix.  Documents with the same size
and prefix form a group, and only groups are joined: their pairs are filtered by
size and by the places of the common shingle.  What is left is expanded to the
members, whose whole sets are compared.

What is wanted are the classes of linked documents, so links inside a class
already found need no second proof.  A first round pairs each shingle's groups
with one of them, the one that holds it in the foremost place; a second round
takes every remaining pair whose members are not yet in one class.  Thousands of
near copies thus cost about as many comparisons as there are copies, and no link
between different classes is lost.

In the second round a group meets only groups of a size that its place of the
shingle still allows.  Documents that share a passage too short to link them hold
its shingles too far back for any partner of their size, so they never meet.

Only the order uses estimates: the most frequent shingles are found by bounded
counts per task.  Any order gives the same result; this one keeps common passages
out of the prefixes.  Shingles are told apart by 64-bit hashes, sets by 128 bits.

Rows of one id are one document whose rows are linked; rows without id link with
nothing and have a NULL component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import connected
from nearfield.llm.text import in_small_batches, mixed, words
from nearfield.session import broadcast_limit, materialise

WIDTH = 5
PERCENT = 75
FREQUENT = 1 << 16  # shingles whose frequency the order knows
FREQUENT_IN_TASK = 1 << 14
_COUNTED = 1 << 20
KEPT_GROUPS = 1 << 18
ID_BYTES = 16
SIZE_STEPS = 4  # classes of size between a set and the largest that it can link with


class Order(NamedTuple):
    """Frequent shingles by hash, with their rank by frequency; all others have rank 0."""

    tokens: np.ndarray
    ranks: np.ndarray

    def rank(self, h: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return np.where(self.tokens[at] == h, self.ranks[at], 0)


class Sets(NamedTuple):
    """Shingle sets of some consecutive rows: row ``i`` has ``tokens[ends[i] - size[i] : ends[i]]``."""

    first: int
    size: np.ndarray
    ends: np.ndarray
    tokens: np.ndarray


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle; of the whole sequence where words are too few."""
    n = max(0, len(hashes) - width + 1)
    full = row[:n] == row[width - 1 :] if n else np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n] if n else h
    h, at = mixed(h[full]), row[:n][full]
    count = np.bincount(row, minlength=rows)
    for i in np.flatnonzero((count > 0) & (count < width)):
        own = hashes[np.searchsorted(row, i, "left") : np.searchsorted(row, i, "right")]
        h = np.append(h, np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))))
        at = np.append(at, i)
    return h, at


def sets(column: pa.Array, order: Order, width: int = WIDTH) -> Iterator[Sets]:
    """Distinct shingles of each row in the global order."""
    for part in words(column):
        h, row = shingles(part.hashes, part.row, part.rows, width)
        at = np.lexsort((h, order.rank(h), row))
        h, row = h[at], row[at]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        size = np.bincount(row, minlength=part.rows)
        yield Sets(part.first, size, np.cumsum(size), h)


def frequent(docs: DataFrame, width: int = WIDTH) -> Order:
    """The order: frequent shingles, from counts of all rows that are cut to a bounded table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, weight, waiting, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def settle():
            nonlocal held, weight, waiting, count
            new, n = np.unique(np.concatenate([held, *waiting]), return_counts=True)
            n[np.searchsorted(new, held)] += weight - 1
            keep = np.flatnonzero(n > 1)
            keep = keep[np.argsort(-n[keep], kind="stable")[:FREQUENT_IN_TASK]]
            keep.sort()
            held, weight, waiting, count = new[keep], n[keep], [], 0

        for batch in batches:
            for part in sets(batch.column(0), none, width):
                waiting.append(part.tokens)
                count += len(part.tokens)
                if count >= _COUNTED:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(weight)], names=["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token bigint, n bigint")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = np.asarray(top.column("token")).view(np.uint64), np.asarray(top.column("n"))
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((tokens, n))] = np.arange(1, len(n) + 1)
    at = np.argsort(tokens)
    return Order(tokens[at], ranks[at])


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def parity_bits(tokens: np.ndarray) -> bytes:
    """Per bit the parity of the shingles hashed to it; about two bits per shingle.

    Sets whose bits differ in ``d`` places differ in ``d`` shingles or more.
    """
    many = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer bits are folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(docs: DataFrame, order: Order, percent: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, sig, grp, bits, prefix) per row; a task gives each group's prefix once."""
    shipped = docs.sparkSession.sparkContext.broadcast(order)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shipped.value, set()
        for batch in batches:
            size, sig, grp, bits, lengths, flat = [], [], [], [], [0], []
            for part in sets(batch.column(1), known, width):
                for n, end, p in zip(part.size.tolist(), part.ends.tolist(), prefix_length(part.size, percent).tolist(), strict=True):
                    size.append(n)
                    if n == 0:
                        sig.append(None), grp.append(None), bits.append(None), lengths.append(0)
                        continue
                    own = part.tokens[end - n : end]
                    head = own[:p]
                    group = xxhash.xxh3_128_digest(head.tobytes(), seed=n)
                    sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                    grp.append(group)
                    bits.append(parity_bits(own))
                    if group in seen:
                        lengths.append(0)
                        continue
                    if len(seen) >= KEPT_GROUPS:
                        seen.clear()
                    seen.add(group)
                    lengths.append(p)
                    flat.append(head)
            tokens = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in (sig, grp, bits)), prefix],
                names=["doc_id", "n", "sig", "grp", "bits", "prefix"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, sig binary, grp binary, bits binary, prefix array<bigint>")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes ``a.n`` and ``b.n`` whose first common element stands at ``pos`` can link."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))
    common = F.least(n1 - F.col(f"{a}.pos"), n2 - F.col(f"{b}.pos"))
    return sizes & ((100 + percent) * common >= percent * (n1 + n2))


def size_class(n: Column, percent: int) -> Column:
    """Number of a geometric class of set sizes."""
    step = max(math.log(100 / percent) / SIZE_STEPS, 0.01)
    return F.floor(F.log(n.cast("double")) / F.lit(step))


def meetings(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x``, ``y`` of postings of a token in which ``y`` is no smaller and within the sizes that ``x`` allows.

    With ``n - pos`` shingles left, ``x`` has at most so many in common with ``y``,
    which bounds the size of ``y``; where the bound lies below its own size, ``x``
    meets nothing larger.
    """
    n, left = F.col("n"), F.col("n") - F.col("pos")
    most = F.least(F.floor(100 * n / percent), F.floor((100 + percent) * left / percent) - n)
    small = postings.withColumn("most", most).filter("most >= n")
    small = small.withColumn("class", F.explode(F.sequence(size_class(n, percent), size_class(F.col("most"), percent))))
    large = postings.withColumn("class", size_class(n, percent))
    larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.grp") < F.col("y.grp")))
    return small.alias("x").join(large.alias("y"), ["token", "class"]).filter(larger & (F.col("y.n") <= F.col("x.most")))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order: Order, percent: int, width: int) -> DataFrame:
    """(a, b) of the pairs (sa, sb) of set signatures that link, as documents.

    Pairs whose bits differ too much are settled first.  For the others the sets
    are made again from the texts.
    """
    spark = docs.sparkSession
    side = classes.select("sig", "n", "bits")
    near = pairs.join(side.withColumnsRenamed({"sig": "sa", "n": "na", "bits": "ba"}), "sa")
    near = near.join(side.withColumnsRenamed({"sig": "sb", "n": "nb", "bits": "bb"}), "sb")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            least = np.array([least_difference(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            # 2 |common| = na + nb - |difference|
            keep = (100 + percent) * (na + nb - least) >= 2 * percent * (na + nb)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["sa", "sb"]).filter(pa.array(keep))

    near = near.select("sa", "sb", "na", "nb", "ba", "bb").mapInArrow(possible, "sa binary, sb binary")
    pairs = materialise(near, "near")
    shipped = spark.sparkContext.broadcast(order)
    needed = pairs.select(F.col("sa").alias("sig")).unionByName(pairs.select(F.col("sb").alias("sig"))).distinct()
    reps = materialise(classes.join(needed, "sig").select("rep").distinct(), "asked")
    if reps.count() * ID_BYTES <= broadcast_limit(spark):
        reps = F.broadcast(reps)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for part in sets(batch.column(0), known, width):
                starts = (part.ends - part.size).tolist()
                full = [part.tokens[a:b] for a, b in zip(starts, part.ends.tolist(), strict=True) if b > a]
                sig = [xxhash.xxh3_128_digest(x.tobytes()) for x in full]
                sizes = np.cumsum([0, *map(len, full)])
                tokens = np.concatenate([np.zeros(0, np.uint64), *map(np.sort, full)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), lists], names=["sig", "tokens"])

    rows = docs.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select("text")
    made = rows.mapInArrow(make, "sig binary, tokens array<bigint>").dropDuplicates(["sig"])
    made = materialise(made, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats, cuts = [], []
            for i in (2, 3):
                column = batch.column(i)
                flats.append(np.asarray(column.flatten()).view(np.uint64))
                cuts.append(np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).tolist())
            linked = []
            for k in range(batch.num_rows):
                x, y = (flat[cut[k] : cut[k + 1]] for flat, cut in zip(flats, cuts, strict=True))
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs: one merge
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["sa", "sb"]).filter(pa.array(linked, pa.bool_()))

    if pairs.count() * 2 * ID_BYTES <= broadcast_limit(spark):
        left = made.withColumnsRenamed({"sig": "sb", "tokens": "tb"}).join(F.broadcast(pairs), "sb")
    else:
        left = pairs.join(made.withColumnsRenamed({"sig": "sb", "tokens": "tb"}), "sb")
    left = left.select("sa", "sb", "tb")
    both = left.join(made.withColumnsRenamed({"sig": "sa", "tokens": "ta"}), "sa").select("sa", "sb", "ta", "tb")
    links = both.mapInArrow(compare, "sa binary, sb binary")
    names = classes.select("sig", "rep")
    links = links.join(names.withColumnsRenamed({"sig": "sa", "rep": "a"}), "sa")
    return links.join(names.withColumnsRenamed({"sig": "sb", "rep": "b"}), "sb").select("a", "b")


def jaccard_join(
    docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = in_small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = frequent(docs, width)
    signed = materialise(signatures(docs, order, percent, width), "signatures")
    known = signed.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("grp", "n", "bits")))
    classes = materialise(classes, "classes")
    # Groups by shingle; a shingle of one group joins nothing.
    prefixes = signed.filter(F.size("prefix") > 0)
    group = F.xxhash64("grp")
    shared = prefixes.select(group.alias("g"), F.explode("prefix").alias("token")).groupBy("token")
    shared = shared.agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("token")
    held = prefixes.select("grp", "n", F.posexplode("prefix").alias("pos", "token")).join(shared, "token", "left_semi")
    held = materialise(held.select("token", "grp", "n", "pos").dropDuplicates(["token", "grp"]), "postings")

    # Round one: each group with the foremost group of a shingle, and members with their group's first.
    foremost = held.groupBy("token").agg(F.min(F.struct("pos", "grp", "n")).alias("c"))
    foremost = foremost.select("token", F.col("c.pos").alias("pos"), F.col("c.grp").alias("grp"), F.col("c.n").alias("n"))
    star = held.alias("x").join(foremost.alias("y"), "token").filter(may_link("x", "y", percent) & (F.col("x.grp") != F.col("y.grp")))
    star = star.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("c")).distinct()
    heads = classes.groupBy("grp").agg(F.min("sig").alias("head"), F.count("*").alias("members"))
    heads = materialise(heads, "groups")
    member = classes.select("grp", "sig")
    first = star.join(heads.select(F.col("grp").alias("c"), F.col("head").alias("sa")), "c")
    first = first.join(member.withColumnsRenamed({"grp": "g", "sig": "sb"}), "g").select("sa", "sb")
    inside = heads.filter("members > 1").select("grp", F.col("head").alias("sa")).join(member.withColumnRenamed("sig", "sb"), "grp")
    pairs = first.unionByName(inside.filter(F.col("sa") != F.col("sb")).select("sa", "sb"))
    pairs = materialise(pairs.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct(), "pairs")
    several = known.groupBy("doc_id").agg(F.min("sig").alias("s"), F.max("sig").alias("t")).filter("s < t").select("doc_id")
    same = known.select("doc_id", "sig").join(several, "doc_id").join(classes.select("sig", "rep"), "sig")
    same = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = verified(docs, pairs, classes, order, percent, width).unionByName(same)
    links = materialise(links, "links")
    found = materialise(connected(links), "found")

    # Round two: whatever may link across the classes found so far.
    placed = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "rep")), "placed")
    across = placed.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = held.join(across, "grp")
    mixed_ = open_.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("token")
    open_ = materialise(open_.join(mixed_, "token"), "open")
    apart = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    rest = meetings(open_, percent).filter(apart & may_link("x", "y", percent))
    rest = rest.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("c")).distinct()
    own = across.filter("lo < hi").select(F.col("grp").alias("g"), F.col("grp").alias("c"))
    of = placed.select("grp", "sig", "component")
    rest = rest.unionByName(own).join(of.withColumnsRenamed({"grp": "g", "sig": "sa", "component": "ca"}), "g")
    rest = rest.join(of.withColumnsRenamed({"grp": "c", "sig": "sb", "component": "cb"}), "c").filter("ca <> cb")
    rest = rest.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct()
    rest = materialise(rest, "rest")
    more = verified(docs, rest, classes, order, percent, width)
    final = connected(links.unionByName(more))
    result = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.select("sig", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "sig").join(result, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
