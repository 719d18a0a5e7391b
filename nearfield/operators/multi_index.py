"""Exact Hamming search by equi-joins on pieces of the code.

A code is cut into m chunks.  If two codes differ in fewer than m * (t + 1) bits,
some chunk of theirs differs in t bits at most.  So the index is a table of (chunk,
value, code), and a search joins it with every query's chunks, then with all values
one bit away, and so on.  After step t all codes nearer than m * (t + 1) are known;
a query is done once they hold k rows.  Queries that are not done after the last
step, those without k near rows, are answered by counted radii over all rows.

The index holds each code once, with the number of its rows, so a code that a third
of the rows share is met once; its rows of smallest id are looked up at the end.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.operators.knn import QueryBlock, per_block
from nearfield.operators.radius import hamming_radius_knn
from nearfield.operators.topk import merge_salts, top_k
from nearfield.session import broadcast_limit, materialise, shuffle_partitions

MOST_FLIPPED = 2
WIDE_FROM = 1 << 12  # codes from which a chunk has 16 bits, not 8
PROBE_BYTES = 64
COPY_SALTS = 16


class MultiIndex(NamedTuple):
    """``postings``: chunk, value, code, held (rows of the code); ``rows``: vec_id, code."""

    postings: DataFrame
    rows: DataFrame
    bits: int
    chunks: int


def chunk_values(code: Column | str, bits: int, chunks: int) -> Column:
    """Values of the first ``chunks`` pieces of ``bits`` bits, as an array."""
    code, per_word = F.col(code) if isinstance(code, str) else code, 64 // bits
    mask = (1 << bits) - 1
    pieces = [F.shiftrightunsigned(code[i // per_word], bits * (i % per_word)).bitwiseAND(F.lit(mask)) for i in range(chunks)]
    return F.transform(F.array(*pieces), lambda x: x.cast("int"))


def build(codes: DataFrame, variant: str, width: int, bits: int | None = None) -> MultiIndex:
    """The index of ``code_<variant>``, whose codes use ``width`` bits; rows without a code or an id take no part."""
    rows = codes.select("vec_id", F.col(f"code_{variant}").alias("code")).na.drop()
    held = materialise(rows.groupBy("code").agg(F.count("*").alias("held")), "codes")
    if bits is None:
        bits = 8 if held.count() < WIDE_FROM else 16
    if bits not in (4, 8, 16):
        raise ValueError(f"a chunk has 4, 8 or 16 bits, not {bits}")
    chunks = max(1, -(-width // bits))
    spread = held.select("code", "held", F.posexplode(chunk_values("code", bits, chunks)).alias("chunk", "value"))
    # In order, so that a chunk's rows lie together and a scan skips the others.
    spread = spread.repartitionByRange(shuffle_partitions(codes.sparkSession), "chunk", "value")
    postings = materialise(spread.sortWithinPartitions("chunk", "value"), "chunks")
    return MultiIndex(postings, rows, bits, chunks)


def flips(bits: int, t: int) -> list[int]:
    """All masks of ``t`` bits."""
    return [sum(1 << i for i in chosen) for chosen in combinations(range(bits), t)]


def differing(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))


def probe(asked: DataFrame, index: MultiIndex, t: int, queries: int, words: int) -> DataFrame:
    """(qid, code, held, dist) of the codes that hold a chunk exactly ``t`` bits off the query's; a code may come several times."""
    masks = flips(index.bits, t)
    pieces = asked.select("qid", "qcode", F.posexplode(chunk_values("qcode", index.bits, index.chunks)).alias("chunk", "own"))
    probes = pieces.withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    probes = probes.select("qid", "qcode", "chunk", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    if queries * index.chunks * len(masks) * (PROBE_BYTES + 8 * words) <= broadcast_limit(asked.sparkSession):
        probes = F.broadcast(probes)
    met = index.postings.join(probes, ["chunk", "value"])
    return met.select("qid", "code", "held", differing("code", "qcode", words).alias("dist"))


def nearest_codes(block: QueryBlock, index: MultiIndex, k: int, most: int) -> tuple[DataFrame | None, set[int]]:
    """(qid, code, dist, held) of the queries that are done, and these queries."""
    spark, words = index.rows.sparkSession, block.codes.shape[1]
    wanted = blocks.write_vectors(block.codes, np.ones(len(block.ids), bool), pa.int64())
    table = pa.table({"qid": block.ids, "qcode": wanted})
    asked = spark.createDataFrame(table)
    found, done = None, set()
    for t in range(min(most, index.bits) + 1):
        waiting = [int(q) for q in block.ids if int(q) not in done]
        if not waiting:
            break
        still = spark.createDataFrame(pa.table({"qid": pa.array(waiting, pa.int64())}))
        new = probe(asked.join(F.broadcast(still), "qid", "left_semi"), index, t, len(waiting), words)
        known = new if found is None else found.join(F.broadcast(still), "qid", "left_semi").unionByName(new)
        known = known.groupBy("qid", "code").agg(F.first("held").alias("held"), F.first("dist").alias("dist"))
        certain = known if found is None else known.unionByName(found.join(F.broadcast(still), "qid", "left_anti"))
        found = materialise(certain, "met")
        sure = found.filter(F.col("dist") < index.chunks * (t + 1)).groupBy("qid").agg(F.sum("held").alias("n"))
        # One id a query of the block at most.
        done |= {r.qid for r in sure.filter(F.col("n") >= k).select("qid").collect()}
    if not done:
        return None, done
    kept = spark.createDataFrame(pa.table({"qid": pa.array(sorted(done), pa.int64())}))
    return found.join(F.broadcast(kept), "qid", "left_semi"), done


def wanted_codes(found: DataFrame, k: int) -> DataFrame:
    """Codes up to the distance at which a query has its k rows."""
    at = found.groupBy("qid", "dist").agg(F.sum("held").alias("n"))  # a row for each distance, so few
    nearer = at.alias("a").join(at.alias("b"), (F.col("a.qid") == F.col("b.qid")) & (F.col("b.dist") < F.col("a.dist")), "left")
    nearer = nearer.groupBy(F.col("a.qid").alias("qid"), F.col("a.dist").alias("dist"))
    within = nearer.agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before")).filter(F.col("before") < k)
    return found.join(within.select("qid", "dist"), ["qid", "dist"]).select("qid", "code", "dist")


def hamming_mih_knn(queries: DataFrame, index: MultiIndex, k: int, most: int = MOST_FLIPPED) -> DataFrame:
    """The k rows whose code differs least: (qid, rk, vec_id, dist), as ``hamming_knn`` finds them."""
    rows = index.rows

    def answer(block: QueryBlock) -> DataFrame:
        rest = [int(q) for q in block.ids]
        best = None
        if rest:
            found, done = nearest_codes(block, index, k, most)
            rest = [q for q in rest if q not in done]
            if done:
                wanted = materialise(wanted_codes(found, k), "wanted")
                codes = wanted.select("code").distinct()
                # Of each code the k rows of smallest id; a code of a crowd is cut down in slices first.
                members = rows.join(codes, "code", "left_semi").withColumn("_slice", F.pmod(F.xxhash64("vec_id"), F.lit(COPY_SALTS)))
                members = top_k(members, k, key=("code", "_slice"), order=("vec_id",)).select("code", "vec_id")
                members = top_k(members, k, key="code", order=("vec_id",)).select("code", "vec_id")
                hits = wanted.join(members, "code").select("qid", "vec_id", "dist")
                best = top_k(hits, k, salts=merge_salts(hits, len(done)))
                best = best.select("qid", "rk", "vec_id", F.col("dist").cast("int").alias("dist"))
        if best is not None and not rest:
            return best
        spark = rows.sparkSession
        left = spark.createDataFrame([(q,) for q in rest], "qid bigint")
        others = hamming_radius_knn(queries.join(F.broadcast(left), "qid", "left_semi"), rows.withColumnRenamed("code", "code_mih"), k, "mih")
        return others if best is None else best.unionByName(others)

    return per_block(queries.select("qid", "qcode"), answer)
