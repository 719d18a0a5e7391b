"""Reading, generating, numbering and sampling vectors."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import hash_order, l2_normalize
from nearfield.session import broadcast_limit, cut_lineage

# A partition's running row number is the low part of Spark's monotonic id.
ROW_BITS = 33
ID_BYTES = 64


def width_report(corpus: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: row count, NULL vectors, smallest and largest width, NULL elements."""
    size = F.when(F.col(vec).isNotNull(), F.size(vec))
    return corpus.agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.count_if(F.col(vec).isNull()).alias("null_vectors"),
        F.min(size).alias("min_width"),
        F.max(size).alias("max_width"),
        F.count_if(F.exists(vec, lambda x: x.isNull())).alias("with_null_element"),
    )


def load_vectors(spark: SparkSession, path: str, vec: str = "embedding") -> DataFrame:
    """Vectors of a Parquet table; rows of unequal width are an error."""
    corpus = spark.read.parquet(path)
    check_widths(corpus, vec)
    return corpus


def check_widths(corpus: DataFrame, vec: str = "embedding") -> DataFrame:
    row = width_report(corpus, vec).first()
    if row.num_vectors > row.null_vectors and (row.min_width != row.max_width or row.min_width == 0):
        raise ValueError(f"expected vectors of one width, got {row.min_width} to {row.max_width}")
    return corpus


def cap_rows(corpus: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """The ``n`` rows of smallest key; NULL keys come last, equal keys in the order of a row hash.

    Only keys and hashes are sorted and numbered; the last of them is the cut by
    which the table is then filtered, so no other column moves.  Of equal rows at
    the cut as many are kept as are missing.
    """
    row_hash = F.xxhash64(key, *(c for c in corpus.columns if c != key))
    keys = corpus.select(F.col(key).alias("_key"), row_hash.alias("_hash"))
    numbered = assign_ids(keys, F.col("_key").asc_nulls_last(), "_hash", name="_row")
    cut = numbered.filter(F.col("_row") == n - 1).first()
    if cut is None:
        return corpus if n > 0 else corpus.limit(0)
    last = F.lit(cut["_key"])
    at_cut = F.col(key).eqNullSafe(last)
    nearer = F.col(key).isNotNull() if cut["_key"] is None else F.coalesce(F.col(key) < last, F.lit(False))
    before = numbered.filter(F.col("_key").eqNullSafe(last) & (F.col("_hash") == cut["_hash"]))
    spare, equal = before.agg(n - F.min("_row"), F.count("*")).first()
    kept = corpus.filter(nearer | (at_cut & (row_hash < cut["_hash"])))
    tied = corpus.filter(at_cut & (row_hash == cut["_hash"]))
    if equal > spare:
        tied = assign_ids(tied, name="_row").filter(F.col("_row") < spare).drop("_row")
    return kept.unionByName(tied)


def gen_vectors(ids: DataFrame, dim: int, seed: str = "gauss", key: str = "vec_id") -> DataFrame:
    """A Gaussian unit vector for every id, the same on any partitioning.

    Two hashes of (seed, id, dimension) give the uniform pair of a Box-Muller
    draw, so nothing depends on task-local random state.
    """

    def uniform(d, part: int):
        text = F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), d.cast("string"))
        digits = F.conv(F.substring(F.md5(text), part, 8), 16, 10).cast("double")
        return (digits + F.lit(1.0)) / F.lit(4294967297.0)

    def draw(d):
        radius = F.sqrt(F.lit(-2.0) * F.log(uniform(d, 1)))
        return radius * F.cos(F.lit(2.0 * math.pi) * uniform(d, 9))

    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw)
    return ids.select(key, l2_normalize(raw).alias("embedding"))


def assign_ids(rows: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1, in ``order`` when given, ties of it in the order of a row hash.

    Counts per partition give each partition its first id; only those counts
    reach the driver.  The rows are pinned first, so that counting and numbering
    see the same partitions.
    """
    pinned = cut_lineage(rows.orderBy(*order, F.xxhash64(*rows.columns)) if order else rows)
    numbered = pinned.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", ROW_BITS)
    counts = numbered.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    start, offsets = 0, []
    for row in counts:
        offsets.append((row["_part"], start))
        start += row["count"]
    starts = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part bigint, _start bigint")
    within = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_start", "_mid")
    )


def hash_sample(rows: DataFrame, n: int, seed: str, key: str = "vec_id") -> DataFrame:
    """The rows of ``n`` seeded pseudo-random ids: those of smallest hash of (seed, key).

    Only ids are drawn and ordered; the rows are then read by a join on the id.
    Rows that share an id are drawn together, rows without one never.
    """
    ids = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    picked = ids.orderBy(hash_order(seed, key), key).limit(n)
    if n * ID_BYTES <= broadcast_limit(rows.sparkSession):
        picked = F.broadcast(picked)
    return rows.join(picked, key, "left_semi")


def gathered_sample(rows: DataFrame, n: int, seed: str, key: str = "vec_id") -> pa.Table:
    """The rows of ``hash_sample``, on the driver, for few rows: one ordered limit where their ids are unique."""
    ordered = rows.filter(F.col(key).isNotNull()).orderBy(hash_order(seed, key), key)
    # One row more tells whether the last id has a row beyond the limit.
    found = ordered.limit(n + 1).toArrow()
    if len(found) > n and len(pc.unique(found.column(key))) <= n:
        return hash_sample(rows, n, seed, key).toArrow()
    return found.slice(0, n) if len(found) > n else found


def hash_share(rows: DataFrame, target: int, seed: str, key: str = "vec_id") -> DataFrame:
    """About ``target`` rows picked by hash, every row when there are fewer."""
    total = rows.count()
    if total <= target:
        return rows
    return rows.filter(hash_order(seed, key) < f"{int(target / total * 16**8):08x}")
