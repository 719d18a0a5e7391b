"""Stored tables of representations, their metadata and their sizes."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.codes import Thresholds
from nearfield.operators.prep import represent, thresholds_table
from nearfield.session import scratch_path

# An encoding's code columns, and the bytes of one stored element.
ENCODINGS = {
    "thermometer": ("code_thermo4", "code_thermo8"),
    "onehot": ("code_onehot4", "code_onehot8"),
}
PRECISIONS = {"vector": "f32", "halfvec": "f16"}
ELEMENT_BYTES = {"f32": 4, "f16": 2}
WORD_BYTES = 8

KEY_COLUMNS = ("data_source", "num_vectors", "dimension", "encoder", "threshold_mode", "fingerprint")
# The metadata columns, then the location of the rows.
METADATA = (
    "table_name string, data_source string, num_vectors bigint, dimension int, encoder string, "
    "threshold_mode string, fingerprint string, location string, created_at timestamp"
)


def unified_table(
    corpus: DataFrame, dim: int, full_dim: int, thresholds: Thresholds, encoding: str = "thermometer", **options
) -> DataFrame:
    """One wide row per vector: f32, f16 and every binary code."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")
    columns = ("f32", "f16", "code_sign", "code_mean", *ENCODINGS[encoding])
    return represent(corpus, dim, full_dim, columns, thresholds, **options)


def single_precision_table(unified: DataFrame, precision: str) -> DataFrame:
    """(vec_id, embedding, codes) of one precision: ``vector`` or ``halfvec``."""
    if precision not in PRECISIONS:
        raise ValueError(f"unknown precision: {precision}")
    codes = [c for c in unified.columns if c.startswith("code_")]
    return unified.select("vec_id", F.col(PRECISIONS[precision]).alias("embedding"), *codes)


def fingerprint(corpus: DataFrame, vec: str = "embedding") -> str:
    """Content hash of (vec_id, vector) rows, whatever their order."""
    row = corpus.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64(vec_id, {vec}))").alias("bits")
    ).first()
    return f"{row.n}-{(row.bits or 0) & (2**64 - 1):016x}"


def metadata_upsert(old: DataFrame, new: DataFrame, key: str = "table_name") -> DataFrame:
    """``new`` replaces the rows of ``old`` that share its key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def cache_check(
    metadata: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = KEY_COLUMNS
) -> DataFrame:
    """(table_name, cached): does a stored table match what is wanted?

    A wanted table without a data source is never taken from the cache.
    """
    stored = metadata.select("table_name", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    same = F.coalesce("_known", F.lit(False)) & F.col("data_source").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return wanted.join(stored, "table_name", "left").select("table_name", same.alias("cached"))


def table_check(table: DataFrame, expected_rows: int, columns: tuple[str, ...]) -> DataFrame:
    """One row per required column: is it there, and is the table complete?"""
    wanted = table.sparkSession.createDataFrame(
        [(c, c in table.columns) for c in columns], "column_name string, present boolean"
    )
    counted = table.agg(F.count(F.lit(1)).alias("num_rows")).first().num_rows
    return wanted.select(
        "column_name",
        "present",
        F.lit(counted).cast("bigint").alias("num_rows"),
        (F.col("present") & F.lit(counted == expected_rows)).alias("usable"),
    )


def index_size(table: DataFrame) -> DataFrame:
    """(representation, num_rows, bytes): logical bytes of every vector column."""
    held = [c for c in table.columns if c in ELEMENT_BYTES or c.startswith("code_")]
    sums = [
        F.coalesce(F.sum(F.size(c) * F.lit(ELEMENT_BYTES.get(c, WORD_BYTES))), F.lit(0)).cast("bigint").alias(c)
        for c in held
    ]
    totals = table.agg(F.count(F.lit(1)).alias("num_rows"), *sums)
    return totals.unpivot("num_rows", held, "representation", "bytes").select("representation", "num_rows", "bytes")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


class TableCatalog:
    """Unified tables below one root, rebuilt only when their key changes.

    Metadata is an append-only log, of which the last row per table counts, so a
    rebuild neither overwrites files a running query reads nor needs a merge.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_path(spark, "tables")
        self.log = f"{self.root}/metadata"

    def metadata(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(METADATA).parquet(self.log)
        except AnalysisException:
            return self.spark.createDataFrame([], METADATA)
        last = Window.partitionBy("table_name").orderBy(F.col("created_at").desc(), F.col("location"))
        return rows.withColumn("_at", F.row_number().over(last)).filter("_at = 1").drop("_at")

    def wanted(
        self, name: str, corpus: DataFrame, dim: int, full_dim: int, thresholds: Thresholds, encoding: str, data_source
    ):
        mark = fingerprint(corpus)
        rows = int(mark.split("-")[0])
        # Codes depend on the thresholds' values and on the width they were learned at.
        values = b"".join(np.asarray(part, np.float64).tobytes() for part in thresholds[:3])
        mark = f"{mark}-{full_dim}-{hashlib.sha256(values).hexdigest()[:16]}"
        mode = f"{thresholds.mode}{'' if thresholds.exact else '-approx'}"
        schema = METADATA.split(", location")[0]
        return self.spark.createDataFrame([(name, data_source, rows, dim, encoding, mode, mark)], schema)

    def build(
        self,
        name: str,
        corpus: DataFrame,
        dim: int,
        full_dim: int,
        thresholds: Thresholds,
        encoding: str = "thermometer",
        data_source: str | None = None,
        skip_if_exists: bool = True,
    ) -> bool:
        """Write table ``name``; False when a stored one already matches."""
        wanted = self.wanted(name, corpus, dim, full_dim, thresholds, encoding, data_source)
        if skip_if_exists and cache_check(self.metadata(), wanted).first().cached and self._stored(name):
            return False
        location = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
        unified_table(corpus, dim, full_dim, thresholds, encoding).write.parquet(f"{location}/rows")
        thresholds_table(self.spark, thresholds).write.parquet(f"{location}/thresholds")
        entry = wanted.withColumn("location", F.lit(location)).withColumn("created_at", F.current_timestamp())
        entry.write.mode("append").parquet(self.log)
        return True

    def _location(self, name: str) -> str:
        row = self.metadata().filter(F.col("table_name") == name).first()
        if row is None:
            raise ValueError(f"no table named {name}")
        return row.location

    def _stored(self, name: str) -> bool:
        """Whether the files the log names are still there."""
        try:
            self.table(name), self.thresholds(name)
        except AnalysisException:
            return False
        return True

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._location(name)}/rows")

    def thresholds(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._location(name)}/thresholds")

    def size_bytes(self, name: str) -> int:
        return stored_bytes(self.spark, f"{self._location(name)}/rows")
