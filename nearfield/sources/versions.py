"""Versions of a stored table, of which a build encodes only new or changed rows.

A row is known by its id and a hash of its vector.  A version is a manifest
(vec_id, mark, segment): which row lies in which segment.  Segments are Parquet
tables of encoded rows; a build compares the corpus with the last manifest on these
narrow columns, encodes the rows it lacks into one new segment, and writes the next
manifest.  Rows that are gone are left out of it.  Earlier versions stay readable
until they are dropped, which removes the segments that no kept version names.

Rows without an id take no part, repeated rows (equal id and vector) count once, and
an id with several vectors keeps a row for each.  Other thresholds, another width or
another encoding make every row a new one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.codes import Thresholds
from nearfield.session import scratch_path
from nearfield.sources.tables import unified_table

VERSIONS = "version int, encoder string, segment string, num_vectors bigint, encoded bigint, removed bigint"
MANIFEST = "vec_id bigint, mark bigint, segment string"


def encoder_key(dim: int, full_dim: int, thresholds: Thresholds, encoding: str) -> str:
    """Names everything that the stored form of a vector depends on."""
    values = b"".join(np.asarray(part, np.float64).tobytes() for part in thresholds[:3])
    return f"{dim}-{full_dim}-{encoding}-{hashlib.sha256(values).hexdigest()[:16]}"


class VersionedTable:
    """All versions of one table below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_path(spark, "versions")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """The versions that can be read, one row each."""
        return self._log("log", VERSIONS).join(self._log("dropped", "version int"), "version", "left_anti")

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}")

    def build(
        self,
        corpus: DataFrame,
        dim: int,
        full_dim: int,
        thresholds: Thresholds,
        encoding: str = "thermometer",
        vec: str = "embedding",
    ) -> int:
        """Make the next version from ``corpus``; returns its number."""
        encoder = encoder_key(dim, full_dim, thresholds, encoding)
        last = self._log("log", VERSIONS).orderBy(F.desc("version")).first()
        version, before = (last.version + 1 if last else 1), self.spark.createDataFrame([], MANIFEST)
        if last is not None and last.encoder == encoder and not self.versions().filter(F.col("version") == last.version).isEmpty():
            before = self.manifest(last.version)
        rows = corpus.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull())
        rows = rows.select("vec_id", vec, F.xxhash64("vec_id", vec).alias("mark"))
        known = ["vec_id", "mark"]
        segment = uuid.uuid4().hex
        fresh = rows.join(before.select(*known), known, "left_anti").dropDuplicates(known)
        made = unified_table(fresh, dim, full_dim, thresholds, encoding, vec=vec, keep=("vec_id", "mark"))
        made.withColumn("segment", F.lit(segment)).write.parquet(f"{self.root}/segments/{segment}")
        stored = self.spark.read.parquet(f"{self.root}/segments/{segment}").select(*known, "segment")
        held = before.join(rows.select(*known), known, "left_semi").unionByName(stored)
        held.select(*MANIFEST.replace(" bigint", "").replace(" string", "").split(", ")).write.parquet(f"{self.root}/manifests/{version}")
        total, encoded = self.manifest(version).count(), stored.count()
        removed = before.count() - (total - encoded)
        entry = [(version, encoder, segment, total, encoded, removed)]
        self.spark.createDataFrame(entry, VERSIONS).write.mode("append").parquet(f"{self.root}/log")
        return version

    def table(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default.

        A segment all of whose rows are in the manifest is read as it is; the
        others meet the manifest by a join.
        """
        if version is None:
            version = self.versions().agg(F.max("version")).first()[0]
        if version is None or self.versions().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"no version {version}")
        manifest = self.manifest(version)
        held = {row.segment: row.n for row in manifest.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        own = self._log("log", VERSIONS).filter(F.col("version") == version).first().segment
        stored = {row.segment: row.encoded for row in self._log("log", VERSIONS).collect()}
        whole = [s for s, n in held.items() if n == stored[s]]
        part = [s for s in held if s not in whole]
        paths = lambda names: [f"{self.root}/segments/{s}" for s in names]
        # A version's own segment has the columns even where it has no rows.
        out = self.spark.read.parquet(*paths(whole or [own]))
        if part:
            wanted = manifest.filter(F.col("segment").isin(part))
            some = self.spark.read.parquet(*paths(part)).join(wanted, ["vec_id", "mark", "segment"], "left_semi")
            out = out.unionByName(some) if whole else some
        return out.drop("mark", "segment")

    def segments(self) -> list[str]:
        """Segments that versions in use name."""
        named: set[str] = set()
        for row in self.versions().collect():
            named.update(r.segment for r in self.manifest(row.version).select("segment").distinct().collect())
            named.add(row.segment)
        return sorted(named)

    def drop_versions(self, keep: int = 1) -> list[int]:
        """Drop all but the last ``keep`` versions and the segments only these name; returns their numbers."""
        if keep < 1:
            raise ValueError("at least one version stays")
        known = sorted(row.version for row in self.versions().collect())
        gone = known[:-keep]
        if not gone:
            return []
        before = set(self.segments())
        rows = self.spark.createDataFrame([(v,) for v in gone], "version int")
        # Readers stop naming the versions before their files go.
        rows.write.mode("append").parquet(f"{self.root}/dropped")
        for segment in sorted(before - set(self.segments())):
            self._remove(f"{self.root}/segments/{segment}")
        for version in gone:
            self._remove(f"{self.root}/manifests/{version}")
        return gone

    def _remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
