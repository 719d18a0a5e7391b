"""Session helpers: size limits, lineage cuts and shared scratch paths."""

from __future__ import annotations

import gc
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from nearfield import settings


def broadcast_limit(spark: SparkSession) -> int:
    """Largest number of bytes an operator may ship to every executor."""
    return int(spark.conf.get(settings.BROADCAST_LIMIT_KEY, str(settings.BROADCAST_LIMIT_DEFAULT)))


def query_chunk_rows(spark: SparkSession) -> int:
    """Queries answered per pass over the corpus."""
    return int(spark.conf.get(settings.QUERY_CHUNK_KEY, str(settings.QUERY_CHUNK_DEFAULT)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="nearfield-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and read it back."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; derived tables never overwrite.

    All paths of an application share one folder, so they can be removed with it.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/nearfield/{application}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For tables that hold vectors: unlike a checkpoint, a later scan still reads
    only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs have left.

    Spark drops their broadcasts and shuffle files only when the driver has collected garbage,
    which a driver of many small jobs puts off until its heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def attach(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_nearfield_attached", False):
        root = pathlib.Path(__file__).resolve().parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="nearfield-")) / "nearfield.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for source in sorted(root.rglob("*.py")):
                packed.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._nearfield_attached = True
    return spark
