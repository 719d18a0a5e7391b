"""From raw vectors to every stored representation, in one narrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.functions.codes import Thresholds, code_rows
from nearfield.functions.vectors import prepared
from nearfield.operators.quantiles import dim_moments, exact_percentiles
from nearfield.operators.sketched import exact_percentiles_sketched
from nearfield.session import broadcast_limit

EIGHTHS = [i / 8 for i in range(1, 8)]
FLOAT_COLUMNS = ("f32", "f16")
# Of the seven eighths, the three that are quarters.
QUARTERS = [1, 3, 5]


def prepare(corpus: DataFrame, dim: int, full_dim: int, vec: str = "embedding") -> DataFrame:
    """(vec_id, v): widened, normalised, prefix-sliced, normalised, in double.

    Rows without a direction (NULL, zero, unsound) have no ``v`` and drop out.
    """
    return corpus.select("vec_id", prepared(vec, full_dim, dim).alias("v")).filter(F.col("v").isNotNull())


def fit_thresholds(
    corpus: DataFrame,
    full_dim: int,
    dim: int | None = None,
    mode: str = "full",
    vec: str = "embedding",
    sketched: bool = False,
) -> Thresholds:
    """Means and percentile cut points of every dimension; ``sketched`` finds the same in fewer reads.

    ``full`` learns on the full-width vectors, ``slice`` on the renormalised
    ``dim`` prefix the codes are taken from.
    """
    if mode not in ("full", "slice"):
        raise ValueError(f"unknown threshold mode: {mode}")
    width = full_dim if mode == "full" else (dim or full_dim)
    vectors = prepare(corpus, width, full_dim, vec)
    means, cuts = exact_percentiles_sketched(vectors, EIGHTHS, width=width) if sketched else exact_percentiles(vectors, EIGHTHS)
    return Thresholds(means, cuts[:, QUARTERS], cuts, mode)


def fit_thresholds_approx(
    corpus: DataFrame, full_dim: int, accuracy: int = 10000, vec: str = "embedding"
) -> Thresholds:
    """The same from sketches; the result says it is not exact."""
    vectors = prepare(corpus, full_dim, full_dim, vec)
    table = (
        vectors.select(F.posexplode("v").alias("d", "x"))
        .groupBy("d")
        .agg(F.avg("x").alias("mean"), F.percentile_approx("x", EIGHTHS, accuracy).alias("cuts"))
        .toArrow()
        .sort_by("d")
    )
    cuts = blocks.read_vectors(table.column("cuts"))[0]
    return Thresholds(table.column("mean").to_numpy(), cuts[:, QUARTERS], cuts, "full", exact=False)


def fit_means(corpus: DataFrame, full_dim: int, vec: str = "embedding") -> Thresholds:
    """Means alone, for mean codes."""
    table = dim_moments(prepare(corpus, full_dim, full_dim, vec)).toArrow().sort_by("d")
    means = table.column("mean").to_numpy()
    return Thresholds(means, np.empty((len(means), 0)), np.empty((len(means), 0)), "full")


def thresholds_table(spark, thresholds: Thresholds) -> DataFrame:
    """Thresholds as a small table (d, mean, t4, t8) to store beside codes."""
    rows = [
        (d, float(m), thresholds.t4[d].tolist(), thresholds.t8[d].tolist())
        for d, m in enumerate(thresholds.mean)
    ]
    return spark.createDataFrame(rows, "d int, mean double, t4 array<double>, t8 array<double>")


def represent(
    corpus: DataFrame,
    dim: int,
    full_dim: int,
    columns: tuple[str, ...],
    thresholds: Thresholds | None = None,
    vec: str = "embedding",
    keep: tuple[str, ...] = ("vec_id",),
) -> DataFrame:
    """``keep`` plus the wanted representations of every sound vector.

    ``columns`` name f32, f16 and code_<variant>.  All come from one pass over
    one normalised matrix per batch; nothing is shuffled.
    """
    unknown = [c for c in columns if c not in FLOAT_COLUMNS and not c.startswith("code_")]
    if unknown:
        raise ValueError(f"unknown representation: {', '.join(unknown)}")
    if thresholds is not None and sum(t.nbytes for t in thresholds[:3]) > broadcast_limit(corpus.sparkSession):
        raise ValueError("thresholds exceed the broadcast limit")
    shipped = corpus.sparkSession.sparkContext.broadcast(thresholds)

    def column(matrix: np.ndarray, everyone: np.ndarray, name: str) -> pa.Array:
        if name == "f32":
            return blocks.write_vectors(matrix.astype(np.float32), everyone, pa.float32())
        if name == "f16":
            return blocks.write_vectors(blocks.half_rows(matrix), everyone, pa.float32())
        words = code_rows(matrix, name.removeprefix("code_"), shipped.value)
        return blocks.write_vectors(words, everyone, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, valid = blocks.read_vectors(batch.column(len(keep)))
            if len(raw) == 0:
                continue
            matrix = blocks.prepared_rows(raw, full_dim, dim)
            sound = ~np.isnan(matrix).any(axis=1)
            rows = pa.array(np.flatnonzero(valid)[sound])
            matrix, everyone = matrix[sound], np.ones(int(sound.sum()), bool)
            kept = [batch.column(i).take(rows) for i in range(len(keep))]
            made = [column(matrix, everyone, name) for name in columns]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *columns])

    types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = [f"`{c}` {types[c]}" for c in keep]
    schema += [f"`{c}` array<{'float' if c in FLOAT_COLUMNS else 'bigint'}>" for c in columns]
    return corpus.select(*keep, vec).mapInArrow(run, ", ".join(schema))


def as_queries(table: DataFrame, precision: str | None = "f32", variant: str | None = None) -> DataFrame:
    """Rows of a represented table as queries (qid, qv, qcode).

    A query is encoded by the encoder of the table it comes from.
    """
    picked = [F.col("vec_id").alias("qid")]
    if precision:
        picked.append(F.col(precision).alias("qv"))
    if variant:
        picked.append(F.col(f"code_{variant}").alias("qcode"))
    return table.select(*picked)
