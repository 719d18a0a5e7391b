"""Centroid seeds by oversampling in a few rounds (k-means||).

Method of Bahmani and others, "Scalable k-means++" (VLDB 2012).  A round reads the
table once for the distance of every row to the centres so far, and takes each row
with a probability in proportion to that distance, so far more centres than asked
for are found in few rounds.  Each centre then weighs as many rows as are nearest to
it, and the weighted centres, whose number depends on the wanted lists alone, are
reduced to the lists on the driver.

Rows are drawn by a hash of id and round, so every engine and every run draws alike.
Rows of one id are drawn together and give one centre, the least of their drawn
vectors.  Rows without id or vector take no part.  Copies of a centre have no
distance left, so they are never drawn again, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.functions.vectors import hash_order
from nearfield.operators import ivf, metrics
from nearfield.operators.two_level import hash_share
from nearfield.session import broadcast_limit, materialise

ROUNDS = 5
OVERSAMPLE = 2.0  # centres drawn in a round, for each wanted list
REFINE = 10  # weighted steps over the centres
NO_DISTANCE = 1e-9


class Centres(NamedTuple):
    """Drawn rows: ``vectors[i]`` is of ``ids[i]``, found in ``rounds[i]``."""

    ids: np.ndarray
    rounds: np.ndarray
    vectors: np.ndarray


def _distances(rows: DataFrame, centres: np.ndarray, vec: str) -> DataFrame:
    """(vec_id, dist): cosine distance of every row to the nearest centre."""
    shipped = rows.sparkSession.sparkContext.broadcast(ivf.checked(rows.sparkSession, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(1))
            dist = np.zeros(len(x))
            if len(x):
                at = ivf.blockwise(x, held, metrics.Cosine, 1)[:, 0]
                dist = metrics.Cosine.exact(x, held, np.arange(len(x)), at)
            dist[dist < NO_DISTANCE] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dist)], names=["vec_id", "dist"])

    return rows.mapInArrow(run, "vec_id bigint, dist double")


def _vectors_of(rows: DataFrame, ids: DataFrame, vec: str, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) in the order of their draw; the number of ids is checked before."""
    spark, count = rows.sparkSession, ids.count()
    if not count:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    width = rows.select(F.size(vec)).first()[0]
    if count * width * 8 > broadcast_limit(spark):
        raise ValueError(f"{count} centres of {width} elements are too many for one model; use fewer lists")
    found = rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min(vec).alias("v"))
    table = found.withColumn("draw", hash_order(seed, "vec_id")).toArrow().sort_by([("draw", "ascending"), ("vec_id", "ascending")])
    return table.column("vec_id").to_numpy(), blocks.read_vectors(table.column("v"))[0]


def draw_centres(
    table: DataFrame, lists: int, vec: str = "f32", rounds: int = ROUNDS, oversample: float = OVERSAMPLE, seed: str = "parallel"
) -> Centres:
    """One row drawn by hash, then about ``oversample * lists`` rows in each round."""
    rows = table.select("vec_id", vec).na.drop()
    first = rows.select("vec_id").distinct().orderBy(hash_order(seed, "vec_id"), "vec_id").limit(1)
    ids, vectors = _vectors_of(rows, first, vec, seed)
    found = np.zeros(len(ids), np.int64)
    for turn in range(1, rounds + 1 if len(ids) else 1):
        left = materialise(_distances(rows, vectors, vec), "distances")
        whole = left.agg(F.sum("dist")).first()[0]
        if not whole:
            break
        chance = F.col("dist") / F.lit(whole) * F.lit(float(oversample * lists))
        drawn = left.filter(hash_share(f"{seed}{turn}", "vec_id") / F.lit(float(1 << 32)) < chance)
        fresh, x = _vectors_of(rows, drawn.select("vec_id").distinct(), vec, f"{seed}{turn}")
        new = ~np.isin(fresh, ids)
        if new.any():
            ids, vectors = np.append(ids, fresh[new]), np.vstack([vectors, x[new]])
            found = np.append(found, np.full(int(new.sum()), turn))
    return Centres(ids, found, vectors)


def weights(table: DataFrame, centres: Centres, vec: str = "f32") -> DataFrame:
    """(list_id, n): rows nearest to each centre that has any."""
    at = ivf.nearest_list(table.sparkSession, F.col(vec), centres.vectors)
    rows = table.filter(F.col(vec).isNotNull() & F.col("vec_id").isNotNull()).select(at.alias("list_id"))
    return rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def reduce_centres(vectors: np.ndarray, weight: np.ndarray, lists: int, steps: int = REFINE) -> np.ndarray:
    """Weighted spherical k-means of the centres: farthest weighted ones first, then ``steps`` refinements."""
    x = blocks.unit_rows(vectors)
    if len(x) <= lists:
        return x
    picked = [int(np.argmax(weight))]
    near = 1.0 - x @ x[picked[0]]
    while len(picked) < lists:
        gain = np.where(near > NO_DISTANCE, weight * near, -1.0)
        gain[picked] = -2.0
        picked.append(int(np.argmax(gain)))
        near = np.minimum(near, 1.0 - x @ x[picked[-1]])
    out = x[picked]
    for _ in range(steps):
        at = np.argmax(x @ out.T, axis=1)
        total = np.zeros_like(out)
        np.add.at(total, at, x * weight[:, None])
        fresh = blocks.unit_rows(total)
        out = np.where(np.isnan(fresh), out, fresh)
    return out


def parallel_centroids(
    table: DataFrame, lists: int, vec: str = "f32", rounds: int = ROUNDS, oversample: float = OVERSAMPLE, seed: str = "parallel"
) -> np.ndarray:
    """``lists`` centroids, fewer where the table has fewer different rows to draw."""
    centres = draw_centres(table, lists, vec, rounds, oversample, seed)
    if not len(centres.ids):
        return centres.vectors
    counted = weights(table, centres, vec).toArrow()
    weight = np.zeros(len(centres.ids))
    weight[counted.column("list_id").to_numpy()] = counted.column("n").to_numpy()
    return ivf.checked(table.sparkSession, reduce_centres(centres.vectors, weight, lists))
