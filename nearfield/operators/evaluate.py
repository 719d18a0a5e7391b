"""Recall against exact ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): share of a query's true neighbours that were retrieved.

    Sets on both sides: a row retrieved twice counts once, and a query without
    any result has recall 0.
    """
    pairs = truth.select("qid", "vec_id", F.lit(True).alias("wanted")).unionByName(
        result.select("qid", "vec_id", F.lit(False).alias("wanted")).na.drop()
    )
    # Both sides are bounded by k rows a query; they meet in the shuffle that makes them sets.
    once = pairs.groupBy("qid", "vec_id").agg(F.bool_or("wanted").alias("wanted"), F.bool_and("wanted").alias("missed"))
    hit = F.when(F.col("missed"), F.lit(0.0)).otherwise(F.lit(1.0))
    return once.filter("wanted").groupBy("qid").agg(F.avg(hit).alias("recall"))


def mean_recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    return recall_at_k(result, truth).agg(F.avg("recall").alias("recall"))
