"""Toxicity by a classifier chain.

The categories are predicted one after the other.  Each has a linear model over
hashed words, their beginnings and the probabilities of the categories before it.  Later
models are trained on out-of-fold probabilities, from models that never saw the
row, since at scoring time no row has been seen either.  A document is toxic if
its last probability reaches a threshold, chosen on out-of-fold predictions.

Only the fit uses a sample: at most ``rows`` labelled documents, the first by a
hash of their id, with one text of each, however many rows an id has.  Scoring reads every word of every row.  A NULL or empty text has
no words and gets the intercept alone; without labelled rows of both classes a
category's probability is its share in the sample and nothing is rejected for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import in_small_batches, words
from nearfield.session import materialise

FEATURES_LOG2 = 18
BEGINNINGS = (3, 4, 5)  # bytes of a word's start that are features too
TRAIN_ROWS = 8192
LEAST_DOCS = 4
FOLDS = 3
STEPS = 100
LEAST_Z = 5.0
RIDGE = 2e-4


def categories() -> list[tuple[str, Column]]:
    """Default chain: low quality first, toxic last."""
    return [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]


class Linear(NamedTuple):
    weights: np.ndarray  # per hashed word
    earlier: np.ndarray  # per earlier category
    bias: float


class Chain(NamedTuple):
    names: list[str]
    models: list[Linear]
    threshold: float


class Rows(NamedTuple):
    """Distinct hashed words and word beginnings of some rows, as (row, feature) pairs sorted by row."""

    row: np.ndarray
    feature: np.ndarray
    count: int


def features(column: pa.Array) -> Iterator[tuple[int, Rows]]:
    """(first row, rows) for runs of rows of a text column."""
    mask = np.uint64((1 << FEATURES_LOG2) - 1)
    for part in words(column, BEGINNINGS):
        taken = [(part.hashes, part.row), *part.starts]
        pair = np.concatenate([(r.astype(np.int64) << FEATURES_LOG2) | (h & mask).astype(np.int64) for h, r in taken])
        pair = np.unique(pair)
        yield part.first, Rows(pair >> FEATURES_LOG2, pair & int(mask), part.rows)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(model: Linear, rows: Rows, earlier: list[np.ndarray]) -> np.ndarray:
    z = np.bincount(rows.row, model.weights[rows.feature], rows.count) + model.bias
    for weight, p in zip(model.earlier, earlier, strict=True):
        z += weight * (p - 0.5)
    return _sigmoid(z)


def associated(row: np.ndarray, feature: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Features whose shares in the two classes differ by ``LEAST_Z`` standard errors or more."""
    many, yes = 1 << FEATURES_LOG2, max(1.0, float(y[used].sum()))
    no = max(1.0, float(used.sum()) - yes)
    total, hits = np.bincount(feature, minlength=many), np.bincount(feature, y[row], many)
    share = total / (yes + no)
    error = np.sqrt(share * (1 - share) * (1 / yes + 1 / no))
    return (total >= LEAST_DOCS) & (np.abs(hits / yes - (total - hits) / no) > LEAST_Z * error)


def fit_linear(rows: Rows, earlier: list[np.ndarray], y: np.ndarray, used: np.ndarray) -> Linear:
    """Logistic regression on the rows ``used``, full gradients with adaptive steps."""
    many = 1 << FEATURES_LOG2
    here = used[rows.row]
    row, feature = rows.row[here], rows.feature[here]
    kept = associated(row, feature, y, used)[feature]
    names, feature = np.unique(feature[kept], return_inverse=True)
    row, n = row[kept], max(1, int(used.sum()))
    share = float(y[used].mean()) if used.any() else 0.0
    if share in (0.0, 1.0):
        odds = -20.0 if share == 0.0 else 20.0
        return Linear(np.zeros(many), np.zeros(len(earlier)), odds)
    side = np.array([p - 0.5 for p in earlier]).reshape(len(earlier), rows.count)
    w = np.zeros(len(names) + len(earlier) + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[feature], rows.count) + w[-1] + w[len(names) : -1] @ side
        r = np.where(used, _sigmoid(z) - y, 0.0)
        g = np.concatenate([np.bincount(feature, r[row], len(names)), side @ r, [r.sum()]]) / n
        g[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(many)
    weights[names] = w[: len(names)]
    return Linear(weights, w[len(names) : -1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of largest F1, half way to the next lower score; above all scores without positives."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal scores fall on one side
    at = int(np.argmax(f1))
    return float((p[at] + p[at + 1]) / 2) if at + 1 < len(p) else float(p[at])


def fit_rows(rows: Rows, labels: np.ndarray, names: list[str], fold: np.ndarray) -> Chain:
    """The chain of ``labels`` (row x category, 0 or 1); ``fold`` numbers each row."""
    everyone = np.ones(rows.count, bool)
    outside: list[np.ndarray] = []  # out-of-fold probabilities by category
    models = []
    for j in range(len(names)):
        y, p = labels[:, j].astype(float), np.zeros(rows.count)
        for f in range(FOLDS):
            model = fit_linear(rows, outside, y, fold != f)
            p[fold == f] = score(model, rows, outside)[fold == f]
        models.append(fit_linear(rows, outside, y, everyone))
        outside.append(p)
    return Chain(names, models, best_threshold(outside[-1], labels[:, -1].astype(bool)))


def one_text_each(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, labels...): of the rows of a picked id one text, the first by hash.

    Ids and hashes are grouped first, task by task, so an id of many rows costs
    one row per task.
    """
    names = picked.columns[1:]
    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    # One row of integers per picked id, so both broadcasts are small.
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *names).agg(F.min("hash").alias("hash"))
    same = texts.join(F.broadcast(chosen), ["doc_id", "hash"])
    return same.groupBy("doc_id", *names).agg(F.min("text").alias("text")).select("doc_id", "text", *names)


def frequent(held: DataFrame) -> np.ndarray:
    """Whether each feature is in ``LEAST_DOCS`` or more rows; counted on Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FEATURES_LOG2, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["feature", "n"])

    counted = held.select("features").mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << FEATURES_LOG2, bool)
    out[counted.filter(F.col("n") >= LEAST_DOCS).select("feature").toArrow().column(0).to_numpy()] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, chain: list[tuple[str, Column]] | None = None, rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most ``rows`` labelled documents, one text of each id; several labels of one id count as their largest."""
    chain = chain or categories()
    names = [name for name, _ in chain]
    marked = labels.select("doc_id", *(value.cast("int").alias(name) for name, value in chain))
    marked = marked.na.drop().groupBy("doc_id").agg(*(F.max(name).alias(name) for name in names))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = picked.withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in features(batch.column(1)):
                cuts = np.searchsorted(part.row, np.arange(part.count + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(part.feature.astype(np.int32)))
                here = batch.slice(first, part.count)
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), lists, *here.columns[2:]], names=["doc_id", "features", *names]
                )

    schema = "doc_id bigint, features array<int>, " + ", ".join(f"{name} int" for name in names)
    held = materialise(one_text_each(docs, picked).mapInArrow(run, schema), "toxicity")
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(held))  # of fixed size

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            often = shipped.value[flat]
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[often]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[often]))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, *batch.columns[2:]], names=batch.schema.names)

    # At most ``rows`` rows, each with those of its features that other documents have too.
    table = held.mapInArrow(keep, schema).toArrow().sort_by("doc_id")
    if table.num_rows == 0:
        empty = Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        return fit_rows(empty, np.zeros((0, len(names)), int), names, np.zeros(0, int))
    lists = table.column("features").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(table.num_rows, dtype=np.int32), size)
    matrix = Rows(row, lists.flatten().to_numpy(), table.num_rows)
    marks = np.stack([table.column(name).to_numpy() for name in names], axis=1)
    fold = table.column("doc_id").to_numpy() // 7 % FOLDS
    return fit_rows(matrix, marks, names, fold)


def probabilities(chain: Chain, rows: Rows) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for model in chain.models:
        out.append(score(model, rows, out))
    return out


def predict(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, p_<category>..., rejected) of every row, in one narrow pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            p = np.zeros((len(model.names), batch.num_rows))
            for first, part in features(batch.column(1)):
                p[:, first : first + part.count] = probabilities(model, part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in p), pa.array(p[-1] >= model.threshold)],
                names=["key", *(f"p_{name}" for name in model.names), "rejected"],
            )

    rows = in_small_batches(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key bigint, " + ", ".join(f"p_{name} double" for name in chain.names) + ", rejected boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def reject(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` without the rows the chain rejects; nothing is shuffled."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for first, part in features(batch.column(at)):
                kept[first : first + part.count] = probabilities(model, part)[-1] < model.threshold
            yield batch.filter(pa.array(kept))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
