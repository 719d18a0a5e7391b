"""Exact percentiles in two reads: sketches bound where the ranks lie, a second read finishes.

The first read aggregates a mergeable KLL sketch and a sum per dimension, partly in
every task, then in slices, then in all, so no task ever holds more than one sketch
a dimension for what it merges.  Two quantiles of the sketch enclose each wanted
rank.  The second read counts what lies below each such range and gathers the
values inside.  As sketches may miss by chance, the counts decide: where a rank lies
outside its range, or a table is so long that too many values lie inside, the search
goes on by counting in ever finer bins, from the ranges on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import blocks
from nearfield.operators.quantiles import VALUES_LEFT, _Range, _ranks, _values_left, cuts_within, narrowed
from nearfield.session import shuffle_partitions

SKETCH_K = 4096
MARGIN = 3.0  # times the error that a sketch keeps with 99 % probability
MOST_SLICES = 64


def rank_error(k: int) -> float:
    """Error of a rank, as a share of the rows, that a KLL sketch of size ``k`` keeps with 99 % probability."""
    return 2.296 / k**0.9723


class Sketched:
    """What one read finds out: rows, means, and per dimension the quantiles at the asked ranks."""

    def __init__(self, n: int, means: np.ndarray, quantiles: np.ndarray):
        self.n, self.means, self.quantiles = n, means, quantiles


def sketch(vectors: DataFrame, vec: str, width: int, k: int) -> DataFrame:
    """One row: n, totals and sketches of every dimension."""
    parts = max(1, min(MOST_SLICES, shuffle_partitions(vectors.sparkSession)))
    x = [F.col(vec)[d] for d in range(width)]
    sliced = vectors.groupBy(F.pmod(F.spark_partition_id(), F.lit(parts)).alias("_slice")).agg(
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"t{d}") for d, c in enumerate(x)),
        *(F.kll_sketch_agg_double(c, k).alias(f"s{d}") for d, c in enumerate(x)),
    )
    return sliced.agg(
        F.sum("n").alias("n"),
        F.array(*(F.sum(f"t{d}") for d in range(width))).alias("totals"),
        F.array(*(F.kll_merge_agg_double(f"s{d}", k) for d in range(width))).alias("sketches"),
    )


def enclosed(vectors: DataFrame, vec: str, probs: list[float], width: int, k: int) -> Sketched | None:
    """Quantiles below and above every probability, after the smallest and the largest value."""
    margin = MARGIN * rank_error(k)
    asked = [0.0, 1.0, *(max(0.0, p - margin) for p in probs), *(min(1.0, p + margin) for p in probs)]
    ranks = F.array(*map(F.lit, asked))
    found = F.transform("sketches", lambda s: F.kll_sketch_get_quantile_double(s, ranks))
    row = sketch(vectors, vec, width, k).filter("n > 0").select("n", "totals", found.alias("q")).first()
    if row is None:
        return None
    return Sketched(row.n, np.array(row.totals) / row.n, np.array(row.q))


def spans_of(quantiles: np.ndarray, many: int) -> list[list[tuple[float, float]]]:
    """Per dimension the ranges around the wanted ranks, joined where they meet."""
    out = []
    for of_dim in quantiles:
        joined: list[tuple[float, float]] = []
        for low, high in sorted(zip(of_dim[2 : 2 + many], of_dim[2 + many :], strict=True)):
            if joined and low <= joined[-1][1]:
                low, high = joined[-1][0], max(high, joined.pop()[1])
            joined.append((float(low), float(high)))
        out.append(joined)
    return out


def counted_spans(vectors: DataFrame, vec: str, spans: list[list[tuple[float, float]]]) -> pa.Table:
    """(d, span, x, n): rows below each span (``x`` NULL), and distinct values inside (``span`` -1)."""
    shipped = vectors.sparkSession.sparkContext.broadcast(spans)

    def table(d, span, x, n) -> pa.RecordBatch:
        arrays = [pa.array(d, pa.int32()), pa.array(span, pa.int32()), pa.array(x, pa.float64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["d", "span", "x", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shipped.value
        below = [np.zeros(len(of_dim), np.int64) for of_dim in local]
        for batch in batches:
            x, _ = blocks.read_vectors(batch.column(0))
            x = np.sort(x, axis=0)
            dims, values, counts = [], [], []
            for d in range(x.shape[1]):
                for i, (low, high) in enumerate(local[d]):
                    a, b = np.searchsorted(x[:, d], low, "left"), np.searchsorted(x[:, d], high, "right")
                    below[d][i] += a
                    distinct, count = np.unique(x[a:b, d], return_counts=True)
                    dims.append(np.full(len(distinct), d, np.int32))
                    values.append(distinct)
                    counts.append(count)
            if dims:
                flat = np.concatenate(dims)
                yield table(flat, np.full(len(flat), -1, np.int32), np.concatenate(values), np.concatenate(counts).astype(np.int64))
        d = np.repeat(np.arange(len(local)), [len(b) for b in below])
        span = np.concatenate([np.arange(len(b)) for b in below])
        yield table(d.astype(np.int32), span.astype(np.int32), [None] * len(d), np.concatenate(below))

    found = vectors.select(vec).mapInArrow(run, "d int, span int, x double, n bigint")
    return found.groupBy("d", "span", "x").agg(F.sum("n").alias("n")).toArrow()


def exact_percentiles_sketched(
    vectors: DataFrame,
    probs: list[float],
    vec: str = "v",
    width: int | None = None,
    values_left: int = VALUES_LEFT,
    k: int = SKETCH_K,
) -> tuple[np.ndarray, np.ndarray]:
    """(means (D,), percentiles (D, len(probs))), as ``exact_percentiles`` finds them; ``width`` is D where known."""
    vectors = vectors.select(vec).filter(F.col(vec).isNotNull())
    if width is None:
        one = vectors.select(F.size(vec).alias("width")).first()
        width = one.width if one else 0
    first = enclosed(vectors, vec, probs, width, k) if width else None
    if first is None:
        raise ValueError("no vectors to learn thresholds from")
    spots = _ranks(first.n, probs)
    wanted = {rank for low, high, _ in spots for rank in (low, high)}
    spans = spans_of(first.quantiles, len(probs))
    share = 2 * (MARGIN + 1) * rank_error(k)
    if first.n * min(1.0, share * len(probs)) * width <= values_left:
        found = counted_spans(vectors, vec, spans)
        ranges = [[] for _ in spans]
        inside = found.filter(pc.equal(found.column("span"), -1))
        d_col, x_col, n_col = (inside.column(c).to_numpy() for c in ("d", "x", "n"))
        under = found.filter(pc.greater_equal(found.column("span"), 0))
        below = dict(zip(zip(under.column("d").to_pylist(), under.column("span").to_pylist(), strict=True), under.column("n").to_pylist(), strict=True))
        for d, of_dim in enumerate(spans):
            own, n = x_col[d_col == d], n_col[d_col == d]
            for i, (low, high) in enumerate(of_dim):
                ranges[d].append(_Range(low, high, below[d, i], int(n[(own >= low) & (own <= high)].sum())))
        if all(any(r.below <= rank < r.below + r.count for r in of_dim) for of_dim in ranges for rank in wanted):
            return first.means, cuts_within(inside.select(["d", "x", "n"]), ranges, spots)
    # Bins from the smallest to the largest value, fine inside the ranges.
    edges = []
    for of_dim, q in zip(spans, first.quantiles, strict=True):
        fine = [_Range(low, high, 0, 0).edges() for low, high in of_dim]
        edges.append(np.unique(np.concatenate([[q[0], np.nextafter(q[1], np.inf)], *fine])))
    ranges = narrowed(vectors, vec, [[] for _ in spans], wanted, values_left, edges)
    return first.means, cuts_within(_values_left(vectors, vec, ranges).toArrow(), ranges, spots)
