"""Exact percentiles from sketches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import sketched
from nearfield.operators.quantiles import exact_percentiles

PROBS = [i / 8 for i in range(1, 8)]


def table(spark, n=6000):
    """A plain, a skewed, a two-valued and a constant dimension, and one that a third of the rows share."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=n), rng.lognormal(0, 9, n), rng.integers(0, 2, n) * 1e300, np.full(n, -0.25), rng.normal(size=n)], axis=1)
    x[: n // 3, 4] = 0.125
    rows = [(r,) for r in x.tolist()] + [(None,)]
    return spark.createDataFrame(rows, "v array<double>").repartition(7).cache(), x


def counted(df, acc):
    def run(batches):
        for batch in batches:
            acc.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_two_reads_give_exact_percentiles(spark):
    df, x = table(spark)
    acc = spark.sparkContext.accumulator(0)
    means, cuts = sketched.exact_percentiles_sketched(counted(df, acc), PROBS, width=5)
    assert acc.value == 2 * df.count()
    assert np.allclose(means, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(cuts, np.quantile(x, PROBS, axis=0).T, rtol=1e-12)
    plan = sketched.sketch(df, "v", 5, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize(("k", "left"), [(8, 10**6), (64, 500), (4096, 0)])
def test_coarse_sketches_and_long_tables_go_on_in_bins(spark, k, left):
    df, _ = table(spark)
    _, cuts = sketched.exact_percentiles_sketched(df, PROBS, values_left=left, k=k)
    assert np.array_equal(cuts, exact_percentiles(df, PROBS)[1])


def test_a_sketch_that_misses_is_found_out(spark, monkeypatch):
    df, _ = table(spark)
    monkeypatch.setattr(sketched, "MARGIN", -0.4)  # ranges that leave their rank out
    _, cuts = sketched.exact_percentiles_sketched(df, PROBS, k=8)
    assert np.array_equal(cuts, exact_percentiles(df, PROBS)[1])


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    means, cuts = sketched.exact_percentiles_sketched(df, [0.25, 0.5])
    assert means.tolist() == [2.0, 5.0] and cuts.tolist() == [[1.5, 2.0], [5.0, 5.0]]
    with pytest.raises(ValueError, match="no vectors"):
        sketched.exact_percentiles_sketched(df.filter(F.lit(False)), PROBS)
