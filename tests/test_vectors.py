import numpy as np
import pytest
from conftest import vectors
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from nearfield.functions import rules
from nearfield.functions import vectors as fv
from nearfield.operators import prep, quantiles
from nearfield.sources import vectors as source


def values(df, column):
    return [row[0] for row in df.orderBy("vec_id").select(column).collect()]


def test_normalize_and_zero_vector(spark):
    df = vectors(spark, [[3, 4], [0, 0], None, [np.nan, 1], [None, 1]])
    got = values(df.select("vec_id", fv.l2_normalize("embedding").alias("v")), "v")
    assert got[0] == pytest.approx([0.6, 0.8])
    assert got[1:] == [None, None, None, None]


def test_pad_truncate_then_normalize(spark):
    df = vectors(spark, [[3, 4]])
    assert values(df.select("vec_id", fv.pad_truncate("embedding", 4).alias("v")), "v") == [[3, 4, 0, 0]]
    assert values(prep.prepare(df, 4, 4), "v")[0] == pytest.approx([0.6, 0.8, 0, 0])
    wide = vectors(spark, [[3, 4, 12]])
    assert values(prep.prepare(wide, 2, 2), "v")[0] == pytest.approx([0.6, 0.8])


def test_matryoshka_prefix(spark):
    df = vectors(spark, [[3, 4, 12]])
    assert values(prep.prepare(df, 2, 3), "v")[0] == pytest.approx([0.6, 0.8])


def test_unsound_rows_drop_out(spark):
    df = vectors(spark, [[3, 4], [0, 0], None, [1, 0]])
    assert [r.vec_id for r in prep.represent(df, 2, 2, ("f32", "f16", "code_sign")).orderBy("vec_id").collect()] == [0, 3]


def test_ragged_and_empty_are_rejected(spark, tmp_path):
    for rows in ([[1, 2], [1, 2, 3]], [[], []]):
        with pytest.raises(ValueError, match="one width"):
            source.check_widths(vectors(spark, rows))
    with pytest.raises(PythonException, match="one width"):
        vectors(spark, [[1, 2], [1, 2, 3]]).coalesce(1).select(fv.l2_normalize("embedding")).collect()
    path = str(tmp_path / "v")
    vectors(spark, [[1, 2], [3, 4]]).write.parquet(path)
    assert source.load_vectors(spark, path).count() == 2


def test_half_rounding(spark):
    # Fixed values of IEEE half precision.
    cases = [(1 / 3, 0.333251953125), (65504, 65504), (65520, np.inf), (2**-24, 2**-24), (2**-25, 0), (2049, 2048)]
    df = vectors(spark, [[x for x, _ in cases]], element="double")
    assert values(df.select("vec_id", fv.to_half("embedding").alias("h")), "h")[0] == [y for _, y in cases]


def test_vector_text(spark):
    df = vectors(spark, [[0.1, -2.5, 1e-7]])
    text = df.withColumn("t", fv.vector_to_text("embedding"))
    row = text.select("t", "embedding", fv.text_to_vector("t").alias("back")).first()
    assert row.t.startswith("[0.1,-2.5,") and row.back == row.embedding


def test_ivf_rule(spark):
    # Fixed values: (rows, k) -> (lists, probes, probes over codes).
    want = {
        (500, 10): (50, 8, 24),
        (50_000, 100): (250, 16, 48),
        (40_000, 100): (200, 12, 36),
        (500_000, 100): (500, 31, 93),
        (50_000, 1000): (250, 21, 63),
        (1_000_000, 1000): (500, 42, 126),
    }
    df = spark.createDataFrame(list(want), "n bigint, k int")
    got = df.select("n", "k", *rules.ivf_params("n", "k"), rules.search_width("k").alias("w")).collect()
    assert {(r[0], r[1]): tuple(r[2:5]) for r in got} == want
    assert {r.w for r in got} == {1000}


def test_storage_estimates(spark):
    row = spark.range(1).select(
        rules.vector_storage_mb(F.lit(50_000), F.lit(1024), F.lit("float32")),
        rules.vector_storage_mb(F.lit(50_000), F.lit(256), F.lit("float16")),
        rules.code_storage_mb(F.lit(50_000), F.lit(1024), F.lit(8)),
    ).first()
    assert [round(x, 1) for x in row] == [214.8, 26.9, 53.7]


def test_generated_vectors_ignore_partitioning(spark):
    ids = spark.range(50).withColumnRenamed("id", "vec_id")
    one = values(source.gen_vectors(ids.coalesce(1), 8), "embedding")
    many = values(source.gen_vectors(ids.repartition(7), 8), "embedding")
    assert one == many
    assert np.linalg.norm(one, axis=1) == pytest.approx(np.ones(50))


def test_generated_vectors_look_gaussian(spark):
    ids = spark.range(2000).withColumnRenamed("id", "vec_id")
    x = np.array(values(source.gen_vectors(ids, 16), "embedding")) * 4
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02


def test_dense_ids(spark):
    rows = spark.range(1000).withColumn("h", F.xxhash64("id")).repartition(7).filter("id % 3 <> 0 or id < 500")
    total = rows.count()
    got = source.assign_ids(rows, "h").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(total))
    assert [r.h for r in got] == sorted(r.h for r in got)
    assert sorted(r.row_id for r in source.assign_ids(rows).collect()) == list(range(total))


@pytest.mark.parametrize("n", [1, 123, 10_000, 10_001, 10**6])
def test_cap_is_one_operator_at_every_size(spark, n):
    rows = spark.range(12_000).select((F.col("id") % 11_000 * 7 - 40).alias("vec_id"), F.col("id").alias("x"))
    rows = rows.withColumn("vec_id", F.when(F.col("x") % 50 > 0, F.col("vec_id"))).repartition(5)
    keys = [r.vec_id for r in source.cap_rows(rows, n).collect()]
    want = sorted((r.vec_id for r in rows.collect()), key=lambda k: (k is None, k or 0))[:n]
    assert sorted(keys, key=lambda k: (k is None, k or 0)) == want
    hashed = rows.filter("x < 200").select(F.xxhash64("x").alias("vec_id"), "x")
    assert source.cap_rows(hashed, n).count() == min(n, 200)
    named = hashed.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    assert sorted(r.vec_id for r in source.cap_rows(named, n).collect()) == sorted(r.vec_id for r in named.collect())[:n]


def test_sample_is_whole_and_stable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "vec_id")
    plain = {r.vec_id for r in source.hash_sample(rows, 50, "s").collect()}
    assert plain == {r.vec_id for r in source.hash_sample(rows.repartition(5), 50, "s").collect()} and len(plain) == 50
    assert source.hash_sample(rows, 12_000, "s").count() == 12_000
    assert abs(source.hash_share(rows, 2000, "t").count() - 2000) < 300


@pytest.mark.parametrize("ids", [list(range(60)), [0, 0, 1, 1, 2, 3, None, 5, 6, 7, 8, 8, 8, 9], [1, 2, None], []])
def test_a_gathered_sample_holds_the_same_rows(spark, ids):
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "vec_id bigint, row int").repartition(4)
    for n in (1, 3, 6, 20):
        want = sorted(map(tuple, source.hash_sample(rows, n, "entry").collect()))
        got = source.gathered_sample(rows, n, "entry")
        assert sorted((r["vec_id"], r["row"]) for r in got.to_pylist()) == want
