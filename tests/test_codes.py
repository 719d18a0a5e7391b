import numpy as np
import pytest
from conftest import vectors
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.functions import blocks, codes
from nearfield.functions import vectors as fv
from nearfield.operators import metrics, prep, quantiles

T8 = np.array([[1.0, 2, 3, 4, 5, 6, 7]])
T4 = np.array([[2.0, 4, 6]])
THRESHOLDS = codes.Thresholds(np.array([3.0]), T4, T8, "full")


@pytest.mark.parametrize(
    ("value", "variant", "bits"),
    [
        # Bit patterns of one dimension.
        (3.5, "thermo8", "11100000"),
        (3.5, "onehot8", "00010000"),
        (5.0, "thermo4", "1100"),
        (5.0, "onehot4", "0010"),
        (0.5, "thermo8", "00000000"),
        (0.5, "onehot8", "10000000"),
        (9.0, "thermo8", "11111110"),
        (9.0, "onehot8", "00000001"),
        (1.0, "thermo8", "10000000"),
        (1.0, "onehot8", "01000000"),
        (3.0, "mean", "1"),
        (0.0, "sign", "0"),
    ],
)
def test_bit_patterns(spark, value, variant, bits):
    df = vectors(spark, [[value]], element="double")
    words = df.select(codes.code("embedding", variant, THRESHOLDS).alias("c"))
    assert words.select(codes.bits_to_string("c", codes.bits_per_dim(variant))).first()[0] == bits


def test_extra_bits_are_zero(spark):
    df = vectors(spark, [[3.5]], element="double")
    words = df.select(codes.code("embedding", "thermo8", THRESHOLDS, width=12).alias("c"))
    assert words.select(codes.bits_to_string("c", 12)).first()[0] == "111000000000"
    with pytest.raises(ValueError, match="more than"):
        codes.code("embedding", "onehot8", THRESHOLDS, width=7)
    with pytest.raises(ValueError, match="unknown code variant"):
        codes.code("embedding", "thermo3", THRESHOLDS, width=4)


def test_bit_string_both_ways(spark, embeddings, thresholds):
    for variant, nbits in (("sign", 64), ("thermo4", 256), ("mean", 20)):
        dim = nbits // codes.bits_per_dim(variant)
        table = prep.represent(embeddings, dim, 64, (f"code_{variant}",), thresholds)
        text = table.withColumn("t", codes.bits_to_string(f"code_{variant}", nbits))
        back = text.withColumn("b", codes.string_to_words("t"))
        assert back.filter(f"b <> code_{variant} or length(t) <> {nbits}").isEmpty()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=5, max_size=5), min_size=2, max_size=6))
def test_code_distances_follow_buckets(rows):
    x = np.array(rows, float)
    cuts = np.sort(np.random.default_rng(1).integers(0, 9, (5, 7)), axis=1).astype(float)
    learned = codes.Thresholds(x.mean(0), cuts[:, [1, 3, 5]], cuts, "full")
    for variant in ("thermo4", "thermo8", "onehot4", "onehot8"):
        at = codes.bucket_rows(x, learned.cuts(variant)).astype(int)
        packed = codes.code_rows(x, variant, learned)
        got = metrics.Hamming.coarse(packed, packed)
        gaps = np.abs(at[:, None, :] - at[None, :, :])
        want = gaps.sum(2) if variant.startswith("thermo") else 2 * (gaps > 0).sum(2)
        assert (got == want).all()
        bits = codes.bit_rows(x, variant, learned).astype(int)
        assert (got == np.abs(bits[:, None] - bits[None]).sum(2)).all()


def test_words_round_trip():
    bits = np.random.default_rng(0).integers(0, 2, (20, 130)).astype(np.uint8)
    assert (blocks.unpack_bits(blocks.pack_bits(bits), 130) == bits).all()


def test_hamming_column_counts_the_top_bit(spark):
    df = spark.createDataFrame([(0, [-1, 0], [0, 1])], "vec_id bigint, a array<bigint>, b array<bigint>")
    assert df.select(fv.hamming_distance("a", "b")).first()[0] == 65
    assert metrics.Hamming.coarse(np.array([[-1]]), np.array([[0]]))[0, 0] == 64
    zero = np.zeros(1, int)
    assert metrics.Hamming.exact(np.array([[-1]]), np.array([[0]]), zero, zero)[0] == 64


def test_percentiles_of_four_values(spark):
    df = vectors(spark, [[0], [1], [2], [3]], "v", "double")
    mean, cuts = quantiles.exact_percentiles(df, [0.25, 0.5, 0.75])
    assert mean.tolist() == [1.5] and cuts.tolist() == [[0.75, 1.5, 2.25]]


@pytest.mark.parametrize("kind", ["spread", "copies", "constant", "wide"])
def test_percentiles_by_narrowing(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    if kind == "copies":
        x[:250] = x[0]
    elif kind == "constant":
        x[:] = [1.0, -0.0, 2.5]
    elif kind == "wide":
        x *= 10.0 ** rng.integers(-200, 200, (600, 3))
    df = vectors(spark, x.tolist(), "v", "double").repartition(5)
    means, cuts = quantiles.exact_percentiles(df, prep.EIGHTHS, values_left=40)
    assert np.array_equal(cuts, quantiles.exact_percentiles(df, prep.EIGHTHS)[1])
    assert cuts == pytest.approx(np.percentile(x, np.array(prep.EIGHTHS) * 100, axis=0).T, rel=1e-12)


def test_threshold_modes(spark, embeddings):
    full = prep.fit_thresholds(embeddings, 64)
    sliced = prep.fit_thresholds(embeddings, 64, 16, "slice")
    assert full.t8.shape == (64, 7) and sliced.t8.shape == (16, 7)
    assert np.abs(sliced.t8).mean() > np.abs(full.t8[:16]).mean()
    assert np.array_equal(full.t4, full.t8[:, [1, 3, 5]])
    rough = prep.fit_thresholds_approx(embeddings, 64)
    assert not rough.exact and np.abs(rough.t8 - full.t8).max() < 0.05
    with pytest.raises(ValueError, match="threshold mode"):
        prep.fit_thresholds(embeddings, 64, mode="half")


def test_percentiles_of_values_over_many_magnitudes(spark):
    """Every range ends in single values, with none read to the driver before that."""
    rng = np.random.default_rng(5)
    x = rng.choice([-1.0, 1.0], (3000, 2)) * 10.0 ** rng.uniform(-300, 300, (3000, 2))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>")
    cuts = quantiles.exact_percentiles(df, [0.1, 0.25, 0.9], values_left=0)[1]
    spots = np.array([0.1, 0.25, 0.9]) * 2999
    x.sort(axis=0)
    low, high = x[np.floor(spots).astype(int)], x[np.floor(spots).astype(int) + 1]
    want = low + (high - low) * (spots - np.floor(spots))[:, None]
    assert np.allclose(cuts, want.T, rtol=1e-9, atol=0)
