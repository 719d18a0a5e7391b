"""Hamming search by pieces of the code."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bounded_search import asked_codes, brute_hamming, code_rows, code_table

from nearfield.operators import multi_index
from nearfield.operators.knn import query_blocks
from nearfield.operators.radius import hamming_radius_knn


def ranked(found, asked):
    rows = sorted(found.collect(), key=lambda r: r.rk)
    return {q: [(r.dist, r.vec_id) for r in rows if r.qid == q] for q in asked}


@pytest.mark.parametrize(("k", "bits"), [(1, 16), (7, 8), (300, 16), (5000, 8)])
def test_pieces_equal_brute_force(spark, k, bits):
    """A code of a third of the rows, codes near it, far codes that need the full count, a NULL code."""
    x = code_rows()
    ids = [int(i) for i in np.random.default_rng(3).permutation(np.arange(-300, 300) * 10**15)]
    table = code_table(spark, x, ids).union(code_table(spark, [None], [77])).repartition(5).cache()
    asked = [ids[0], ids[5], ids[250], ids[599]]
    index = multi_index.build(table, "sign", 128, bits)
    assert ranked(multi_index.hamming_mih_knn(asked_codes(table, asked), index, k), asked) == brute_hamming(x, ids, asked, k)


def test_only_near_codes_are_met(spark):
    """Queries beside a crowd are done from a few postings; the copies of a code are one posting a chunk."""
    x, ids = code_rows(3000), list(range(3000))
    table = code_table(spark, x, ids)
    index = multi_index.build(table, "sign", 128, 16)
    assert index.postings.filter(F.col("held") >= 1000).count() == 8
    (block,) = query_blocks(asked_codes(table, [0, 1400]))
    found, done = multi_index.nearest_codes(block, index, 10, 2)
    assert done == {0, 1400} and found.count() < 1500
    (far,) = query_blocks(asked_codes(table, [2999]))
    assert multi_index.nearest_codes(far, index, 10, 1)[1] == set()


def test_pieces_of_odd_tables(spark):
    table = code_table(spark, code_rows(20), [5] * 12 + list(range(8)))  # ids that repeat
    none = table.limit(0)
    asked = asked_codes(table, [5])
    found = multi_index.hamming_mih_knn(asked, multi_index.build(table, "sign", 128), 4)
    assert sorted(found.collect()) == sorted(hamming_radius_knn(asked, table, 4, "sign").collect())
    assert multi_index.hamming_mih_knn(asked, multi_index.build(none, "sign", 128), 4).count() == 0
    assert multi_index.hamming_mih_knn(asked.limit(0), multi_index.build(table, "sign", 128), 4).count() == 0
    short = table.withColumn("code_sign", F.transform("code_sign", lambda w: w.bitwiseAND(F.lit(0xFFFFF))))
    index = multi_index.build(short, "sign", 20, 8)  # the last chunk is not full
    found = multi_index.hamming_mih_knn(asked_codes(short, [5, 3]), index, 4)
    want = hamming_radius_knn(asked_codes(short, [5, 3]), short, 4, "sign")
    assert index.chunks == 3 and sorted(found.collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="bits"):
        multi_index.build(table, "sign", 128, 32)
