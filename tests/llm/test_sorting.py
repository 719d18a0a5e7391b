"""Whitening, sharding and spelling variants against plain calculations."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import ODD_TEXTS, SF_DIR, TESTDATA, documents, none, odd, shared_folder  # noqa: F401
from pyspark.sql import functions as F

from nearfield.llm import queries, sharding, spelling, whitening

# --- whitening ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, component string, n string, whitened string"


def whole(rows):
    """(vec_id, x) of the rows that take part."""
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            yield i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def long(value):
    return value if value < 2**63 else None


def check_whitening(rows, found, components=32):
    good = list(whole(rows))
    n, width = len(good), len(good[0][1])
    sums = [sum(x[d] for _, x in good) for d in range(width)]
    z = np.array([[n * x[d] - sums[d] for d in range(width)] for _, x in good], object)
    exact = z.T @ z
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = defaultdict(list)
    for r in found:
        got[r.component].append(r)
    assert sorted(got) == list(range(1, min(components, width) + 1))
    for c, part in got.items():
        assert {r.n for r in part} == {n}
        assert Counter((r.vec_id, r.deviation) for r in part) == Counter(
            (i, long(int((z[k] * z[k]).sum()))) for k, (i, _) in enumerate(good)
        )
        assert all(abs(r.identity_error) <= 1e-4 for r in part)
        e, trace = values[c - 1], np.trace(v)
        if e <= 1e-12 * values[0] or values[0] <= 0:
            assert all(r.whitened is None for r in part)
            continue
        assert np.allclose([r.explained for r in part], e / trace, rtol=1e-4)
        want = z.astype(float) @ vectors[:, c - 1] / n / math.sqrt(e)
        y = np.sort([r.whitened for r in part])
        assert min(np.abs(y - np.sort(sign * want)).max() for sign in (1, -1)) < 1e-6
        assert abs((y * y).sum() / n - 1) < 1e-6


def test_whitening_of_embeddings(spark):
    table = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(rows, whitening.whiten(table).collect())


@pytest.mark.parametrize("scale", [0.5, 200.0, 1e6])
def test_whitening_of_odd_vectors(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) @ np.diag([1, 2, 0.5, 3, 0]) * scale
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    rows += [(90, None), (91, []), (92, [None] * 5), (93, [math.nan] * 5), (94, [math.inf] + [0.0] * 4), (95, [0.0] * 5)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (97, [1.0, None, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], VECTORS).repartition(7)
    found = whitening.whiten(table).collect()
    check_whitening(rows, found)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, 0.0)] * 8
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [2.0**25])]):
        with pytest.raises(Exception, match="share one width|summed exactly"):
            whitening.whiten(spark.createDataFrame(bad, schema).coalesce(1)).count()


@given(st.lists(st.lists(st.integers(-(2**29), 2**29), min_size=3, max_size=3), min_size=1, max_size=20))
def test_sums_are_exact(rows):
    u = np.array(rows, np.int64)
    total = [0] * 6
    for first in range(0, len(u), whitening.row_step(u)):
        part = whitening.square_sums(u[first : first + whitening.row_step(u)])
        total = [a + int(b) for a, b in zip(total, part, strict=True)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    assert total == [sum((r[i] + r[j] if i != j else r[i]) ** 2 for r in rows) for i, j in pairs]


def test_deviation_beyond_a_long():
    made = whitening.deviations(np.array([[1, 1], [1 << 28, 0]], np.int64), whitening.Sums(1 << 30, [5, 7]))
    assert made.to_pylist() == [((1 << 30) - 5) ** 2 + ((1 << 30) - 7) ** 2, None]
    small = whitening.deviations(np.array([[3, 4]], np.int64), whitening.Sums(3, [4, 5]))
    assert small.to_pylist() == [(3 * 3 - 4) ** 2 + (3 * 4 - 5) ** 2]


# --- sharding ----------------------------------------------------------------------------


def check_shards(rows, found, shards=16, tolerance=sharding.TOLERANCE):
    """``rows``: (doc_id, text); ``found``: rows with doc_id, size, shard and slot."""
    sizes = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, sizes(t)) for i, t in rows)
    slots, held = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(0 <= s < shards for s in slots)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(held.values()), max((r.size for r in found), default=0)
    for cut in range(1, shards):
        off = abs(sum(held[s] for s in range(cut)) - total * cut / shards)
        assert off <= max(largest / 2, tolerance * total / shards) + 1
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    ids = [-(2**63) if i is None else i for i in order]
    assert ids == sorted(ids)


def test_shards_of_documents(spark, documents):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_shards(rows, sharding.shard(documents).collect())
    check_shards(rows, sharding.shard(documents, shards=3, tolerance=0.0).collect(), 3, 0.0)


def test_shards_of_odd_rows(spark, odd, none):  # noqa: F811
    check_shards(ODD_TEXTS, sharding.shard(odd.withColumn("slot", F.lit("x"))).collect())
    empty = sharding.shard(none)
    assert empty.count() == 0 and {"size", "shard", "slot"} <= set(empty.columns)
    one = spark.createDataFrame([(5, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.size, r.slot) for r in sharding.shard(one).collect()] == [(5, 1, 0)]
    ends = [(2**63 - 1, "a"), (-(2**63), "b"), (None, "c"), (0, "d")] * 9
    check_shards(ends, sharding.shard(spark.createDataFrame(ends, "doc_id bigint, text string"), 4).collect(), 4)


@pytest.mark.parametrize("same_text", [True, False])
def test_a_third_of_the_rows_under_one_id(spark, same_text):
    rows = [(7, "same text" if same_text else f"text {k}") for k in range(3000)]
    rows += [(k * k, "y" * (k % 50)) for k in range(6000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check_shards(rows, sharding.shard(table).collect(), tolerance=0.01)


def test_counts_below_probes(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(-9, 9, 500), rng.integers(-99, 99, 500), rng.integers(1, 9, 500), strict=True)]
    keyed = spark.createDataFrame(rows, "_a bigint, _b bigint, size bigint")
    key = lambda a, b: ((a + 2**63) << 64) + b + 2**63
    probes = sorted({key(int(a), int(b)) for a, b in zip(rng.integers(-9, 9, 40), rng.integers(-99, 99, 40), strict=True)})
    counts = sharding.count_below(keyed, probes)
    assert counts.size == [sum(n for a, b, n in rows if key(a, b) < p) for p in probes]
    assert counts.rows == [sum(1 for a, b, _ in rows if key(a, b) < p) for p in probes]


def test_written_shards(spark, documents, tmp_path):  # noqa: F811
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shard(documents), path)
    back = spark.read.parquet(path)
    check_shards([(r.doc_id, r.text) for r in documents.collect()], back.collect())
    assert back.filter("shard = 3").count() == sharding.shard(documents).filter("shard = 3").count()


# --- spelling ----------------------------------------------------------------------------


def plain_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = defaultdict(list)
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
        holes[w].add(w)
    for group in holes.values():
        for a in group:
            near[a] += [b for b in group if a != b and one_edit(a, b)]
    form = {}
    for w, n in words.items():
        best = min(set(near[w]), key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(set(near[w])), words[form[w]] if w in form else None))
    return out


def check_variants(rows, found):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    assert len(got) == len(set(got))
    want = plain_variants(rows)
    assert set(got) == want
    return want


def test_variants_of_documents(spark, documents):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = check_variants(rows, queries.op13_spelling_variants(spark, SF_DIR))
    assert any(form for _, form, *_ in want)
    with_tiles = spelling.spelling_variants(documents, tile=5)
    check_variants(rows, with_tiles)


def test_variants_of_odd_rows(spark, odd, none):  # noqa: F811
    check_variants(ODD_TEXTS, spelling.spelling_variants(odd))
    empty = spelling.spelling_variants(none)
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("tile", [4, 64, 512])
def test_variants_of_made_words(spark, tile):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(5, 9))) for _ in range(150)] + ["x" * 3000, "x" * 3001, "straße", "strasse"]
    words = list(base)
    for w in base:  # chains of rarer and rarer variants
        at = int(rng.integers(len(w)))
        words += [w[:at] + "c" + w[at:], w[:at] + w[at + 1 :], w[:at] + "ÿ" + w[at + 1 :]]
    rows = [(k, " ".join([w.upper() if k % 2 else w] * int(rng.choice([1, 3, 6, 20, 50])))) for k, w in enumerate(words)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = check_variants(rows, spelling.spelling_variants(table, tile=tile))
    assert any(root not in (word, form) for word, form, root, *_ in want)


letters = st.text(st.sampled_from("abÿ"), min_size=1, max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.lists(letters, min_size=2, max_size=40, unique=True))
def test_blocks_find_every_near_pair(words):
    import pyarrow as pa

    codes = pa.array([w.encode("latin-1") for w in words], pa.binary())
    groups = np.arange(spelling.LETTERS) % spelling.GROUPS
    row, key = spelling.block_keys(spelling.Words(codes), groups)
    found = Counter()
    for one in np.unique(key):
        at = np.sort(row[key == one])
        part = spelling.Words(codes.take(pa.array(at)))
        i, j = spelling.near_pairs(part, np.zeros(len(at), int), np.full(len(at), one & 15), groups)
        found.update(frozenset((words[at[a]], words[at[b]])) for a, b in zip(i, j, strict=True))
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert set(found) == want and set(found.values()) <= {1}


@pytest.mark.parametrize("name", ["op11_polarised_whitening", "op12_histogram_shards"])
def test_new_queries_run(spark, name):
    found = queries.queries()[name](spark, SF_DIR)
    rows = found.collect()
    if name.startswith("op12"):
        table = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
        check_shards([(r.doc_id, r.text) for r in table], rows)
        crc = Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in table)
        assert Counter((r.doc_id, r.text_crc32) for r in rows) == crc
        assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
        assert found.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    else:
        assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == whitening.RESULT
