"""Operators on single texts against the libraries and against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import documents, none, odd, shared_folder  # noqa: F401
from tokenizers import Tokenizer

from nearfield.llm import bpe, secret_scan, text, tokenfile, wordpiece

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={}
    )


def rows(df):
    return Counter(map(tuple, df.collect()))


# --- byte-level BPE -------------------------------------------------------------------


def expected_bpe(reference, items):
    out = Counter()
    for key, value in items:
        ids = reference.encode_ordinary(value or "")
        packed = np.array(ids, "<u4").tobytes()
        out[key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((value or "").encode()).hexdigest()] += 1
    return out


def test_bpe_equals_the_library(spark, odd, documents, none, reference):
    for docs in (odd, documents, none):
        want = expected_bpe(reference, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep_ids=False)
        assert rows(got) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=20))
def test_bpe_round_trip_and_append(coder, reference, one, more):
    assert coder.encode(one) == reference.encode_ordinary(one)
    assert coder.decode(coder.packed(one)) == one.encode()
    assert coder.appended(one, coder.encode(one), more) == coder.encode(one + more)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeé ", min_size=1, max_size=400), st.data())
def test_prefix_table_edits(coder, text_, data):
    raw = text_.encode()
    table = bpe.PrefixTable(coder.vocabulary, raw)
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    new = data.draw(st.binary(max_size=5))
    table.replace(a, b, new)
    fresh = bpe.PrefixTable(coder.vocabulary, raw[:a] + new + raw[b:])
    assert table.last == fresh.last and table.tokens() == coder.vocabulary.merged(bytes(fresh.data))


def test_edit_stops_early(coder):
    table = bpe.PrefixTable(coder.vocabulary, b"the quick brown fox jumps over it " * 200)
    assert table.replace(100, 103, b"zz") < 400


# --- piece counts ---------------------------------------------------------------------


def greedy(word: bytes, entries: set) -> int:
    symbols, pieces, at = (*word, wordpiece.END), 0, 0
    while at < len(symbols):
        end = next((e for e in range(min(len(symbols), at + 80), at, -1) if symbols[at:e] in entries), at + 1)
        at, pieces = end, pieces + 1
    return pieces


def test_piece_counts(spark, odd, documents, none):
    entries = set(wordpiece.vocabulary(WORDS))
    for docs in (odd, documents, none):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
            each = Counter(found)
            want[r.doc_id, len(found), sum(greedy(w, entries) * n for w, n in each.items())] += 1
        assert rows(wordpiece.count_pieces(docs, WORDS)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=5), max_size=12), st.binary(max_size=12))
def test_automaton_on_small_vocabularies(entries, word):
    word = bytes(b % 4 for b in word)
    known = {tuple(e) for e in entries}
    assert wordpiece.Automaton(list(known)).count(word) == greedy(word, known)


# --- token files ----------------------------------------------------------------------


def expected_files(items):
    coder, out, start = Tokenizer.from_file(WORDS), [], 0
    for key, value in items:
        ids = [*coder.encode(value or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, documents):
    items = sorted((r.doc_id, r.text) for r in documents.collect())
    folder = tokenfile.write_tokens(documents, WORDS, 2, parts=5)
    got = tokenfile.read_tokens(spark, folder)
    assert [tuple(r)[:4] for r in got.orderBy("start").collect()] == expected_files(items)


def test_token_files_of_odd_rows(spark, odd, none, monkeypatch):
    folder = tokenfile.write_tokens(odd, WORDS, 2, parts=3)
    got = [tuple(r) for r in tokenfile.read_tokens(spark, folder, keep_ids=False).orderBy("start").collect()]
    keys = [r[0] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == odd.count()
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    want = Counter((k, n, c) for k, _, n, c in expected_files([(r.doc_id, r.text) for r in odd.collect()]))
    assert Counter((k, n, c) for k, _, n, c in got) == want
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(none, WORDS, 2)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.floats(0.0, 1.0))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    columns = tokenfile.pack(ids, percentile=percentile)
    assert (tokenfile.unpack(columns, len(ids)) == ids).all()
    for i in range(len(ids) // tokenfile.BLOCK):
        part = ids[i * tokenfile.BLOCK : (i + 1) * tokenfile.BLOCK]
        assert (tokenfile.read_block(columns, i) == part).all()


def test_width_follows_the_percentile():
    ids = np.full(tokenfile.BLOCK, 5, np.uint32)
    ids[::2], ids[7] = 6, 1 << 30
    columns = tokenfile.pack(ids)
    assert columns["width"].tolist() == [1] and columns["place"].tolist() == [7]


# --- secrets --------------------------------------------------------------------------


def plain_spans(value: str) -> list[tuple[str, int, int]]:
    word = "password|passwd|secret|token|api_?key"
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    found = []
    for order, (kind, pattern, group, least) in enumerate(
        [
            ("assign", rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 16),
            ("hex", "[0-9a-f]+", 0, 32),
        ]
    ):
        for m in re.finditer(pattern, value):
            if len(m[group]) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def expected_secrets(items):
    out = Counter()
    for key, value in items:
        spans = plain_spans(value or "")
        kinds = Counter(k for k, _, _ in spans)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out[key, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest(), base] += 1
    return out


def test_secrets_equal_plain_search(spark, odd, documents, none):
    for docs in (odd, documents, none):
        ledger = secret_scan.open_ledger(spark)
        got = secret_scan.digest(secret_scan.scan_paths(docs, ledger))
        assert rows(got) == expected_secrets([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_ledger_scans_each_blob_and_version_once(spark, documents):
    ledger = secret_scan.open_ledger(spark)
    half = documents.filter("doc_id % 2 = 0")
    secret_scan.update_ledger(half, ledger)
    first = secret_scan.read_ledger(spark, ledger).count()
    assert first == half.select("text").distinct().count()
    secret_scan.update_ledger(documents, ledger)
    entries = secret_scan.read_ledger(spark, ledger)
    assert entries.count() == entries.select("blob").distinct().count() == documents.select("text").distinct().count()
    secret_scan.update_ledger(documents, ledger)
    assert secret_scan.read_ledger(spark, ledger).count() == entries.count()
    fewer = secret_scan.RULES[:1]
    secret_scan.update_ledger(half, ledger, rules=fewer)
    assert secret_scan.read_ledger(spark, ledger).groupBy("rule_version").count().count() == 2


def test_one_row_of_a_blob_is_scanned(spark, monkeypatch, conf):
    scanned, real = [], secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda blobs, rules: scanned.append(blobs.count()) or real(blobs, rules))
    rows = [(7, "token = abcdefgh12")] * 500 + [(i, f"secret: {i:08d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    more = docs.union(spark.createDataFrame([(1, "fresh")] * 3, docs.schema))
    for limit in (1 << 20, 0):
        conf("nearfield.maxBroadcastBytes", limit)
        ledger = secret_scan.open_ledger(spark)
        secret_scan.update_ledger(docs, ledger)
        secret_scan.update_ledger(more, ledger)
        found = secret_scan.digest(secret_scan.scan_paths(more, ledger))
        assert found.filter("n_assign = 1").count() == 510 and found.count() == 513
    assert scanned == [11, 1, 0] * 2


def test_redaction(spark, odd):
    ledger = secret_scan.open_ledger(spark)
    secret_scan.update_ledger(odd, ledger)
    clean = secret_scan.redact(odd, ledger)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    by_id = {r.doc_id: r for r in clean.collect() if r.doc_id}
    for r in odd.collect():
        want, end = "", 0
        for _, a, b in plain_spans(r.text or ""):
            if a >= end:
                want += r.text[end:a] + "[secret]"
            end = max(end, b)
        if end and r.doc_id:
            assert by_id[r.doc_id].text == want + r.text[end:]
            assert by_id[r.doc_id].n_chars == len(by_id[r.doc_id].text)
        elif r.doc_id:
            assert by_id[r.doc_id].text == r.text and by_id[r.doc_id].n_chars == r.n_chars


# --- words ----------------------------------------------------------------------------


def test_words_of_rows(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    values = [None, "", *("".join(rng.choice("aB \t\né") for _ in range(rng.randint(0, 50))) for _ in range(300)), "y" * 200]
    monkeypatch.setattr(text, "SLICE_BYTES", 64)
    names: dict[int, bytes] = {}
    got = [[] for _ in values]
    for part in text.words(pa.array(values)):
        for h, r in zip(part.hashes.tolist(), part.row.tolist(), strict=True):
            got[part.first + r].append(h)
    for value, found in zip(values, got, strict=True):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (value or "").replace("B", "b").encode())
        assert len(found) == len(want)
        for h, w in zip(found, want, strict=True):
            assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)
