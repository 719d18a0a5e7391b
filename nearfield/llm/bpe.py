"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is one token with which its encoding
ends.  ``PrefixTable`` keeps that token for each prefix: the token that ends at
``i`` and starts at ``j`` is the one whose left neighbour, the last token of the
prefix ``j``, may stand before it.  Two tokens may stand side by side if the
merges, run over the bytes of both, give these two tokens back.  The encoding is
read off backwards; appending bytes adds entries and changes none, and after an
edit the table is filled again only until it agrees with the old one.

A text is first cut by the split pattern, each piece is encoded by itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import in_small_batches

# White space as the split pattern's \s means it.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_ASCII = r"\t-\r\x20"
# Pieces whose ends may still move when bytes follow: contractions look this far ahead.
LOOK_AHEAD = 3
KEPT_PIECES = 1 << 17
KEPT_PAIRS = 1 << 18
KEPT_CHARS = 32
_NEVER = float("inf")


def split_pattern(pattern: str, white: str = WHITE) -> str:
    r"""``pattern`` with \s and \S spelled out, since engines differ in a few control codes."""
    inside = pattern.replace(r"[^\s", f"[^{white}")
    return inside.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


def ascii_pattern(pattern: str) -> str:
    r"""What ``pattern`` says of ASCII texts, for the faster engine that has no \p."""
    narrow = split_pattern(pattern, WHITE_ASCII).replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    return re.sub(r"(?<=\?)(A-Za-z|0-9)(?=\+)", r"[\1]", narrow)


class Vocabulary:
    """Tokens by rank, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.lengths = np.array([len(t) for t in self.tokens])
        # Spines: the tokens at the two ends of a token's merge tree, smallest first, and
        # the rank of the merge that takes each of them up.
        self._spines: list[tuple[list, list] | None] = [None] * len(self.tokens)
        # A trie of reversed tokens: walking back from a position finds all that end there.
        self.back: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            if self.merged(token) != [rank]:
                continue  # never comes out of the merges, so never the last token
            at = 0
            for byte in reversed(token):
                after = self.back[at].get(byte)
                if after is None:
                    after = self.back[at][byte] = len(self.back)
                    self.back.append({})
                    self.ends.append(-1)
                at = after
            self.ends[at] = rank
        self._beside: dict[int, bool] = {}

    def merged(self, data: bytes, below: float = _NEVER) -> list[int]:
        """Tokens of ``data`` by the merges of rank under ``below``: lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, rank = -1, below
            for i in range(len(parts) - 1):
                found = ranks.get(parts[i] + parts[i + 1], _NEVER)
                if found < rank:
                    best, rank = i, found
            if best < 0:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def spines(self, token: int) -> tuple[list, list]:
        """(left, right) spine of ``token`` as (bytes, rank of the merge above)."""
        known = self._spines[token]
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = [], []
            else:
                left, right = self.merged(data, token)
                known = (
                    [*self.spines(left)[0], (self.tokens[left], token)],
                    [*self.spines(right)[1], (self.tokens[right], token)],
                )
            self._spines[token] = known
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether no merge ever takes bytes of both.

        Merges run in the order of rank, so at any time the parts at the seam are
        one token of the left one's right spine and one of the right one's left
        spine.  A merge across the seam happens if it comes before both of them
        are taken up, on the left side also at the same rank.
        """
        pair = left << 32 | right
        known = self._beside.get(pair)
        if known is None:
            if len(self._beside) >= KEPT_PAIRS:
                self._beside.clear()
            known = self._beside[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b, rank = self.spines(left)[1], self.spines(right)[0], self.ranks.get
        i = j = 0
        while True:
            x, up = a[i] if i < len(a) else (self.tokens[left], _NEVER)
            y, over = b[j] if j < len(b) else (self.tokens[right], _NEVER)
            across = rank(x + y, _NEVER)
            if across < up and across <= over and across != _NEVER:
                return False
            if up == over == _NEVER:
                return True
            if up <= over:
                i += 1
            else:
                j += 1


class PrefixTable:
    """``last[i]``: the last token of the encoding of the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """More bytes at the end; entries of shorter prefixes stay."""
        words, last = self.vocabulary, self.last
        back, ends, beside, known = words.back, words.ends, words.beside, words._beside.get
        start = len(self.data)
        self.data += data
        data = self.data
        for end in range(start + 1, len(data) + 1):
            node, at, found = 0, end, -1
            while at:
                node = back[node].get(data[at - 1])
                if node is None:
                    break
                at -= 1
                token = ends[node]
                if token >= 0:
                    if at == 0:
                        found = token
                        break
                    left = last[at]
                    fits = known(left << 32 | token)
                    if fits or fits is None and beside(left, token):
                        found = token
                        break
            if found < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            last.append(found)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` for the bytes ``start:end``; returns how many entries were filled anew.

        Once as many entries as the longest token has bytes agree with the old
        ones behind the edit, all later ones do.
        """
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        del self.data[start:], self.last[start + 1 :]
        self.append(data)
        agree = 0
        for done, byte in enumerate(tail):
            self.append(bytes([byte]))
            agree = agree + 1 if self.last[-1] == old[done] else 0
            if agree >= self.vocabulary.longest:
                self.data += tail[done + 1 :]
                self.last += old[done + 1 :]
                return len(data) + done + 1
        return len(data) + len(tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to token ids and back; ids of pieces met lately are kept as bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(split_pattern(pattern))
        self.split_ascii = re.compile(ascii_pattern(pattern))
        self.kept = _Pieces(vocabulary)
        self._text = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self._start = np.concatenate([[0], np.cumsum(vocabulary.lengths)])

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, self.pieces(text)))

    def forget(self) -> None:
        self.kept = _Pieces(self.vocabulary)

    def pieces(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        length = self.vocabulary.lengths[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self._start[ids] - (ends - length), length)
        return self._text[at].tobytes()

    def appended(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of ``text + more`` from the ids of ``text``; only the last pieces are cut again."""
        at, kept = 0, 0
        for piece in self.pieces(text):
            if at + len(piece) > len(text) - LOOK_AHEAD:
                break
            at, kept = at + len(piece), kept + len(self.kept[piece]) // 4
        return ids[:kept] + self.encode(text[at:] + more)


class _Pieces(dict):
    """Ids by piece in two generations: what was met since the last change of generation stays."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = PrefixTable(self.vocabulary, piece.encode("utf-8")).tokens()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; once per process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Encoder(Vocabulary(ranks), pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", keep_ids: bool = True
) -> DataFrame:
    """(key, ids, n_tokens, ids_sha256, decoded_sha256) of every row.

    ``ids`` holds little-endian 32-bit ids; without ``keep_ids`` it is left out.
    The decoded digest is taken of the bytes that the ids give back.  NULL is the
    empty text; no row is dropped, merged or shuffled, so each task needs one
    batch of texts and the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        coder.forget()  # what is kept is one task's
        for batch in batches:
            size, ids, packed_hash, decoded_hash = [], [], [], []
            for value in batch.column(1):
                packed = coder.packed(value.as_py() or "")
                size.append(len(packed) // 4)
                packed_hash.append(hashlib.sha256(packed).hexdigest())
                decoded_hash.append(hashlib.sha256(coder.decode(packed)).hexdigest())
                if keep_ids:
                    ids.append(packed)
            columns = {"key": batch.column(0), "n_tokens": pa.array(size, pa.int64())}
            columns |= {"ids_sha256": pa.array(packed_hash, pa.string())}
            columns |= {"decoded_sha256": pa.array(decoded_hash, pa.string())}
            columns |= {"ids": pa.array(ids, pa.binary())} if keep_ids else {}
            yield pa.RecordBatch.from_pydict(columns)

    rows = in_small_batches(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
