"""Token counts by greedy longest match, read off an automaton.

The vocabulary is a trie.  Node ``v`` fails to the node that spells what is left
of ``v`` after its greedy pieces are taken off; the number of those pieces is
stored with the link.  Counting a word walks each byte once and adds the stored
numbers, so no piece is ever built.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a word is
matched as its bytes followed by an end mark, so word-final entries of the
vocabulary are found like all others.  A byte that starts no entry counts as a
piece of its own.  A NULL or empty text has no words and no pieces.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import in_small_batches

END = 256  # the symbol after the last byte of a word
END_SUFFIX = "</w>"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KEPT_WORDS = 1 << 18
KEPT_BYTES = 64


def printable_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: visible
    Latin-1 letters stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Entries of a word-end vocabulary as symbols; special entries are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    table, out = printable_bytes(), []
    for entry in model["vocab"]:
        body = entry.removesuffix(END_SUFFIX)
        if body and all(c in table for c in body):
            out.append(tuple(table[c] for c in body) + ((END,) if body != entry else ()))
    return out


class Automaton:
    """Trie with failure links; ``popped[v]`` pieces are taken when ``v`` fails."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        final = [False]
        singles = [(s,) for s in range(END + 1)]  # makes every word matchable
        for entry in [*singles, *entries]:
            at = 0
            for symbol in entry:
                after = self.step[at].get(symbol)
                if after is None:
                    after = self.step[at][symbol] = len(self.step)
                    self.step.append({})
                    final.append(False)
                at = after
            final[at] = True
        self.fail, self.popped = [0] * len(self.step), [0] * len(self.step)
        level = [(0, s, v) for s, v in self.step[0].items()]
        while level:
            for parent, symbol, node in level:
                if final[node]:
                    self.popped[node] = 1
                else:
                    at, pieces = self._after(parent, symbol)
                    self.fail[node], self.popped[node] = at, pieces
            level = [(node, s, v) for _, _, node in level for s, v in self.step[node].items()]

    def _after(self, node: int, symbol: int) -> tuple[int, int]:
        """Where ``symbol`` leads once ``node`` has failed, and the pieces taken on the way."""
        pieces, node = self.popped[node], self.fail[node]
        while symbol not in self.step[node]:
            pieces, node = pieces + self.popped[node], self.fail[node]
        return self.step[node][symbol], pieces

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; linear in its length."""
        step, fail, popped = self.step, self.fail, self.popped
        node = pieces = 0
        for symbol in (*word, END):
            after = step[node].get(symbol)
            while after is None:
                pieces, node = pieces + popped[node], fail[node]
                after = step[node].get(symbol)
            node = after
        while node:
            pieces, node = pieces + popped[node], fail[node]
        return pieces


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


class WordCounts(dict):
    """Pieces by word in two generations: what was met since the last change of generation stays."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, word: bytes) -> int:
        pieces = self.older.get(word)
        if pieces is None:
            pieces = self.machine.count(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = pieces
        return pieces


def count_pieces(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_pieces) of every row; rows are neither joined nor merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCounts(automaton(vocabulary_path))
        for batch in batches:
            words, pieces = [], []
            for value in batch.column(1).cast(pa.binary()):
                found = WORD.findall((value.as_py() or b"").lower())
                words.append(len(found))
                pieces.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())],
                names=["key", "n_words", "n_pieces"],
            )

    rows = in_small_batches(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "key bigint, n_words bigint, n_pieces bigint")
    return out.withColumnRenamed("key", key)
