"""Word-piece counts by a longest-match automaton.

The trie of the vocabulary gets failure links as in linear-time MaxMatch: where a
node v has no edge for the next byte, the greedy pieces of v's string that can be
settled are popped, and the walk goes on at the node for what is left.  A node keeps
just the number of pieces popped, so a word is counted in one pass over its bytes
without a piece being built.

A piece that ends a word is another piece than the same letters within one.  The last byte of a word is therefore
a symbol of its own (the byte plus ``LAST``): pieces within a word never take it, so that
the longest piece that still leaves a spelling to the end of the word is taken.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
LAST = 256  # added to the byte that ends a word


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Pieces as symbols: bytes, the last of those that end a word raised by LAST."""
    table = _byte_of_char()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = []
    for piece in vocabulary:
        body, ends = (piece[:-4], True) if piece.endswith("</w>") else (piece, False)
        if body and all(c in table for c in body):
            symbols = [table[c] for c in body]
            symbols[-1] += LAST * ends
            out.append(tuple(symbols))
    return out


def symbols_of(word: bytes) -> tuple[int, ...]:
    return (*word[:-1], word[-1] + LAST)


class Automaton:
    """edges[v][symbol] is the child; on a miss at v, popped[v] pieces are settled and the walk goes on at fail[v] (-1: nowhere, the word can't be spelt)."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            v = 0
            for s in piece:
                nxt = self.edges[v].get(s)
                if nxt is None:
                    nxt = self.edges[v][s] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                v = nxt
            final[v] = True
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for u in level:
                for s, v in self.edges[u].items():
                    below.append(v)
                    if final[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    at, n = self.fail[u], self.popped[u]
                    while at >= 0 and s not in self.edges[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.popped[v] = self.edges[at][s], n
            level = below

    def count(self, word: bytes) -> int:
        """Greedy longest pieces of a word of one byte or more; one that can't be spelt is one unknown piece."""
        edges, fail, popped = self.edges, self.fail, self.popped
        v = n = 0
        for s in symbols_of(word):
            while (nxt := edges[v].get(s)) is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = nxt
        while v > 0:
            n += popped[v]
            v = fail[v]
        return n if v == 0 else 1


class _Counts(dict):
    """Counts by word; words of more than 48 characters are counted anew each time."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 48:
            if len(self) > 400_000:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(Automaton(read_vocabulary(path)))


def _emit(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, find = _counts(SparkFiles.get(name)).__getitem__, WORD.findall
        for b in batches:
            n_words, n_tokens = [], []
            for text in b.column(1):
                text = text.as_py()
                if text is None:
                    n_words.append(None), n_tokens.append(None)
                    continue
                found = find(text.lower())
                n_words.append(len(found)), n_tokens.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of docs.

    docs needs doc_id and text; vocabulary is a file of the driver's, which is sent to the workers.  Words
    are those of ``WORD`` in the lower-cased text, each split into the longest pieces
    from its left; one that can't be spelt counts as one piece.  A null text has null
    counts, an empty one 0; a text of any length counts whole; null ids and repeated rows are kept as they are; other
    columns are ignored; an empty table gives an empty result.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_emit(os.path.basename(vocabulary)), f"doc_id {kind}, n_words long, n_tokens long")
