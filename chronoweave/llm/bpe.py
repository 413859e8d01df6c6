"""Exact byte-pair encoding in linear time by backtracking, and decoding by an offset table.

A greedy pass takes the longest vocabulary entry at each place (Aho-Corasick); a pair of
neighbours is accepted only if the merges would have kept that boundary, which a
pair-compatibility table decides; where no entry fits, the pass goes back one token and
takes its next shorter prefix. The result equals that of the merges.

Defined cases: a null or empty text has no ids; any text has ids, since every byte is an
entry; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
#: The public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose ids a worker keeps, and the longest of them in characters.
CACHE_WORDS, CACHE_CHARS = 400_000, 48
#: Rows of an Arrow batch that are encoded at a time.
SLICE = 512


class _Words(dict):
    """word -> its ids; filled on first use and emptied when full."""

    def __init__(self, encoder: Bpe) -> None:
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode_bytes(word.encode("utf-8")))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    def __init__(self, path: str) -> None:
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = [len(t) for t in self.tokens]
        self._tables()
        self.trie = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.trie.add_word(t.decode("latin-1"), r)
        self.trie.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.words = _Words(self)
        lengths = np.array(self.lengths, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def _tables(self) -> None:
        """The last merge of each token (split), the token of each mergeable pair, and each token's next shorter prefix."""
        n = len(self.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.pair: dict[tuple[int, int], int] = {}
        self.prefix = [-1] * n
        ranks = self.ranks
        for rank, token in enumerate(self.tokens):
            size = len(token)
            for i in range(size - 1, 0, -1):
                a = ranks.get(token[:i])
                if a is None:
                    continue
                if self.prefix[rank] < 0:
                    self.prefix[rank] = a
                if a < rank:
                    b = ranks.get(token[i:])
                    if b is not None and b < rank and self.compatible(a, b):
                        self.left[rank], self.right[rank] = a, b
                        self.pair[a, b] = rank
                        break
            if size > 1 and self.prefix[rank] < 0:
                for i in range(size - 1, 0, -1):
                    if (a := ranks.get(token[:i])) is not None:
                        self.prefix[rank] = a
                        break

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between tokens a and b, undoing merges from the latest backwards."""
        limit, pair, left, right = 1 << 40, self.pair, self.left, self.right
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            for side in (0, 1) if a > b else (1, 0):
                if side == 0:
                    limit, a = a, right[a]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, left[b]
                    if b + 1 != limit:
                        break
            else:
                return True

    def encode_bytes(self, data: bytes) -> list[int]:
        if (one := self.ranks.get(data)) is not None:
            return [one]
        compatible, lengths, prefix, trie = self.compatible, self.lengths, self.prefix, self.trie
        text = data.decode("latin-1")
        out: list[int] = []
        dead: set[int] = set()
        at, end = 0, len(text)
        token = self._longest(text, 0)
        while True:
            last = out[-1] if out else -1
            while True:
                stop = at + lengths[token]
                if stop not in dead and (last < 0 or compatible(last, token)):
                    out.append(token)
                    at = stop
                    if at == end:
                        return out
                    token = self._longest(text, at)
                    break
                if prefix[token] >= 0:
                    token = prefix[token]
                    continue
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                break

    def _longest(self, text: str, at: int) -> int:
        return next(self.trie.iter_long(text, at))[1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.words
        return [i for w in self.pattern.findall(text) for i in words[w]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words
        return sum([len(words[w]) for w in self.pattern.findall(text)])

    def decode(self, ids: Iterable[int]) -> bytes:
        """ids -> bytes: each id's span of the token pool, by the offset table."""
        i = np.fromiter(ids, dtype=np.int64)
        if not len(i):
            return b""
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        total = np.cumsum(size)
        at = np.arange(total[-1]) + np.repeat(start - (total - size), size)
        return self.pool[at].tobytes()


_LOADED: dict[str, Bpe] = {}


def load(folder: str = TOKENIZERS, name: str = DEFAULT) -> Bpe:
    """The encoder of a rank file; one per process."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = DEFAULT) -> DataFrame:
    """(key, ids): one row per row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, name)
        words, find = bpe.words, bpe.pattern.findall
        for b in _slices(batches):
            flat, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend([i for w in find(t) for i in words[w]])
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str = "ids", folder: str = TOKENIZERS, name: str = DEFAULT) -> DataFrame:
    """(key, text): the text of each list of ids; bytes that aren't UTF-8 come out as replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, name)
        for b in _slices(batches):
            out = [bpe.decode(i or []).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def count_column(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS, name: str = DEFAULT) -> DataFrame:
    """The kept columns and n_tokens, the number of ids of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, name)
        words, find = bpe.words, bpe.pattern.findall
        for b in _slices(batches):
            n = [sum([len(words[w]) for w in find(t)]) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint")
