"""Cuts oversized texts into numbered pieces at natural boundaries, with overlap.

A text starts as atomic segments (sentences and lines; words where a sentence is too
long; runs of characters where a word is). Adjacent segments sit in a heap by the
strength of the boundary between them, and the weakest boundaries are merged first
while the combined size plus the overlap fits.

Defined cases: sizes are in Unicode code points; null and short texts give no piece;
white space counts as text and stays with the segment before it, so that the pieces
without their overlaps join to exactly the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4_000, 200
BOUNDARIES = ("character", "word", "sentence", "line", "paragraph", "section")
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)

_BREAK = re.compile(
    r"(?P<p>[ \t]*(?:\r\n|\r|\n)(?:[ \t ]*(?:\r\n|\r|\n))+)"
    r"|(?P<l>[ \t]*(?:\r\n|\r|\n))"
    r"|(?P<s>(?:[.!?…][\"'”’»)\]]*[ \t 　]+|[。！？][”’」』）]*))"
)
_WORDS = re.compile(r"\S*\s+|\S+")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|={1,6}[^=\n]|\\(?:sub)*section|\\paragraph|<[hH][1-6][\s>]|(?=[^\n]{2,80}(?:\n|\r|$))[A-Z0-9][^\n.!?;:]*(?:\n|\r|$))")
_SPACE = re.compile(r"\s+")


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments, and the strength of the boundary at each end."""
    ends: list[int] = []
    strength: list[int] = []
    at = 0

    def add(end: int, kind: int) -> None:
        nonlocal at
        if end - at > most:
            for m in _WORDS.finditer(text, at, end):
                a, b = m.span()
                while b - a > most:
                    a += most
                    ends.append(a)
                    strength.append(CHARACTER)
                ends.append(b)
                strength.append(WORD)
            strength[-1] = kind
        else:
            ends.append(end)
            strength.append(kind)
        at = end

    for m in _BREAK.finditer(text):
        end = m.end()
        if end == at or end == len(text):
            continue
        if m.lastgroup == "p":
            kind = SECTION if _HEADING.match(text, end) else PARAGRAPH
        else:
            kind = LINE if m.lastgroup == "l" else SENTENCE
        add(end, kind)
    if at < len(text):
        add(len(text), SECTION)
    return ends, strength


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(from, start, end, boundary) of each piece: it shows text[from:end], of which text[from:start] repeats the piece before."""
    most = limit - overlap
    ends, strength = _atoms(text, most)
    n = len(ends)
    start = [0, *ends[:-1]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    version = [0] * n
    heap = [(strength[i], ends[i + 1] - start[i], i, i + 1, 0, 0) for i in range(n - 1) if ends[i + 1] - start[i] <= most]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, size, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        ends[i], strength[i], after[i], alive[j] = ends[j], strength[j], after[j], False
        version[i] += 1
        nxt, prv = after[i], before[i]
        if nxt < n:
            before[nxt] = i
            if (s := ends[nxt] - start[i]) <= most:
                heapq.heappush(heap, (strength[i], s, i, nxt, version[i], version[nxt]))
        if prv >= 0 and (s := ends[i] - start[prv]) <= most:
            heapq.heappush(heap, (strength[prv], s, prv, i, version[prv], version[i]))
    out: list[tuple[int, int, int, int]] = []
    for i in range(n):
        if alive[i]:
            begin = _repeat_from(text, start[i], out[-1][0], overlap) if out else 0
            out.append((begin, start[i], ends[i], strength[i]))
    return out


def _repeat_from(text: str, start: int, least: int, overlap: int) -> int:
    """Where the repeated end of the piece before begins: `overlap` characters back, or at the next word start."""
    at = max(start - overlap, least)
    if at > least and not text[at - 1].isspace() and not text[at].isspace():
        m = _SPACE.search(text, at, start)
        if m and m.end() < start:
            return m.end()
    return at


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, overlap, boundary[, piece]) of every text longer than the limit; piece_no from 1."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    names = [key, "piece_no", "n_pieces", "start", "end", "overlap", "boundary"] + ["piece"] * with_text
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                cols: list[list] = [[] for _ in names]
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pieces = spans(t, limit, overlap)
                    for no, (begin, start, end, kind) in enumerate(pieces, 1):
                        row = [k, no, len(pieces), start, end, start - begin, BOUNDARIES[kind]]
                        for c, v in zip(cols, row + [t[begin:end]] * with_text):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema[0].type), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], names=names)

    oversized = df.select(key, text).where(F.length(text) > limit)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start bigint, `end` bigint, overlap int, boundary string" + ", piece string" * with_text
    return oversized.mapInArrow(run, schema)
