"""Neighbourhood scores of every test link and its negatives, without a row per wedge.

A pair meets the neighbours of both its ends in a cell: sources and targets are dealt
into blocks by hash, a cell is a block of sources and one of targets, and the lists of
neighbours go to the cells of their block. A cell marks the neighbours of one vertex
and sums the marks along the lists of its partners, so that wedges exist only in a
task's memory, a few million at a time. With the input both the number of cells and the
copies of a list grow, the latter as its square root. Rows travel as packed columns (a
few bytes a value) in blobs.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.portable import hash_int
from chronoweave.session import stored

#: Pairs and neighbours in a cell; those from which there is another share; places of training edges in a block of draws; rows packed at once; marks summed at once.
CELL_ROWS, SHARE_ROWS, DRAW_ROWS, PACK_ROWS, SUM_ROWS = 6_000_000, 25_000_000, 1_000_000, 500_000, 4_000_000
#: Stands for a missing id, which matches nothing.
NONE = np.iinfo(np.int64).min
#: What a blob holds.
SOURCES, TARGETS, DEGREES, PAIRS = 0, 1, 2, 3
ENDS, DRAWS = 0, 1
BLOBS = "part int, kind int, blob binary"
SCORES = "qid bigint, slot int, label int, common bigint, adamic_adar double, popularity bigint"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers in as few bytes a value as their largest needs, byte by byte, so that compression finds what repeats."""
    out = []
    for c in columns:
        x = np.ascontiguousarray(c, "<i8")
        width = 8 if x.min(initial=0) < 0 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        out += [struct.pack("<qB", len(x), width), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        n, width = struct.unpack_from("<qB", blob, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += 9 + n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted values; cumsum undoes it."""
    return np.diff(x, prepend=0)


def block(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Spark's pmod(xxhash64(id), blocks)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = turned(ids.astype(np.uint64) * p2, 31) * p1
    h ^= np.uint64(42 + int(p5) + 8)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % blocks


def _joined(parts: Iterable[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns of the parts, about PACK_ROWS rows at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= PACK_ROWS:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _columns(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    return _joined([b.column(b.schema.get_field_index(n)).cast(pa.int64()).fill_null(NONE).to_numpy() for n in names] for b in batches)


def _split(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows in the order) for each part."""
    p = part[order]
    bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1)) if len(p) else []
    for i, j in zip(bounds, bounds[1:]):
        yield int(p[i]), order[i:j]


def _rows(found: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, kind, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])


def _blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        yield from zip(b.column(b.schema.get_field_index("kind")).to_pylist(), b.column(b.schema.get_field_index("blob")).to_pylist())


def _pairs(parts: Iterable[list[np.ndarray]], blocks: int, shares: int) -> Iterator[tuple[int, int, bytes]]:
    """Blobs of (code, src, dst) by cell of their share."""
    for code, src, dst in parts:
        cell = block(src, blocks) // shares * blocks + block(dst, blocks)
        for c, rows in _split(cell, np.lexsort((code, cell))):
            yield c, PAIRS, packed(steps(code[rows]), src[rows], dst[rows])


def _asking(blocks: int, shares: int, slots: int) -> Callable:
    """Packs the asking links themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(_pairs(([pos * slots, src, dst] for pos, src, dst in _columns(batches, ["pos", "src", "dst"])), blocks, shares))

    return run


def _by_place(width: int, kind: int, names: list[str]) -> Callable:
    """Packs rows by blocks of `width` places, the first of the names; sorted by the second if there are three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, bytes]]:
            for columns in _columns(batches, names):
                part, first = columns[0] // width, columns[len(columns) - 2]
                for p, rows in _split(part, np.lexsort((first, part))):
                    at = columns[0][rows] - p * width
                    yield p, kind, packed(steps(at), columns[1][rows]) if kind == ENDS else packed(steps(columns[1][rows]), at, columns[2][rows])

        yield from _rows(found())

    return run


def _drawn(width: int, blocks: int, shares: int) -> Callable:
    """In a block of places: the draws get the end of the edge at their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, draws = np.full(width, NONE), []
        for kind, blob in _blobs(batches):
            if kind == ENDS:
                at, dst = unpacked(blob)
                ends[np.cumsum(at)] = dst
            else:
                draws.append(blob)
        parts = ([np.cumsum(code), src, ends[at]] for code, at, src in map(unpacked, draws))
        yield from _rows(_pairs(_joined(parts), blocks, shares))

    return run


def _lists(blocks: int) -> Callable:
    """Packs the neighbours of vertices from rows (a, g, b, i) in order of (a, g, b): g 0 says that a is a source that asks, 1 that it is a possible target, 2 is an edge, where i says that a is its target.

    A vertex may come in several pieces, whose sizes add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, bytes]]:
            last, asks, is_target, near = None, False, False, None
            for a, g, b, i in _columns(batches, ["a", "g", "b", "i"]):
                first = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
                edge = g == 2
                new = edge & (b != a) & (b != NONE)
                new[1:] &= ~(edge[:-1] & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
                if last == a[0] and near == b[0] and edge[0]:
                    new[0] = False
                side = [np.add.reduceat(g == x, first, dtype=np.int64) > 0 for x in (0, 1)]
                if last == a[0]:
                    side[0][0] |= asks
                    side[1][0] |= is_target
                n, degree = np.add.reduceat(new, first, dtype=np.int64), np.add.reduceat(np.where(edge, i, 0), first)
                vertex = a[first]
                last, asks, is_target, near = a[-1], side[0][-1], side[1][-1], b[-1] if edge[-1] else None
                yield 0, DEGREES, packed(steps(vertex), n)
                begin = np.concatenate([[0], np.cumsum(n)])
                near_by = b[new]
                for kind in (SOURCES, TARGETS):
                    of = np.flatnonzero(side[kind])
                    part = block(vertex[of], blocks)
                    for p, rows in _split(part, np.argsort(part, kind="stable")):
                        v = of[rows]
                        lists, at = near_by[_ranges(begin[v], n[v])], np.cumsum(n[v]) - n[v]
                        d = steps(lists)
                        d[at[n[v] > 0]] = lists[at[n[v] > 0]]
                        yield p, kind, packed(steps(vertex[v]), n[v], degree[v], d)

        yield from _rows(found())

    return run


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - n), n)


def _places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among sorted known values, or -1."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


class Lists:
    """Neighbours by vertex, those in `only` (sorted) if given; near holds ids, or with `only` places in it."""

    def __init__(self, blobs: list[bytes], only: np.ndarray | None = None) -> None:
        pieces, degrees, sizes, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for blob in blobs:
            a, n, degree, d = unpacked(blob)
            total, at = np.cumsum(d), np.cumsum(n) - n
            some = n > 0
            near = total - np.repeat(total[at[some]] - d[at[some]], n[some])
            if only is not None:
                place = _places(only, near)
                n = np.bincount(np.repeat(np.arange(len(n)), n)[place >= 0], minlength=len(n))
                near = place[place >= 0].astype(np.int32)
            pieces.append(np.cumsum(a)), degrees.append(degree), sizes.append(n), lists.append(near)
        piece, size = np.concatenate(pieces), np.concatenate(sizes)
        near = np.concatenate(lists[1:] or lists)
        self.ids, of = np.unique(piece, return_inverse=True)
        order = np.argsort(of, kind="stable")
        begin = np.cumsum(size) - size
        self.near = near[_ranges(begin[order], size[order])]
        self.n = np.bincount(of, size, len(self.ids)).astype(np.int64)
        self.degree = np.bincount(of, np.concatenate(degrees), len(self.ids)).astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n


def _sums(marked: Lists, walked: Lists, m: np.ndarray, w: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many, summed weight) of the neighbours that marked[m] and walked[w] share, for each pair of places; -1 is nobody."""
    common, score = np.zeros(len(m), np.int64), np.zeros(len(m))
    live = np.flatnonzero((m >= 0) & (w >= 0))
    live = live[(marked.n[m[live]] > 0) & (walked.n[w[live]] > 0)]
    live = live[np.argsort(m[live], kind="stable")]
    mark = np.zeros(len(weight))
    for v, pairs in _split(m, live):
        at = marked.near[marked.begin[v] : marked.begin[v] + marked.n[v]]
        mark[at] = weight[at]
        upto = np.cumsum(walked.n[w[pairs]])
        i = 0
        while i < len(pairs):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SUM_ROWS, "right")))
            rows, n = pairs[i:j], walked.n[w[pairs[i:j]]]
            x = mark[walked.near[_ranges(walked.begin[w[rows]], n)]]
            first = np.cumsum(n) - n
            score[rows] = np.add.reduceat(x, first)
            common[rows] = np.add.reduceat(x > 0, first, dtype=np.int64)
            i = j
        mark[at] = 0
    return common, score


def _scored(slots: int) -> Callable:
    """In a cell: the scores of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {SOURCES: [], TARGETS: [], DEGREES: [], PAIRS: []}
        for kind, blob in _blobs(batches):
            by[kind].append(blob)
        if not by[PAIRS]:
            return
        targets = Lists(by.pop(TARGETS))
        via, near = np.unique(targets.near, return_inverse=True)
        targets.near = near.astype(np.int32)
        k = np.zeros(len(via), np.int64)
        for blob in by.pop(DEGREES):
            a, n = unpacked(blob)
            at = _places(via, np.cumsum(a))
            np.add.at(k, at[at >= 0], n[at >= 0])
        weight = 1 / np.log(k + 2)
        sources = Lists(by.pop(SOURCES), via)
        parts = [unpacked(x) for x in by.pop(PAIRS)]
        code = np.concatenate([np.cumsum(p[0]) for p in parts])
        s = _places(sources.ids, np.concatenate([p[1] for p in parts])).astype(np.int32)
        t = _places(targets.ids, np.concatenate([p[2] for p in parts])).astype(np.int32)
        del parts
        # each marked vertex costs about as much as some thousand marks along a list
        cost = lambda a, b, x, y: 3_000 * len(a.ids) + int(b.n[y[y >= 0]].sum())
        common, score = _sums(targets, sources, t, s, weight) if cost(targets, sources, t, s) <= cost(sources, targets, s, t) else _sums(sources, targets, s, t, weight)
        degree = np.append(targets.degree, 0)[t]
        for i in range(0, len(code), 100_000):
            c, x = code[i : i + 100_000], slice(i, i + 100_000)
            slot = (c % slots - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (c // slots, slot, (slot < 0).astype(np.int32), common[x], score[x], degree[x])], names=["qid", "slot", "label", "common", "adamic_adar", "popularity"])

    return run


def scores(links: DataFrame, train: int, asks: int, negatives: int, seed: int = 0) -> DataFrame:
    """All shares in one."""
    return shares(links, train, asks, negatives, seed, 1)[0]


def shares(links: DataFrame, train: int, asks: int, negatives: int, seed: int, most: int) -> list[DataFrame]:
    """(qid, slot, label, common, adamic_adar, popularity) of the links from place `asks` on (slot -1, label 1) and of `negatives` drawn targets of each, in at most `most` shares by blocks of sources.

    links: (pos, src, dst) without gaps, those before place `train` are the training graph; it is read several
    times. Draws are those of linkpred.negatives, common and adamic_adar are over the undirected training graph,
    popularity is the training in-degree. Nothing but lists of neighbours and asking links is written for all
    shares, so that those who use up one after another hold a share's pairs and copies of lists on disk.
    """
    spark = links.sparkSession
    slots = negatives + 1
    known, asking = links.where(F.col("pos") < train), stored(links.where(F.col("pos") >= asks))
    n = asking.count() * slots + 3 * train
    blocks = max(3, math.ceil(math.sqrt(n / CELL_ROWS)))
    # lists of neighbours, once for each block
    sides = known.select("dst").union(asking.select("dst")).distinct().select(F.col("dst").alias("a"), F.lit(1).alias("g"))
    sides = sides.union(asking.select("src").distinct().select("src", F.lit(0))).select("a", "g", F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("i"))
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("i"))))
    rows = known.select(both.alias("e")).select("e.a", F.lit(2).alias("g"), "e.b", "e.i").union(sides).where("a is not null")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-train // CELL_ROWS))
    lists = stored(rows.repartition(tasks, "a").sortWithinPartitions("a", "g", "b").mapInArrow(_lists(blocks), BLOBS))
    count = min(most, blocks, max(1, math.ceil(n / SHARE_ROWS)))
    return [_share(i, count, blocks, lists, known, asking, train, slots, seed) for i in range(count)]


def _share(share: int, shares: int, blocks: int, lists: DataFrame, known: DataFrame, asking: DataFrame, train: int, slots: int, seed: int) -> DataFrame:
    """The scores of the sources in every shares-th block from `share` on; of a share's cells, the first are those of its first block."""
    own = len(range(share, blocks, shares))
    of_source = F.pmod(F.xxhash64(F.coalesce("src", F.lit(NONE))), F.lit(blocks))
    asking = asking.where(F.pmod(of_source, F.lit(shares)) == share) if shares > 1 else asking
    row = F.floor(F.col("part") / shares).cast("int") * blocks
    cells = F.when(F.col("kind") == SOURCES, F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: row + x)).when(F.col("kind") == TARGETS, F.transform(F.sequence(F.lit(0), F.lit(own - 1)), lambda x: x * blocks + F.col("part")))
    here = lists.where((F.col("kind") != SOURCES) | (F.col("part") % shares == share))
    found = here.select(F.explode(F.coalesce(cells, F.sequence(F.lit(0), F.lit(own * blocks - 1)))).alias("part"), "kind", "blob")
    # pairs
    found = found.union(asking.select("pos", "src", "dst").mapInArrow(_asking(blocks, shares, slots), BLOBS))
    if train:
        width = min(train, DRAW_ROWS)
        slot = asking.select("pos", "src", F.explode(F.sequence(F.lit(0), F.lit(slots - 2))).alias("slot"))
        at = F.pmod(hash_int(F.lit(seed), F.col("pos"), F.col("slot")), F.lit(train))
        draws = slot.select(at.alias("at"), (F.col("pos") * slots + F.col("slot") + 1).alias("code"), "src").mapInArrow(_by_place(width, DRAWS, ["at", "code", "src"]), BLOBS)
        ends = known.select("pos", "dst").mapInArrow(_by_place(width, ENDS, ["pos", "dst"]), BLOBS)
        found = found.union(ends.union(draws).repartitionById(-(-train // width), F.col("part")).mapInArrow(_drawn(width, blocks, shares), BLOBS))
    return found.repartitionById(own * blocks, F.col("part")).mapInArrow(_scored(slots), SCORES)
