"""Maps freely typed values to the closest entry of a reference list.

The reference entries stand in a BK-tree under the Levenshtein distance, a true metric:
the triangle inequality prunes every child whose edge differs from the distance by more
than the radius, so all entries within the radius come out. The tree is walked for many
values at once, level by level, with the distance computed bit-parallel over arrays.
Small reference lists (counted) go to every task; larger ones are cut into shards, every
shard answers for every block of values, and the shards' winners are merged.

Before the comparison a value is brought to a common form: letters without marks,
look-alike letters and digits as the Latin letter, upper case, abbreviations of generic
words written out. As words change places, each rotation of the words is looked up.

Defined cases: null, empty and blank values aren't mapped; a value without an entry
within its tolerance gets -1, also one of generic words alone; of equally near entries
those met with the words in their order count first, then those met by their own name,
then the one with the least id; entries with null or blank names are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut

#: Greatest distance that is searched; a value's own tolerance can be less.
RADIUS = 4
#: Reference entries up to which the list goes to every task, and entries of a shard beyond it.
BROADCAST_ENTRIES, SHARD_ENTRIES = 20_000, 20_000
#: Values that meet a shard in one task, readings of a value that are written out (those of others are taken together), and most generic words.
BLOCK_VALUES, MOST_READINGS, GENERIC_WORDS = 20_000, 512, 200_000
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ø": "O", "Đ": "D", "Ł": "L", "Ħ": "H", "ẞ": "SS", "Æ": "AE", "Œ": "OE",
}
#: Digits that stand for a letter they look like.
DIGITS = {"0": "O", "1": "I", "2": "Z", "3": "E", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B"}
#: Short words that stand for another one.
ABBREVIATIONS = {"FOR": "OF", "AND": ""}
#: Words that carry no meaning of their own.
EMPTY_WORDS = frozenset({"THE", "HQ", "REPUBLIC", "REPUBLICOF", "STATE", "KINGDOM", "GOV", "GOVT", "GOVERNMENT"})
#: Endings that make the name of a country that of its people.
PEOPLE_ENDINGS = ("N", "AN", "IAN")
#: Tolerance of a form that isn't the entry's own name.
ALIAS_TOLERANCE = 2
_TABLE = str.maketrans(LOOK_ALIKES | DIGITS)
_NOT_WORD = re.compile(r"[^\w]+|_+")


def fold(value: str) -> list[str]:
    """The words of a value in the common form."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return _NOT_WORD.sub(" ", plain.upper().translate(_TABLE)).split()


def generic_words(counts: Iterable[tuple[str, int, bool]]) -> list[str]:
    """The words of several entries that aren't an entry by themselves; counts: (word, entries that have it, whether one has nothing else)."""
    return sorted(w for w, n, single in counts if n > 1 and not single)


def word_counts(names: Iterable[str]) -> list[tuple[str, int, bool]]:
    """(word, entries that have it, whether one has nothing else) of a list of names."""
    words = [fold(n) for n in names]
    single = {w[0] for w in words if len(w) == 1}
    return [(x, n, x in single) for x, n in Counter(x for w in words for x in set(w)).items()]


@dataclass(frozen=True, slots=True)
class Form:
    """A way to write an entry: the edits allowed, whether it isn't the entry's own name, and whether the entry has generic words."""

    ref_id: int
    allowed: int
    alias: bool
    generic: bool


class Reference:
    """The entries' common forms, their generic words, and the tolerance of each form.

    generic: the generic words of the whole list, where the entries are a part of it; by default these entries are the whole.
    """

    def __init__(self, entries: Iterable[tuple[int, str]], generic: Iterable[str] | None = None) -> None:
        rows = sorted({(i, n) for i, n in entries if i is not None and n and n.strip()})
        words = {(i, n): fold(n) for i, n in rows}
        self.generic = set(generic_words(word_counts(n for _, n in rows)) if generic is None else generic)
        self.by_length = sorted((g for g in self.generic if len(g) > 3), key=lambda g: (-len(g), g))
        self.by_letter: dict[str, list[str]] = {}
        for g in sorted(self.generic):
            self.by_letter.setdefault(g[0], []).append(g)
        self.forms: dict[str, list[Form]] = {}
        for i, n in rows:
            kept = [x for x in words[i, n] if x not in EMPTY_WORDS] or words[i, n]
            named = [x for x in kept if x not in self.generic]
            own = "".join(kept)
            self.forms.setdefault(own, []).append(Form(i, tolerance(len("".join(named))), False, len(named) < len(kept)))
            for form in self._aliases(kept):
                self.forms.setdefault(form, []).append(Form(i, ALIAS_TOLERANCE, True, len(named) < len(kept)))
        self.longest = max(map(len, self.forms), default=0)
        self._known: dict[str, list[str]] = {}

    def _aliases(self, kept: list[str]) -> list[str]:
        if len(kept) == 1:
            return [kept[0] + e for e in PEOPLE_ENDINGS]
        if len(kept) > 2 and kept[-1] in self.generic and kept[0] not in self.generic:
            return ["".join(kept[:-1])]  # the last generic word can be left out
        if len(kept) == 2 and kept[-1] in self.generic and kept[0] not in self.generic:
            return [kept[0] + kept[-1][:n] for n in (4, 7) if len(kept[-1]) > n]  # or be cut
        return []

    def alternatives(self, value: str) -> list[list[str]]:
        """The words of a value without empty ones, each with all words that it can stand for."""
        return [self._full(x) for w in fold(value) for x in self._parts(ABBREVIATIONS.get(w, w))]

    def readings(self, words: list[list[str]], most: int) -> list[tuple[str, ...]] | None:
        """Every choice of one alternative per word that can be near a form; None if there are more than `most`.

        Left out are only choices longer than any form by more than the radius. `OF` counts beside another generic word only.
        """
        plain = lambda r: tuple(x for x in r if x != "OF")
        room = self.longest + RADIUS
        least = [min(0 if x == "OF" else len(x) for x in alternatives) for alternatives in words]
        rest = [sum(least[i:]) for i in range(len(words) + 1)]
        found: list[tuple[str, ...]] = [()]
        sizes = [0]
        for k, alternatives in enumerate(words):
            both = [((*r, x), n + (0 if x == "OF" else len(x))) for r, n in zip(found, sizes) for x in alternatives]
            both = [(r, n) for r, n in both if n + rest[k + 1] <= room]
            if len(both) > most:
                return None
            found, sizes = [r for r, _ in both], [n for _, n in both]
        kept = [r if any(x in self.generic and x != "OF" for x in r) else plain(r) for r in found]
        return [r for r in dict.fromkeys(kept) if any(x not in self.generic for x in r)]

    def _parts(self, w: str) -> list[str]:
        """A word, cut where a generic word has lost its space; nothing for an empty word."""
        if not w or w in EMPTY_WORDS:
            return []
        if w in self.generic:
            return [w]
        if w.startswith("THE") and w[3:] in self.generic:
            return [w[3:]]
        for g in self.by_length:
            if len(w) >= len(g) + 4:
                if w.startswith(g):
                    return [g, w[len(g) :]]
                if w.endswith(g):
                    return [w[: -len(g)], g]
        return [w]

    def _full(self, w: str) -> list[str]:
        """The generic words that w can abbreviate, then w itself: those it begins, else those with its letters in order."""
        if w in self.generic or len(w) < 2:
            return [w]
        if w not in self._known:
            longer = [g for g in self.by_letter.get(w[0], ()) if len(g) >= len(w) + 2]
            begun = [g for g in longer if g.startswith(w)]
            self._known[w] = [*(begun or ([g for g in longer if _within(w, g)] if len(w) > 2 else [])), w]
        return self._known[w]


def _within(short: str, long: str) -> bool:
    letters = iter(long)
    return all(c in letters for c in short)


def tolerance(length: int) -> int:
    """Edits allowed for an entry whose distinctive words have so many letters."""
    return 1 if length <= 4 else 2 if length <= 6 else 3 if length <= 8 else RADIUS


def rotations(words: Sequence[str]) -> list[str]:
    return list(dict.fromkeys("".join([*words[k:], *words[:k]]) for k in range(max(1, len(words)))))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class _Lazy:
    """The chosen ones of some texts, by place."""

    def __init__(self, texts: Sequence[str], chosen: np.ndarray) -> None:
        self.texts, self.chosen = texts, chosen

    def __getitem__(self, i: int) -> str:
        return self.texts[self.chosen[i]]


class BkTree:
    """A BK-tree over distinct strings, walked for many queries at once."""

    def __init__(self, strings: Sequence[str]) -> None:
        self.strings = list(dict.fromkeys(strings))
        letters = sorted({c for s in self.strings for c in s})
        self.code = {c: i for i, c in enumerate(letters)}
        self.length = np.array([len(s) for s in self.strings], dtype=np.int64)
        self.long = self.length > 64
        self.masks = np.zeros((len(self.strings), len(letters) + 1), dtype=np.uint64)
        for i, s in enumerate(self.strings):
            for j, c in enumerate(s[:64]):
                self.masks[i, self.code[c]] |= np.uint64(1 << j)
        # level by level: the first string of a group is its node, the others are grouped by their distance to it
        codes, sizes = self._encoded(self.strings)
        group = np.zeros(len(self.strings), np.int64)
        members = np.arange(len(self.strings))
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(members):
            head = np.ones(len(members), bool)
            head[1:] = group[1:] != group[:-1]
            node = members[head][np.cumsum(head) - 1]
            members, node = members[~head], node[~head]
            d = np.concatenate([self.distances(codes[m], sizes[m], np.arange(len(m)), node[i : i + 65_536], _Lazy(self.strings, m)) for i in range(0, len(members), 65_536) for m in [members[i : i + 65_536]]] or [np.zeros(0, np.int64)])
            order = np.lexsort((members, d, node))
            members, node, d = members[order], node[order], d[order]
            new = np.ones(len(members), bool)
            new[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            edges.append((node[new], d[new], members[new]))
            group = np.cumsum(new)
        parent, label, child = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
        order = np.argsort(parent, kind="stable")
        self.label, self.child = label[order], child[order]
        self.first = np.searchsorted(parent[order], np.arange(len(self.strings) + 1))

    def _encoded(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters' numbers, a row per text, and the lengths."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.full((len(texts), int(sizes.max(initial=1)) or 1), len(self.code), dtype=np.int64)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = [self.code.get(c, len(self.code)) for c in t]
        return codes, sizes

    def distances(self, codes: np.ndarray, sizes: np.ndarray, q: np.ndarray, n: np.ndarray, texts: Sequence[str]) -> np.ndarray:
        """Levenshtein distance of each pair of query and node, bit-parallel over the node's letters."""
        one = np.uint64(1)
        m = self.length[n]
        top = one << (np.clip(m, 1, 64) - 1).astype(np.uint64)
        plus, minus, score = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64), m.copy()
        own = sizes[q]
        for j in range(int(own.max(initial=0))):
            eq = self.masks[n, codes[q, j]]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            on = own > j
            score += on & ((ph & top) != 0)
            score -= on & ((mh & top) != 0)
            ph, mh = (ph << one) | one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
        score = np.where(m == 0, own, score)
        for k in np.flatnonzero(self.long[n]):
            score[k] = levenshtein(self.strings[n[k]], texts[q[k]])
        return score

    def within(self, texts: Sequence[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of every node within the radius of each query."""
        none = np.zeros(0, np.int64)
        if not self.strings or not len(texts):
            return none, none, none
        codes, sizes = self._encoded(texts)
        q, n = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        found = []
        while len(q):
            d = self.distances(codes, sizes, q, n, texts)
            near = d <= radius
            found.append((q[near], n[near], d[near]))
            count = self.first[n + 1] - self.first[n]
            at = np.repeat(self.first[n], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            open_ = np.abs(self.label[at] - np.repeat(d, count)) <= radius
            q, n = np.repeat(q, count)[open_], self.child[at][open_]
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


#: What orders the entries near a value: the distance, then 2 for words in another order plus 1 for a form that isn't the entry's own name, then the id.
Hit = tuple[int, int, int]


class Matcher:
    def __init__(self, entries: Iterable[tuple[int, str]], generic: Iterable[str] | None = None, most_readings: int = MOST_READINGS) -> None:
        self.reference = Reference(entries, generic)
        self.most_readings = most_readings
        self.tree = BkTree(list(self.reference.forms))

    def best(self, values: Sequence[str]) -> list[Hit | None]:
        """The first hit of each value in the order of distance, rank and id among all entries within their tolerance."""
        words = [self.reference.alternatives(v) for v in values]
        readings = [self.reference.readings(w, self.most_readings) for w in words]
        # equal forms are looked up once; where one fits exactly as it stands, no other order can be better
        near = self._near(list(dict.fromkeys("".join(r) for rs in readings for r in rs or ())))
        more = {t for rs in readings for r in rs or () if not any(d == 0 for d, _, _ in self._hits(r, near, rotations(r)[:1])) for t in rotations(r)}
        near |= self._near(sorted(more - near.keys()))
        out: list[Hit | None] = []
        for w, rs in zip(words, readings):
            hits = self._of_many(w) if rs is None else [h for r in rs for h in self._hits(r, near, rotations(r))]
            out.append(min(hits, default=None))
        return out

    def _hits(self, words: tuple[str, ...], near: dict[str, list[tuple[int, Form]]], forms: Sequence[str]) -> Iterator[Hit]:
        has_generic = any(w in self.reference.generic for w in words)
        for k, form in enumerate(forms):
            for d, f in near.get(form, ()):
                # a name with generic words doesn't mean the entry without any
                if f.generic or not has_generic:
                    yield d, 2 * (k > 0) + f.alias, f.ref_id

    def _near(self, texts: Sequence[str]) -> dict[str, list[tuple[int, Form]]]:
        """text -> (distance, form) of the forms within their tolerance."""
        out: dict[str, list[tuple[int, Form]]] = {t: [] for t in texts}
        for a in range(0, len(texts), 4096):
            part = texts[a : a + 4096]
            q, n, d = self.tree.within(part, RADIUS)
            for i, k, e in zip(q.tolist(), n.tolist(), d.tolist()):
                out[part[i]] += [(e, f) for f in self.reference.forms[self.tree.strings[k]] if e <= f.allowed]
        return out

    def _of_many(self, words: list[list[str]]) -> list[Hit]:
        """The hits of a value with more readings than are written out: the least distance over all of them, without writing them out.

        Each word's alternatives are branches that meet again behind it, so one row of the edit-distance table per
        branch, taken for all forms at once, gives the least over the readings of both branches. Readings without a
        generic word but OF are one reading and are looked up as such.
        """
        generic, out = self.reference.generic, []
        plain = [[x for x in a if x not in generic or x == "OF"] for a in words]
        if all(plain):
            r = tuple(x for a in plain for x in a if x != "OF")
            if any(x not in generic for x in r):
                forms = rotations(r)
                out += self._hits(r, self._near(forms), forms)
        strings = self.tree.strings
        if not strings:
            return out
        codes, sizes = self.tree._encoded(strings)
        steps = np.arange(codes.shape[1] + 1)
        far = np.full((len(strings), len(steps)), 10**6, dtype=np.int64)
        for k in range(len(words)):
            # state: (a generic word but OF was met, a word that isn't generic was met)
            rows = {(False, False): np.broadcast_to(steps, far.shape)}
            for alternatives in [*words[k:], *words[:k]]:
                then: dict[tuple[bool, bool], np.ndarray] = {}
                for (g, s), row in rows.items():
                    for x in alternatives:
                        state = (g or (x in generic and x != "OF"), s or x not in generic)
                        then[state] = np.minimum(then.get(state, far), self._advanced(row, x, codes, steps))
                rows = then
            if (True, True) in rows:
                d = rows[True, True][np.arange(len(strings)), sizes]
                for i in np.flatnonzero(d <= RADIUS).tolist():
                    out += [(int(d[i]), 2 * (k > 0) + f.alias, f.ref_id) for f in self.reference.forms[strings[i]] if d[i] <= f.allowed and f.generic]
        return out

    def _advanced(self, row: np.ndarray, word: str, codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The row of the edit-distance table behind the letters of a word, for all forms at once."""
        for c in word:
            other = codes != self.tree.code.get(c, -1)
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + other)
            row = np.minimum.accumulate(new - steps, axis=1) + steps
        return row


def _columns(values: list[str], hits: list[Hit | None]) -> dict[str, list]:
    some = [h or (-1, 0, -1) for h in hits]
    return {"value": values, "ref_id": [h[2] for h in some], "distance": [h[0] for h in some], "rank": [h[1] for h in some]}


def map_values(values: DataFrame, reference: DataFrame, value: str = "value", shards: int | None = None) -> DataFrame:
    """(value, ref_id, distance) of each distinct value; reference: (ref_id, name).

    shards: None counts the reference list and broadcasts it up to BROADCAST_ENTRIES, else cuts it. Both ways give
    the same rows: generic words are those of the whole list, every shard answers with its first hit in one order
    of all hits, and the first of these is the first of all.
    """
    distinct = values.select(F.col(value).cast("string").alias("value")).where(F.col("value").rlike(r"(?U)\S")).distinct()
    entries = reference.select(F.col(reference.columns[0]).cast("bigint").alias("ref_id"), F.col(reference.columns[1]).alias("name")).where("ref_id is not null and name is not null")
    schema = "value string, ref_id bigint, distance int, rank int"
    if shards is None:
        n = entries.limit(BROADCAST_ENTRIES + 1).count()
        shards = 1 if n <= BROADCAST_ENTRIES else -(-entries.count() // SHARD_ENTRIES)
    if shards == 1:
        rows = [(r.ref_id, r.name) for r in entries.collect()]  # at most BROADCAST_ENTRIES

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(rows)
            for b in batches:
                asked = b["value"].tolist()
                yield pd.DataFrame(_columns(asked, matcher.best(asked)))

        return distinct.mapInPandas(run, schema).select("value", "ref_id", "distance")
    generic = _generic_of(entries)
    asked_values = cut(distinct)
    blocks = max(1, -(-asked_values.count() // BLOCK_VALUES))
    left = asked_values.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = entries.withColumn("shard", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(group: pa.Table) -> pa.Table:
        # about BLOCK_VALUES values and SHARD_ENTRIES entries
        rows = group.to_pydict()
        asked = [v for v, name in zip(rows["value"], rows["name"]) if name is None]
        known = [(i, n) for i, n in zip(rows["ref_id"], rows["name"]) if n is not None]
        columns = _columns(asked, Matcher(known, generic).best(asked))
        return pa.table({"value": pa.array(columns["value"], pa.string()), "ref_id": pa.array(columns["ref_id"], pa.int64()), "distance": pa.array(columns["distance"], pa.int32()), "rank": pa.array(columns["rank"], pa.int32())})

    nothing = F.lit(None).cast("string")
    both = left.select("shard", "block", "value", F.lit(None).cast("bigint").alias("ref_id"), nothing.alias("name")).unionByName(
        right.select("shard", "block", nothing.alias("value"), "ref_id", "name")
    )
    each = both.groupBy("shard", "block").applyInArrow(answer, schema)
    win = F.min(F.when(F.col("ref_id") >= 0, F.struct("distance", "rank", "ref_id"))).alias("w")
    return each.groupBy("value").agg(win).select(
        "value", F.coalesce("w.ref_id", F.lit(-1)).cast("bigint").alias("ref_id"), F.coalesce("w.distance", F.lit(-1)).cast("int").alias("distance")
    )


def _generic_of(entries: DataFrame) -> list[str]:
    """The generic words of the whole list: one count of words; their number is checked, as they go to every task."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, len(w) == 1) for w in map(fold, b["name"]) for x in set(w)]
            yield pd.DataFrame(rows, columns=["word", "single"])

    counts = entries.distinct().mapInPandas(words, "word string, single boolean").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("single"))
    rows = counts.where("n > 1 and not single").limit(GENERIC_WORDS + 1).collect()
    if len(rows) > GENERIC_WORDS:
        raise ValueError(f"the reference list has more than {GENERIC_WORDS} generic words")
    return generic_words((r.word, r.n, r.single) for r in rows)
