"""Detects templates left unfilled, filler, error pages and notices that ask for scripts.

A regularized linear classifier decides. Its rows are windows of a text's units (lines and
sentences, program code and tags left out); its features are hashed n-grams of letters,
of exact signs and of shapes (a run of small letters, capitals or digits counts as one
sign), the lengths of window and document, and whether the unit is the title. It has two
heads, slots and pages (error pages, notices, filler). It is fitted on weak labels
(response-status lines, phrases and slot forms) of a bounded sample of documents; the
lists of labels take no part in a decision. Hosts are the issuers (cik), as the documents
name no other, and the held-out figures are of unseen ones.

A document is excluded if a window of it holds a slot, or if a unit of it is of a page
and at most one unit of real text (neither residue nor page furniture) stands beside.

Defined cases: null, empty and blank texts are no residue; a text is excluded as a whole
or not at all; a document without a host is a host of its own key; without any labelled
unit in the sample nothing is excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.markup_scan import HTML_NAMES, scan

#: Bounds of the fit: documents (about so many, chosen by hash) whose units are labelled, and one of so many of their unlabelled windows.
SAMPLE_DOCUMENTS, NEGATIVE_SHARE = 20_000, 16
#: One of so many hosts is held out.
HELD_OUT = 5
#: Hash bits of the n-grams, lengths of the letter n-grams and of the shape n-grams, and of the exact ones.
BITS = 17
LETTERS, SHAPES, EXACT = 5, (3, 5), 3
#: Letters of a window and of what it shares with the one before; most weight of a labelled row.
WINDOW, OVERLAP, MOST_WEIGHT = 160, 60, 5.0
#: Steps of the fit.
STEPS = 150

# --- fixed values: the forms and phrases of the weak labels -------------------

#: Names of the fields that templates have slots for.
FIELD_WORDS = (
    "address amount bank city client commodity company contact contract cost counterparty country county currency customer date day director effective email employer event exhibit field "
    "figure filing first fiscal full growth growth_rate holder insert issuer item jurisdiction last location month name number office of officer owner party percent percentage period "
    "person phone place plant position price product project quantity quarter rate ratio recipient region registrant sector segment sender share shares signatory signature site source state "
    "street subject subsidiary supplier term text the ticker time title total town type unit units value vendor year your zip count per here an a"
).split()
_FIELD = r"(?:" + "|".join(sorted(FIELD_WORDS, key=len, reverse=True)) + r")"
_FIELDS = rf"{_FIELD}(?:[ _-]{_FIELD}){{0,4}}"
#: Slots: each form of a place that a template leaves to be filled.
SLOTS = (
    r"\{\{[ \t]*[A-Za-z_][\w.]*[ \t]*\}\}",
    r"\{%[ \t]*\w+[ \t]*%\}",
    r"<%=?[ \t]*\w+[ \t]*%>",
    r"%%\w+%%",
    r"@@\w+@@",
    rf"(?<![\w%])%(?:(?i:{_FIELD})_?){{1,4}}%(?!\w)",
    r"[$#]\{[A-Za-z_ .]+\}",
    r"<<[A-Za-z][\w ]*>>|&lt;&lt;[A-Za-z][\w ]*&gt;&gt;",
    rf"«(?i:{_FIELDS})»",
    rf"(?<![\w*}}\]\\$#{{_^])\{{(?i:{_FIELDS})\}}(?!\}})",
    rf"<(?i:{_FIELD}(?: {_FIELD}){{1,4}})>|<(?:COMPANY|DATE|NAME|AMOUNT|CITY|ISSUER|REGISTRANT|NUMBER)>",
    r"\[(?i:insert|enter|your|add|fill in)\b[^\[\]\n]{0,60}\](?![(\[])",
    r"\[[^\[\]\n]{0,60}\b(?i:to be (?:completed|inserted|determined|supplied|added|confirmed|filled|provided))\b[^\[\]\n]{0,60}\]",
    r"\[(?:TK|TBD|TBC|TODO|TBA|XX+|#+|\?+|[●•■▪_]+|\.{4,})\]",
    r"\[[^\[\]\n]{0,40}\b(?:TBD|TBC)\b[^\[\]\n]{0,40}\]",
    r"\[(?i:confirm|change|check|verify|update|replace)\]",
    rf"(?<![\]\[!\w])\[(?i:{_FIELDS})\](?![(\[:])",
    r"(?<![\w\]\[])\[[ \t ]{1,12}\](?![(\[:])",
    r"(?<!_)_{4,}",
    r"\b(?:X{1,3},XXX|X{1,3}\.X{1,2}|XX+%|XX/XX/(?:20)?XX|X{3,}-X{2,})(?![A-Za-z0-9])|(?<=[$€£])X+\b",
    r"\b(?:MM[/.-]DD[/.-]YYYY|DD[/.-]MM[/.-]YYYY|YYYY[/-]MM[/-]DD|20__)\b",
    r"\b(?:FIRST ?NAME|LAST ?NAME|FIRSTNAME LASTNAME|COMPANY NAME|YOUR NAME|YOUR COMPANY)\b",
    r"\bABC (?:Company|Corp|Inc)\b",
)
#: Answers of servers and programs.
ERRORS = (
    r"^(?:HTTP/\d(?:\.\d)? )?[45]\d\d(?: [A-Z][\w'-]*){1,4}\b(?=\W*$|[ ]?[\d(.]|\W{0,3}\n)",
    r"^(?:Error|Erreur|Fehler|Errore|Erro)\s*[:#]?\s*[45]\d\d\b",
    r"^X-[\w-]+: |^Reference #|^Code \d",
    r"^\{\s*\"?(?:error|errors|status|message)\"?\s*:",
    r"^Traceback \(most recent call last\)|^\s*File \"[^\"]+\", line \d+|^[A-Z]\w{0,60}(?:Error|Exception): ",
    r"^(?:[a-z]\w{0,40}\.){1,10}[A-Z]\w{0,60}(?:Exception|Error)\b|^\s*at (?:[A-Za-z]\w*\.)+\w+\(",
    r"^(?:The )?requested (?:document|page|url|resource|file) .* (?:not found|could not be found|does not exist)|was not found on this server",
    r"^Page not found\b|^We (?:couldn't|could not|can't|cannot) find |^It may have been moved or deleted|^Return to home",
    r"^Access denied\b|^You (?:don't|do not) have permission to access|^(?:403 )?Forbidden\b",
    r"^(?:Service|Site|Server|Page) (?:temporarily )?unavailable|^Please try again (?:in|later)|^(?:The )?(?:request|connection|gateway) (?:has )?timed out|^Gateway time-?out|^Bad gateway",
    r"^Too many re(?:directs|quests)|^(?:Request )?rate (?:limit )?exceeded|^Your address has been (?:limited|blocked)",
    r"^Internal server error|^The server (?:met|encountered) an unexpected|^An? (?:unexpected|internal) error (?:has )?occurred|une erreur interne est survenue|^Ein interner Fehler|^Se ha producido un error",
    r"^Error establishing a database connection|^Database error|^Fatal error|^Warning: \w+\(\)",
    r"^Your session (?:has )?(?:expired|timed out)|^Please (?:sign|log) in (?:again )?to continue|^Session expired",
    r"^No se ha encontrado la página|^Página no encontrada|^Vuelva al inicio|^Seite nicht gefunden|^Die Adresse .* existiert nicht|^Page (?:introuvable|non trouvée)|^La page .* (?:n'existe|est introuvable)",
)
#: Notices that scripts, cookies or a check of the browser are required.
NOTICES = (
    r"(?:^|, |and |to )(?:please )?(?:enable|activate|allow|turn on|switch on) (?:javascript|scripts?|scripting|cookies)\b",
    r"^You need to enable JavaScript|javascript is (?:disabled|not enabled|required|turned off)|without javascript enabled|^We're sorry but .* without JavaScript",
    r"\b(?:scripts?|javascript|cookies) (?:to be |must be |are |is )?(?:turned|switched) (?:on|off)\b|^Turn (?:them|it) on and reload",
    r"^(?:Veuillez activer|Active|Activez|Habilite|Bitte aktivieren Sie|Por favor,? active|Attivare) (?:le )?JavaScript",
    r"^Checking your browser|^This (?:process|check)? ?takes up to \d+ seconds|^Verifying (?:that )?you are (?:a )?human|^Please (?:complete|verify) .*(?:captcha|human)|^DDoS protection by",
    r"^Your browser does not support|^Enable scripting or update it|^If nothing happens, your browser|browser may be blocking scripts|^Loading\W*$|^Please wait while",
)
#: Copy that stands for a text still to be written.
FILLER = (
    r"(?i)\b([a-z]{2,12}(?: [a-z]{2,12})?)(?:[\s.,;]+\1\b){3,}",
    r"\blorem ipsum (?:dolor|[A-Z])|^lorem ipsum\b",
    r"^Click (?:here )?to add |^(?:Title|Item|Heading|Subtitle|Bullet|Paragraph|Body|Text|Slide|Section|Caption)(?: (?:one|two|three|four|five|text|\d+|goes here|here|title))+\W*$|^Text here\W*$",
    r"^(?:\W*)[Yy]our \w+(?: \w+)? goes here|\bgoes here\b\W*$",
    r"^This is (?:placeholder|dummy|sample|filler|test) (?:copy|text|content|data)|^(?:Sample|Dummy|Placeholder|Test|Filler) (?:text|copy|content|filing body|paragraph|body)\b|^Replace this (?:paragraph|text|section) with",
    r"^(?:Content|Page|Site|Text|More|Details)?\W*(?:is )?coming soon\W*(?:v\d+)?\W*$|^(?:This page is )?under construction\W*$|^(?:To be (?:written|completed|added)|Intentionally left blank)\W*$|^TO ?DO\b\W*$|^Test(?: test)*\W*$",
)
#: Words of the usual pretended Latin.
LATIN = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo "
    "consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
#: Furniture of pages, which is neither residue nor text.
FURNITURE = re.compile(r"(?i)^(?:home|menu|search|news|investors|contact|filings|login|about)(?:\s*[|>/·-]\s*\w+)*\W*$|^powered by|^©|^\(c\) |^copyright|^all rights reserved|^n\.a\.$|^/s/")

def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


# patterns of a unit's beginning are matched there only; the others are searched where one of their words is
_ALL = [b for p in (*ERRORS, *NOTICES) for b in _branches(p)]
_BEGIN = re.compile("|".join(b for b in _ALL if b.startswith("^")), re.I)
_INSIDE = re.compile("|".join(b for b in _ALL if not b.startswith("^")), re.I)
_INSIDE_WORDS = ("script", "cookie", "server", "erreur")
FILL = [re.compile(p, re.I if i not in (1,) else 0) for i, p in enumerate(FILLER)]
#: Signs of which a text with a slot of each form has one.
_SLOT_SIGNS = (
    ("{{",), ("{%",), ("<%",), ("%%",), ("@@",), ("%",), ("${", "#{"), ("<<", "&lt;&lt;"), ("«",), ("{",), ("<",), ("[",), ("[",), ("[",), ("[",), ("[",), ("[",), ("[",), ("____",),
    ("X",), ("MM", "YYYY", "20__"), ("NAME", "YOUR"), ("ABC",),
)
_SLOT_PATTERNS = [(signs, re.compile(p)) for signs, p in zip(_SLOT_SIGNS, SLOTS, strict=True)]


def find_slot(text: str) -> re.Match | None:
    for signs, pattern in _SLOT_PATTERNS:
        for sign in signs:
            if sign in text:
                if m := pattern.search(text):
                    return m
                break
    return None


def is_residue(unit: str) -> bool:
    """Whether a unit is of an error page or notice."""
    if _BEGIN.match(unit):
        return True
    low = unit.lower()
    return any(w in low for w in _INSIDE_WORDS) and bool(_INSIDE.search(unit))


_TAGS = re.compile(rf"<!--[^<>]*-->|(?<!<)</?(?:(?i:{'|'.join(HTML_NAMES)})\b|!)[^<>\n]*>(?!>)")
_UNIT = re.compile(r"[\r\n]+|(?<=[.!?…。])[\"”’)]*\s+(?=[^a-z\s])")
_ABBREVIATIONS = ("Inc.", "Corp.", "Ltd.", "Co.", "No.", "Mr.", "Ms.", "Dr.", "St.", "vs.")
_ABBREVIATION = re.compile(r"\b(?:Inc|Corp|Ltd|Co|No|Mr|Ms|Dr|St|vs)\.$")
_CODE_LINE = re.compile(r"(?m)^(?: {4}|\t)[^\n]*$|^[ \t]*(?:export \w+=|python \S+\.py|SELECT\b|for \(|def \w+\(|return \[)[^\n]*$")
#: Words from which a unit counts as real text, and how many such units may stand beside residue.
REAL_WORDS, MOST_REAL = 5, 1
_TASK = re.compile(r"(?m)^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\[[ xX]\](?=[ \t])")
_LATIN_WORD = re.compile(r"[A-Za-z]+")


def units(text: str) -> list[str]:
    """The lines and sentences of a text, without tags; a sentence isn't cut behind an abbreviation."""
    out: list[str] = []
    glue = False
    for part in _UNIT.split(_TAGS.sub(" ", text)):
        part = part.strip()
        if not part:
            continue
        if glue:
            out[-1] += " " + part
        else:
            out.append(part)
        glue = part.endswith(_ABBREVIATIONS) and bool(_ABBREVIATION.search(part[-8:]))
    return out


def is_filler(unit: str) -> bool:
    if any(p.search(unit) for p in FILL):
        return True
    words = _LATIN_WORD.findall(unit.lower())
    return len(words) >= 4 and sum(w in LATIN for w in words) >= max(2, 0.3 * len(words))


def without_code(text: str) -> str:
    """The text with program code, formulas and templates blanked, so that only slots of the text itself remain."""
    parts, at = [], 0
    for c in scan(text):
        body = text[c.start : c.end]
        code = c.kind in ("m_fence", "x_verbatim", "x_math", "m_reference", "m_footnote", "w_external", "h_comment") or (
            c.kind == "h_raw" and body[1:4].lower() in ("pre", "cod", "scr", "sty", "mat", "tex")
        )
        code = code or (c.kind == "m_code" and bool(re.search(r"[=(;]", body))) or (c.kind == "w_template" and bool(re.match(r"\{\{\s*(?i:code|source|math|cite|syntaxhighlight)", body)))
        if code and c.start >= at:
            parts += [text[at : c.start], " "]
            at = c.end
    masked = "".join([*parts, text[at:]])
    return _TASK.sub("- ", _CODE_LINE.sub(" ", masked))


@dataclass(slots=True)
class Row:
    """A window of a unit: its text, the unit's number, and whether the unit is real text unless it is residue."""

    text: str
    unit: int
    real: bool


_CODE_SIGNS = re.compile(r"[`\\$<{\[]")


def rows_of(text: str) -> list[Row]:
    """The windows of a text's units, program code left out."""
    masked = without_code(text) if _CODE_SIGNS.search(text) else _CODE_LINE.sub(" ", text)
    return [Row(w, i, len(u.split()) >= REAL_WORDS and not FURNITURE.match(u)) for i, u in enumerate(units(masked)) for w in windows(u)]


def weak_labels(window: str) -> tuple[bool, bool]:
    """The weak labels of a window: a slot; a status line, phrase or filler."""
    return find_slot(window) is not None, is_residue(window) or is_filler(window)


# --- the classifier ----------------------------------------------------------

_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_LOW[48:58] = 48
_EXACT = np.arange(256, dtype=np.uint32)
_EXACT[48:58] = 48
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[97:123] = 97
_SHAPE[0xC3:0xE0] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
#: Signs of which a run counts as one.
_RUNS = np.zeros(256, bool)
_RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]] = True
_SIZE = 1 << BITS
_EXTRA = (2 + len(SHAPES)) * _SIZE
DIMENSIONS = _EXTRA + 64
HEADS = ("slot", "page")


def windows(unit: str) -> list[str]:
    """A unit, cut where it is longer than a window; each window begins OVERLAP letters before the last one's end."""
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - OVERLAP, WINDOW - OVERLAP)]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    if len(codes) < n:
        return np.zeros(0, np.int64)
    h = codes[: len(codes) - n + 1].copy()
    for i in range(1, n):
        h = h * np.uint32(0x01000193) + codes[i : len(codes) - n + 1 + i]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _bucket(n: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(np.int64), most)


def _streams(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first feature, hash of each n-gram, whether it lies in one text, the row each text begins at) per kind of n-gram."""
    raw = [b"\n" + t.encode("utf-8", "replace") + b"\n" for t in texts]
    buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
    length = np.array([len(r) for r in raw], dtype=np.int64)
    row = np.repeat(np.arange(len(raw), dtype=np.int32), length)
    starts = np.cumsum(length) - length
    shape = _SHAPE[buffer]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[buffer[1:]]
    short, short_row = shape[keep], row[keep]
    short_starts = np.searchsorted(short_row, np.arange(len(raw)))
    kinds = [(_LOW[buffer], LETTERS, row, starts), *((short, n, short_row, short_starts) for n in SHAPES), (_EXACT[buffer], EXACT, row, starts)]
    for k, (codes, n, rows, first) in enumerate(kinds):
        h = _grams(codes, n)
        inside = np.zeros(len(rows), bool)
        inside[: len(h)] = rows[: len(h)] == rows[n - 1 :]
        yield k * _SIZE, np.pad(h, (0, len(rows) - len(h))), inside, first


def _lengths(texts: Sequence[str], sizes: Sequence[int], titles: Sequence[bool]) -> list[np.ndarray]:
    """The features of each text that aren't n-grams: its length, its document's, and whether it is the title."""
    own = np.array([len(t.encode("utf-8", "replace")) + 2 for t in texts], dtype=np.int64)
    return [_EXTRA + _bucket(own, 15), _EXTRA + 16 + _bucket(np.array(sizes, dtype=np.int64), 19), _EXTRA + 40 + np.array(titles, dtype=np.int64)]


def featurize(texts: Sequence[str], sizes: Sequence[int], titles: Sequence[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of the hashed n-grams of letters, shapes and exact signs, the lengths of window and document, and the title."""
    features, where = [], []
    every = np.arange(len(texts))
    for offset, h, inside, first in _streams(texts):
        row = np.repeat(every, np.diff(np.append(first, len(h))))
        features.append(offset + h[inside])
        where.append(row[inside])
    extra = _lengths(texts, sizes, titles)
    return np.concatenate([*features, *extra]), np.concatenate([*where, *[every] * len(extra)])


@dataclass
class Model:
    """Weights and bias of each head; a window is of the head's kind where its score is above 0."""

    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: Sequence[str], sizes: Sequence[int], titles: Sequence[bool]) -> np.ndarray:
        """One row per text, one column per head."""
        if not len(texts):
            return np.zeros((0, len(HEADS)))
        by_feature = np.ascontiguousarray(self.weights.T, dtype=np.float32)
        total = np.tile(self.bias, (len(texts), 1))
        for offset, h, inside, first in _streams(texts):
            w = by_feature[offset : offset + _SIZE].take(h, axis=0)
            w[~inside] = 0
            total += np.add.reduceat(w, first, axis=0)
        for f in _lengths(texts, sizes, titles):
            total += by_feature[f]
        return total


def fit_head(feature: np.ndarray, row: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 4096, ridge: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, float]:
    """Logistic regression with per-weight steps over shuffled batches of rows; the rarer class weighs as much as the other, up to MOST_WEIGHT."""
    n = len(y)
    order = np.argsort(row, kind="stable")
    feature = feature[order]
    first = np.searchsorted(row[order], np.arange(n + 1))
    positive = max(1.0, y.sum())
    weight = np.where(y > 0, min(MOST_WEIGHT, max(1.0, (n - positive) / positive)), 1.0)
    w, squares, bias = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8), 0.0
    random = np.random.default_rng(seed)
    for _ in range(-(-steps // -(-n // batch))):
        places = random.permutation(n)
        for a in range(0, n, batch):
            rows = places[a : a + batch]
            count = first[rows + 1] - first[rows]
            at = np.repeat(first[rows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            f, local = feature[at], np.repeat(np.arange(len(rows)), count)
            z = np.bincount(local, weights=w[f], minlength=len(rows)) + bias
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            error /= weight[rows].sum()
            g = np.bincount(f, weights=error[local], minlength=DIMENSIONS) + ridge * w
            squares += g * g
            w -= 0.1 * g / np.sqrt(squares)
            bias -= 0.3 * error.sum()
    return w, bias


def fit(texts: Sequence[str], labels: np.ndarray, sizes: Sequence[int], titles: Sequence[bool]) -> Model:
    """labels: one column per head."""
    feature, row = featurize(texts, sizes, titles)
    heads = []
    for k, head in enumerate(HEADS):
        # a slot is known by its shape: letters would only name the slots that were labelled
        own = feature >= _SIZE if head == "slot" else np.ones(len(feature), bool)
        heads.append(fit_head(feature[own], row[own], labels[:, k].astype(float)) if labels[:, k].any() else (np.zeros(DIMENSIONS), -1.0))
    return Model(np.array([w for w, _ in heads], dtype=np.float32), np.array([b for _, b in heads]))


def decide(model: Model, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(excluded, score) of each text; the score is the greatest of its windows and heads."""
    per = [rows_of(t) for t in texts]
    flat = [r for rows in per for r in rows]
    count = np.array([len(rows) for rows in per], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)[doc]
    unit = np.array([r.unit for r in flat], dtype=np.int64)
    z = model.scores([r.text for r in flat], sizes, unit == 0)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, z.max(axis=1, initial=-np.inf))
    slot = np.bincount(doc, weights=z[:, 0] > 0, minlength=len(texts)) > 0
    # windows of a unit: it is of a page if one of them is
    head = np.ones(len(flat), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1])
    number = np.cumsum(head) - 1
    page = np.bincount(number, weights=z[:, 1] > 0, minlength=int(head.sum())) > 0
    owner, real = doc[head], np.array([r.real for r in flat], dtype=bool)[head]
    residue_units = np.bincount(owner, weights=page, minlength=len(texts))
    real_units = np.bincount(owner, weights=real & ~page, minlength=len(texts))
    return slot | ((residue_units > 0) & (real_units <= MOST_REAL)), best


def labelled_rows(df: DataFrame, key: str, text: str, host: Column, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(window, slot, page, size, title, held_out) of a bounded sample of documents: each labelled window, and one of NEGATIVE_SHARE others."""
    share = min(1.0, documents / max(1, df.count()))
    h = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(1_000_000))
    held = F.pmod(F.xxhash64(F.coalesce(host.cast("string"), F.col(key).cast("string"))), F.lit(HELD_OUT)) == 0
    chosen = df.select(F.col(text).alias("text"), h.alias("h"), held.alias("held")).where((F.col("h") < int(share * 1_000_000)) & F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, h, held in zip(b["text"], b["h"], b["held"]):
                for i, r in enumerate(rows_of(t)):
                    slot, page = weak_labels(r.text)
                    if slot or page or (int(h) + i) % NEGATIVE_SHARE == 0:
                        rows.append((r.text, slot, page, len(t), r.unit == 0, bool(held)))
            yield pd.DataFrame(rows, columns=["window", "slot", "page", "size", "title", "held_out"])

    return chosen.mapInPandas(run, "window string, slot boolean, page boolean, size int, title boolean, held_out boolean")


def train(df: DataFrame, key: str, text: str, host: Column, documents: int = SAMPLE_DOCUMENTS) -> tuple[Model, list[dict]]:
    """The model, fitted on the windows of hosts not held out, and its figures on both parts."""
    rows = labelled_rows(df, key, text, host, documents).toPandas()
    # the order of tasks must not matter
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    own = rows[~rows["held_out"]]
    labels = list(HEADS)
    model = fit(own["window"].tolist(), own[labels].to_numpy(dtype=bool).reshape(-1, 2), own["size"].tolist(), own["title"].tolist())
    figures = []
    for name, part in (("fitted", own), ("unseen hosts", rows[rows["held_out"]])):
        z = model.scores(part["window"].tolist(), part["size"].to_numpy(), part["title"].to_numpy(dtype=bool))
        for k, head in enumerate(labels):
            y, sure = part[head].to_numpy(dtype=bool), z[:, k] > 0
            figures.append({
                "part": name, "head": head, "n_windows": len(part), "n_labelled": int(y.sum()),
                "precision": float((sure & y).sum() / max(1, sure.sum())), "recall": float((sure & y).sum() / max(1, y.sum())),
            })
    return model, figures


def residue(df: DataFrame, key: str, text: str, host: Column, model: Model | None = None) -> DataFrame:
    """(key, score): the documents to exclude, with the greatest score of their windows."""
    fitted = model if model is not None else train(df, key, text, host)[0]
    weights = df.sparkSession.sparkContext.broadcast(fitted.weights)  # 2 x DIMENSIONS numbers
    bias = fitted.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights.value, bias)
        for b in batches:
            for part in _portions(b):
                out, score = decide(m, part.column(1).to_pylist())
                keep = pa.array(np.flatnonzero(out), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), pa.array(score[out], pa.float64())], names=[key, "score"])

    kind = df.schema[key].dataType.simpleString()
    written = df.select(key, text).where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)\S"))
    return written.mapInArrow(run, f"`{key}` {kind}, score double")


def _portions(batch: pa.RecordBatch, rows: int = 256, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows and about so many letters (a longer text stands alone)."""
    at = total = 0
    lengths = [len(t) for t in batch.column(1).to_pylist()]
    for i, n in enumerate(lengths):
        if i > at and (i - at == rows or total + n > size):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)
