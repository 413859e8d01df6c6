"""Turns marked-up texts into clean text that keeps headings, lists, tables, code and formulas apart.

The constructs of a text are rendered to blocks; a block's classifier costs become its
terminal capacities, neighbourhood and a shared container of the document tree become
smoothness edges, and the minimum cut separates content from boilerplate.

Signs of the clean text: `#` headings, `- ` and `1. ` lists, ` | ` between cells, fences of
three back quotes around code, `$` around formulas.

Defined cases: a null text stays null and has no markup; a text without markup comes out
unchanged but for its line ends; a text of boilerplate alone comes out empty.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.markup_scan import LANGUAGE, Construct, languages, scan

#: Documents (about so many, chosen by hash) on which the block classifier is fitted.
SAMPLE_DOCUMENTS = 2_000
#: Weights of the smoothness edges.
ADJACENT, SAME_CONTAINER = 0.7, 0.9
#: Tags that end a block, and those that hold blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu "
    "nav noscript ol p section summary table tbody td tfoot th thead title tr ul document type sequence filename description text page".split()
)
CONTAINERS = frozenset("article aside body div dl footer header html main nav noscript ol section table ul head document text".split())
FURNITURE_TAGS = frozenset("nav footer aside title head script style noscript type sequence filename description".split())
#: Words of page furniture.
FURNITURE = re.compile(
    r"(?i)^(?:home|menu|search|login|sign in|contact|news|investors|filings|share|subscribe|print|back to top|skip to content|previous|next)(?:\s*[|>/·»-]\s*[\w ]{1,20})*$"
    r"|^(?:©|\(c\)|copyright)|powered by|all rights reserved|privacy policy|terms of use|cookie"
)
_BLANK = re.compile(r"[ \t]*(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)]|\([a-z]\))[ \t]+\S")
_SPACES = re.compile(r"[ \t ]+")


@dataclass(slots=True)
class Block:
    kind: str
    text: str
    container: int
    furniture: bool
    links: int
    tags: int
    languages: frozenset[str] = frozenset()


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    buffer: list[str] = field(default_factory=list)
    kind: str = "text"
    stack: list[tuple[str, int]] = field(default_factory=list)
    serial: int = 0
    links: int = 0
    tags: int = 0
    ordinals: list[int] = field(default_factory=list)
    #: languages of the constructs since the last block
    languages: set[str] = field(default_factory=set)

    def flush(self, kind: str = "text") -> None:
        text = "".join(self.buffer)
        if self.kind not in ("code", "formula"):
            text = _SPACES.sub(" ", text)
            text = "\n".join(x.strip() for x in text.split("\n")).strip("\n")
        if text.strip() and text.strip() not in ("#", "-", "|"):
            box = self.stack[-1][1] if self.stack else 0
            self.blocks.append(Block(self.kind, text, box, any(t in FURNITURE_TAGS for t, _ in self.stack), self.links, self.tags, frozenset(self.languages)))
            self.languages.clear()
        self.buffer, self.kind, self.links, self.tags = [], kind, 0, 0

    def whole(self, kind: str, text: str) -> None:
        """A block of its own."""
        self.flush()
        self.kind = kind
        self.buffer = [text]
        self.flush()


def _plain(s: _State, text: str, joined: bool) -> None:
    """Unmarked text: blank lines end blocks, list items stand alone."""
    at = 0
    for m in _BLANK.finditer(text):
        _lines(s, text[at : m.start()], joined)
        s.flush()
        at = m.end()
    _lines(s, text[at:], joined)


def _lines(s: _State, text: str, joined: bool) -> None:
    first = True
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not first:
            if _ITEM.match(line) or s.kind in ("list", "heading", "table"):
                s.flush("list" if _ITEM.match(line) else "text")
            else:
                s.buffer.append(" " if joined else "\n")
        elif not s.buffer and _ITEM.match(line):
            s.kind = "list"
        s.buffer.append(line)
        first = False


def _html_tag(s: _State, c: Construct) -> None:
    name, closing = c.match.group("name").lower(), bool(c.match.group("close"))
    s.tags += 1
    if name == "a" and not closing:
        s.links += 1
    if name == "span" and not closing and "eq" in c.match.group().lower():
        return
    if name not in BLOCK_TAGS:
        return
    if name in ("td", "th"):
        if closing:
            s.buffer.append(" | ")
        return
    s.flush("text")
    if not closing:
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            s.kind = "heading"
            s.buffer.append("#" * int(name[1]) + " ")
        elif name in ("li", "dd", "dt"):
            s.kind = "list"
            if s.ordinals and s.ordinals[-1] >= 0:
                s.ordinals[-1] += 1
                s.buffer.append(f"{s.ordinals[-1]}. ")
            else:
                s.buffer.append("- ")
        elif name == "tr":
            s.kind = "table"
    if name in ("ol", "ul"):
        if closing:
            s.ordinals = s.ordinals[:-1]
        else:
            s.ordinals.append(0 if name == "ol" else -1)
    if name in CONTAINERS or name in FURNITURE_TAGS:
        if closing:
            for i in range(len(s.stack) - 1, -1, -1):
                if s.stack[i][0] == name:
                    del s.stack[i:]
                    break
        elif name not in ("type", "sequence", "filename", "description"):
            s.serial += 1
            s.stack.append((name, s.serial))


def _raw(s: _State, text: str) -> None:
    name = re.match(r"<(\w+)", text).group(1).lower()
    inner = html.unescape(re.sub(r"<[^<>]*>", "", re.sub(r"^<[^<>]*>|</[^<>]*>$", "", text)))
    if name in ("script", "style"):
        return
    if name == "math":
        s.buffer.append(f"${inner.strip()}$")
    elif name in ("pre", "textarea") or "\n" in inner:
        s.whole("code", "```\n" + inner.strip("\n") + "\n```")
    elif name == "code":
        s.buffer.append(f"`{inner}`")
    else:
        s.buffer.append(inner)


def _template(s: _State, text: str) -> None:
    name, *parts = [p.strip() for p in re.split(r"\|(?![^{]*\})", text[2:-2])]
    low = name.lower()
    values = [re.sub(r"^\d+\s*=\s*", "", p) for p in parts]
    if low.startswith(("cite", "ref", "citation")):
        return
    if low in ("code", "source", "syntaxhighlight", "pre"):
        s.whole("code", "```\n" + (values[-1] if values else "") + "\n```")
    elif low in ("math", "formula", "equation"):
        s.whole("formula", f"${values[-1] if values else ''}$")
    else:
        for p in parts:
            key, eq, value = p.partition("=")
            s.flush("table")
            s.buffer.append(f"{key.strip()} | {value.strip()}" if eq else key.strip())
        s.flush()


def _latex_command(s: _State, c: Construct, text: str) -> int:
    """Renders a command; gives where the text goes on."""
    name, at = c.match.group("command"), c.end
    argument = re.compile(r"\s*(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}").match(text, at)
    if name in ("section", "subsection", "subsubsection", "paragraph", "chapter", "title", "part", "subparagraph") and argument:
        level = {"title": 1, "part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(name, 5)
        s.whole("heading", "#" * level + " " + re.sub(r"\\([$%&#_{}])", r"\1", argument.group(1)))
        return argument.end()
    if name in ("cite", "ref", "label", "documentclass", "usepackage", "vspace", "hspace", "includegraphics", "citep", "citet", "bibliography", "pagestyle") and argument:
        return argument.end()
    if name in ("href", "footnote", "url") and argument:
        if name == "href":
            s.links += 1
            return argument.end()
        s.buffer.append(f" ({argument.group(1)})" if name == "footnote" else argument.group(1))
        return argument.end()
    if name == "item":
        s.flush("list")
        if s.ordinals and s.ordinals[-1] >= 0:
            s.ordinals[-1] += 1
            s.buffer.append(f"{s.ordinals[-1]}. ")
        else:
            s.buffer.append("- ")
        return at
    return at


def _latex_rows(text: str) -> list[str]:
    inner = re.sub(r"^\\begin\{\w+\*?\}(?:\{[^{}]*\}|\[[^\]]*\])*|\\end\{\w+\*?\}$", "", text)
    rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", r) for r in inner.split("\\\\")]
    return [re.sub(r"\\([$%&#_{}])", r"\1", " | ".join(x.strip() for x in re.split(r"(?<!\\)&", r))).strip() for r in rows if r.strip()]


def render(text: str, constructs: Sequence[Construct]) -> list[Block]:
    """The blocks of a text whose constructs are given."""
    s, at = _State(), 0
    joined = any(c.kind in ("h_doctype",) or (c.kind == "h_tag" and c.match.group("name").lower() in ("p", "body", "document", "div")) for c in constructs)
    tex = any(c.kind.startswith("x_") for c in constructs)

    def between(a: int, b: int) -> None:
        piece = text[a:b]
        if tex:
            piece = piece.replace("~", " ").replace("{}", "")
            piece = re.sub(r"[{}]", "", piece)
        _plain(s, piece, joined)

    for c in constructs:
        if c.start < at:
            continue
        between(at, c.start)
        at, kind, body = c.end, c.kind, text[c.start : c.end]
        if (language := LANGUAGE[kind]) is not None:
            s.languages.add(language)
        if kind == "h_tag":
            _html_tag(s, c)
        elif kind == "h_raw":
            _raw(s, body)
        elif kind == "h_ref":
            s.buffer.append(html.unescape(body if body.endswith(";") else body + ";"))
        elif kind in ("h_comment", "h_cdata", "h_doctype", "h_cut", "m_reference", "m_footnote", "w_switch"):
            if kind == "h_cut" and c.match.group().lower().startswith("<br"):
                s.flush()
        elif kind == "m_fence":
            lines = body.split("\n")
            s.whole("code", "```\n" + "\n".join(lines[1:-1] if lines[-1].strip()[:1] in ("`", "~") else lines[1:]) + "\n```")
        elif kind == "m_code":
            s.buffer.append("`" + body.strip("`") + "`")
        elif kind == "m_heading":
            s.flush("heading")
            s.buffer.append(body.strip() + " ")
        elif kind == "m_underline":
            if s.buffer:
                lines = "".join(s.buffer).rstrip("\r\n").split("\n")
                s.buffer = ["\n".join(lines[:-1])]
                s.flush("heading")
                s.buffer = [("# " if body.startswith("=") else "## ") + lines[-1]]
                s.flush()
        elif kind == "m_table":
            s.flush("table")
            if not re.fullmatch(r"[\s|:-]+", body):
                s.buffer.append(" | ".join(x.strip() for x in body.strip().strip("|").split("|")))
                s.flush("table")
        elif kind == "m_task":
            continue
        elif kind == "m_link":
            s.links += 1
            s.buffer.append(body[1:-1] if body.startswith("<") else re.sub(r"^!?\[(.*?)\][\[(].*$", r"\1", body, flags=re.S))
        elif kind in ("m_strike", "m_strong", "w_quotes"):
            s.buffer.append(body.strip("~*_'"))
        elif kind == "w_heading":
            level = len(c.match.group("eq"))
            s.whole("heading", "#" * level + " " + body.strip().strip("=").strip())
        elif kind == "w_link":
            target, *label = body[2:-2].split("|")
            s.links += 1
            if target.lower().startswith("category:"):
                continue
            s.buffer.append(label[-1] if label else target)
        elif kind == "w_external":
            s.links += 1
            s.buffer.append(body[1:-1].partition(" ")[2])
        elif kind == "w_template":
            _template(s, body)
        elif kind == "w_table":
            for row in re.split(r"\n\|-[^\n]*", body[2:].removesuffix("|}")):
                cells = [x.strip() for x in re.split(r"\|\||!!|\n[|!]", row) if x.strip() and "=" not in x]
                if cells:
                    s.flush("table")
                    s.buffer.append(" | ".join(cells))
            s.flush()
        elif kind == "x_verbatim":
            env = c.match.group("env")
            if env in ("verbatim", "lstlisting", "minted"):
                s.whole("code", "```\n" + re.sub(r"^\\begin\{\w+\}(?:\[[^\]]*\]|\{[^}]*\})?\n?|\n?\\end\{\w+\}$", "", body) + "\n```")
            elif env in ("tabular", "array"):
                for row in _latex_rows(body):
                    s.flush("table")
                    s.buffer.append(row)
                s.flush()
            else:
                s.whole("formula", "$" + re.sub(r"^\\begin\{\w+\*?\}|\\end\{\w+\*?\}$", "", body).strip() + "$")
        elif kind == "x_math":
            inner = re.sub(r"^(?:\$\$?|\\[\[(])|(?:\$\$?|\\[\])])$", "", body).strip()
            if body.startswith(("$$", "\\[")):
                s.whole("formula", f"${inner}$")
            else:
                s.buffer.append(f"${inner}$")
        elif kind == "x_env":
            s.flush()
            name = body[body.index("{") + 1 : body.index("}")]
            if name in ("itemize", "enumerate", "description"):
                if body.startswith("\\begin"):
                    s.ordinals.append(0 if name == "enumerate" else -1)
                else:
                    s.ordinals = s.ordinals[:-1]
        elif kind == "x_command":
            at = _latex_command(s, c, text)
        elif kind == "x_sign":
            s.buffer.append(body[1:])
        else:
            s.buffer.append(body)
    between(at, len(text))
    s.flush()
    if s.languages and s.blocks:  # marks behind the last block are its own
        s.blocks[-1].languages |= s.languages
    return s.blocks


def features(blocks: Sequence[Block]) -> np.ndarray:
    """One row per block: what tells content from boilerplate."""
    n = len(blocks)
    rows = np.zeros((n, 9))
    for i, b in enumerate(blocks):
        words = b.text.split()
        w = max(1, len(words))
        rows[i] = (
            1.0,
            math.log1p(len(b.text)) / 5,
            b.text.rstrip().endswith((".", "!", "?", ":", ";")),
            sum(1 for x in words if x[:1].isupper()) / w,
            min(3.0, b.links / w * 5),
            b.furniture,
            b.kind in ("code", "formula", "table", "heading", "list"),
            b.kind == "text" and w < 6 and any(x in "|>©·»" for x in b.text),
            min(i, n - 1 - i) == 0 and w < 8 and b.kind == "text",
        )
    return rows


def weak_label(block: Block) -> int | None:
    """1 boilerplate, 0 content, None unsure."""
    if block.furniture or (len(block.text) < 120 and FURNITURE.search(block.text)):
        return 1
    if block.kind != "text" or (len(block.text.split()) >= 8 and block.text.rstrip().endswith(".")):
        return 0
    return None


def fit(texts: Sequence[str], ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the block classifier: logistic regression by Newton steps on weakly labelled blocks."""
    xs, ys = [], []
    for t in texts:
        if constructs := scan(t):
            blocks = render(t, constructs)
            labels = [weak_label(b) for b in blocks]
            x = features(blocks)
            keep = [i for i, y in enumerate(labels) if y is not None]
            xs.append(x[keep])
            ys.append(np.array([labels[i] for i in keep], dtype=float))
    if not xs or not sum(map(len, ys)):
        return np.array([-3.0, 0, 0, 0, 0, 6.0, 0, 4.0, 0])
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def minimum_cut(surplus: Sequence[float], adjacent: float, arcs: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; the least cut is as great as the greatest flow.

    surplus > 0 is a capacity from the source, < 0 one to the sink; neighbours hold together by `adjacent`, and
    each arc (a, b, w), a < b, in order of b, by w. Arcs of containers never cross, so the network of blocks is
    series-parallel: a node between two others is replaced by one edge that carries its best side for each of
    theirs, which is exact and takes time in proportion to the blocks, where augmenting paths would take a
    search for each unit of flow.
    """
    n = len(surplus)
    if n == 0:
        return []
    # cost of a node on the sink's and on the source's side
    own = [(max(x, 0.0), max(-x, 0.0)) for x in surplus]
    # edge tables: the cost of (left, right) sides 00, 01, 10, 11
    stack: list[tuple[int, tuple[float, float, float, float]]] = [(0, (0.0, 0.0, 0.0, 0.0))]
    gone: list[tuple[int, int, int, tuple[bool, bool, bool, bool]]] = []

    def merge() -> None:
        right, t = stack.pop()
        mid, s = stack.pop()
        left = stack[-1][0]
        off, on = own[mid]
        table, choice = [], []
        for x in (0, 1):
            for y in (0, 1):
                a, b = s[2 * x] + off + t[y], s[2 * x + 1] + on + t[2 + y]
                table.append(min(a, b))
                choice.append(b <= a)
        gone.append((mid, left, right, tuple(choice)))
        stack.append((right, tuple(table)))

    k = 0
    for i in range(1, n):
        stack.append((i, (0.0, adjacent, adjacent, 0.0)))
        while k < len(arcs) and arcs[k][1] == i:
            a, _, w = arcs[k]
            while stack[-2][0] != a:
                merge()
            t = stack[-1][1]
            stack[-1] = (i, (t[0], t[1] + w, t[2] + w, t[3]))
            k += 1
    while len(stack) > 2:
        merge()
    side = [True] * n
    if len(stack) == 2:
        last, t = stack[1]
        _, x, y = min((own[0][x] + t[2 * x + y] + own[last][y], -x, -y) for x in (0, 1) for y in (0, 1))
        side[0], side[last] = x < 0, y < 0
    else:
        side[0] = own[0][1] <= own[0][0]
    for mid, left, right, choice in reversed(gone):
        side[mid] = choice[2 * side[left] + side[right]]
    return side


def content(blocks: Sequence[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content: the minimum cut of the classifier's costs and the smoothness edges."""
    if not blocks:
        return []
    score = np.clip(features(blocks) @ weights, -8, 8)  # log odds of boilerplate
    arcs = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.container and b.container in last:
            arcs.append((last[b.container], i, SAME_CONTAINER))
        last[b.container] = i
    return minimum_cut((-score).tolist(), ADJACENT, arcs)


def clean(text: str, constructs: Sequence[Construct], weights: np.ndarray) -> tuple[str, int, int, list[str]]:
    """The clean text, the numbers of blocks and of those cut as boilerplate, and the languages met.

    Languages are those of the blocks that the cut keeps; a text that is boilerplate as a whole, or has no block, has those of all its constructs.
    """
    blocks = render(text, constructs)
    keep = content(blocks, weights)
    kept = sorted({x for b, ok in zip(blocks, keep) if ok for x in b.languages})
    out: list[str] = []
    before = None
    for b, ok in zip(blocks, keep):
        if ok:
            if out:
                out.append("\n" if b.kind == before and b.kind in ("list", "table") else "\n\n")
            out.append(b.text.rstrip(" |") if b.kind == "table" else b.text)
            before = b.kind
    return "".join(out), len(blocks), len(keep) - sum(keep), kept if any(keep) else languages(constructs)


def sample_weights(df: DataFrame, key: str, text: str, documents: int = SAMPLE_DOCUMENTS) -> np.ndarray:
    """The block classifier, fitted on about `documents` whole documents chosen by hash (a bounded sample, read one by one)."""
    share = min(1.0, documents / max(1, df.count()))
    chosen = df.where((F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)) & F.col(text).isNotNull())
    return fit([r[0] for r in chosen.select(text).limit(2 * documents).toLocalIterator()])


def clean_markup(df: DataFrame, key: str, text: str, weights: np.ndarray | None = None, with_text: bool = True) -> DataFrame:
    """(key, markup, n_blocks, n_boilerplate[, clean_text]): one row per row of df; markup lists the languages met."""
    w = sample_weights(df, key, text) if weights is None else weights
    names = [key, "markup", "n_blocks", "n_boilerplate"] + ["clean_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                marks, blocks, cut, texts = [], [], [], []
                for t in part.column(1).to_pylist():
                    constructs = scan(t) if t else []
                    found, n, m = [], 0, 0
                    if any(LANGUAGE[c.kind] for c in constructs):
                        t, n, m, found = clean(t, constructs, w)
                    elif t and "\r" in t:
                        t = t.replace("\r\n", "\n").replace("\r", "\n")
                    marks.append(found)
                    blocks.append(n)
                    cut.append(m)
                    texts.append(t)
                columns = [part.column(0), pa.array(marks, pa.list_(pa.string())), pa.array(blocks, pa.int32()), pa.array(cut, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, markup array<string>, n_blocks int, n_boilerplate int" + ", clean_text string" * with_text)
