"""Finds the constructs of HTML, Markdown, wiki and LaTeX markup in a text.

One left-to-right pass over one pattern: a construct that is taken whole (a comment, a
code block, a template, a formula) hides what stands inside it from the other languages.
"""

from __future__ import annotations

import html.entities
import re
from dataclasses import dataclass

#: Element names of HTML, and of the header of filings.
HTML_NAMES = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog "
    "dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "map mark menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q ref rp rt ruby s samp script section select small source "
    "span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr "
    "nowiki math document type sequence filename description text page"
).split()
#: Switches of wiki pages.
WIKI_SWITCHES = "NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC INDEX NOINDEX STATICREDIRECT DISAMBIG".split()
#: References that are also read without their semicolon.
OPEN_REFERENCES = ("nbsp", "amp", "lt", "gt", "quot")
REFERENCES = frozenset(k[:-1] for k in html.entities.html5 if k.endswith(";"))

_NAME = "(?:" + "|".join(sorted(HTML_NAMES, key=len, reverse=True)) + r"|[A-Za-z][\w.-]*:[A-Za-z][\w.-]*)"
_ATTR = r"""[\w:.-]+(?:\s*=\s*(?:"[^"\n]*"|'[^'\n]*'|[^\s<>"'=]+))?"""
_URL = r"https?://[^\s\]|}]+"
_INNER = r"(?:[^{}]|\{[^{}]*\}|\{\{[^{}]*\}\})*"

_LINE = r"(?:^|(?<=^ )|(?<=^  )|(?<=^   ))"
_FULL = r"[ \t]*(?=\r?$)"
_UNDER = r"(?:(?<=[^\s|=-]\n)|(?<=[^\s|=-]\r\n)|(?<=[^\s|=-] \n))"

#: kind, language (None: no markup), first letters, pattern; of those with the letter found, the first that fits counts.
RULES: tuple[tuple[str, str | None, str, str], ...] = (
    ("h_comment", "html", "<", r"<!--.*?-->"),
    ("h_comment", "html", "<", r"<!--[^\n]*"),
    ("h_cdata", "html", "<]", r"<!\[CDATA\[|\]\]>"),
    ("h_doctype", "html", "<", r"<!(?i:doctype)\b[^<>\n]*>?"),
    ("h_raw", "html", "<", r"<(?P<raw>(?i:script|style|pre|textarea|svg|math|code|nowiki))\b[^<>]*>.*?</(?i:(?P=raw))\s*>"),
    ("slot", None, "<", r"<<[^<>\n]{1,60}>>|<%[^%\n]{0,80}%>"),
    ("h_tag", "html", "<", rf"(?<!<)<(?P<close>/?)(?P<name>(?i:{_NAME}))(?:\s[^<>]*|/)?>(?!>)"),
    ("h_cut", "html", "<", rf"(?<!<)<(?i:{_NAME})(?:\s+{_ATTR})+\s*(?=\n|\r|\Z)|(?<!<)</(?i:{_NAME})[ \t]*(?=\n|\r|\Z)"),
    ("h_ref", "html", "&", r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&(?P<ref>[A-Za-z][A-Za-z0-9]{1,31});|(?<![?=/])&(?:" + "|".join(OPEN_REFERENCES) + r")(?![;=])"),
    ("slot", None, "{$#[%@", r"\{%[^%\n]{0,80}%\}|\{\{[ \t]*[\w.]+[ \t]*\}\}|[$#]\{[^{}\n]{0,60}\}|\[\*+\]|%%\w+%%|@@\w+@@"),
    ("m_fence", "markdown", "`~", rf"{_LINE}(?P<fence>`{{3,}}|~{{3,}})[^\n`]*\n(?:.*?^[ ]{{0,3}}(?P=fence){_FULL}|.*\Z)"),
    ("m_code", "markdown", "`", r"(?<![`\\])(?P<tick>`{1,2})(?!`)[^`\n]+(?P=tick)(?!`)"),
    ("x_verbatim", "latex", "\\", r"\\begin\{(?P<env>verbatim|lstlisting|minted|equation|align|gather|displaymath|math|tabular|array|eqnarray)(?P<star>\*?)\}.*?\\end\{(?P=env)(?P=star)\}"),
    ("x_math", "latex", "$", r"(?<!\\)\$\$[^$]+\$\$"),
    ("x_math", "latex", "\\", r"\\\[.+?\\\]"),
    ("x_math", "latex", "\\", r"\\\(.+?\\\)"),
    ("x_math", "latex", "$", r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_=][^$\n]*\$)[^$\n]*[^\s$\\]\$(?![\d\w])|(?<![\\$\w])\$[A-Za-z]\$(?!\w)"),
    ("x_env", "latex", "\\", r"(?<![\w:\\])\\(?:begin|end)\{\w+\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})?"),
    ("x_command", "latex", "\\", r"(?<![:\\])\\(?P<command>[A-Za-z]{2,})\*?(?![\w\\])"),
    ("x_sign", "latex", "\\", r"(?<![:\\])\\[$%&#_{}]"),
    ("w_table", "wiki", "{", r"^\{\|.*?(?:^\|\}|\n(?=\r?\n)|\Z)"),
    ("w_template", "wiki", "{", r"\{\{[ \t]*[^\s{}|][^{}|]*\|" + _INNER + r"\}\}"),
    ("m_reference", "markdown", "[", rf"{_LINE}\[(?!\^)[^\[\]\n]+\]:[ \t]+\S+[^\n]*$"),
    ("m_footnote", "markdown", "[", r"\[\^[\w-]+\]:?"),
    ("w_link", "wiki", "[", r"\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)*\]\]"),
    ("w_external", None, "[", rf"\[{_URL}(?:[ \t][^\[\]\n]*)?\]"),
    ("m_task", "markdown", "[", r"\[[ xX]\](?=[ \t])"),
    ("m_link", "markdown", "![<", r"!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|(?<![\w\])])!?\[[^\[\]\n]+\]\[(?:\w[\w .-]*)?\]|<https?://[^\s<>]+>"),
    ("w_heading", "wiki", "=", rf"^(?P<eq>={{1,6}})(?!=)[ \t]*\S[^\n]*?(?<!=)(?P=eq){_FULL}"),
    ("m_heading", "markdown", "#", rf"{_LINE}#{{1,6}}[ \t]+(?=\S)"),
    ("m_underline", "markdown", "=-", rf"^{_UNDER}(?:={{3,}}|-{{3,}}){_FULL}"),
    ("m_table", "markdown", "|", r"\|"),
    ("w_quotes", "wiki", "'", r"(?<![\w'])(?P<quotes>'{2,5})(?=[^\s'])[^\n]*?[^\s'](?P=quotes)(?!')"),
    ("m_strike", "markdown", "~", r"~~(?=[^\s~])[^~\n]*[^\s~]~~|~~[^\s~]~~"),
    ("w_switch", "wiki", "_", "__(?:" + "|".join(WIKI_SWITCHES) + ")__"),
    ("m_strong", "markdown", "*_", r"(?<![\w*\\])(?P<stars>\*{1,3})(?=[^\s*])(?:[^*\n]|(?<=\s)\*(?=\s)|(?<=\w)\*(?=\s))*?[^\s*](?P=stars)(?![\w*])|(?<![\w_])(?P<lines>_{1,3})(?=[^\s_])(?:[^_\n]|\w_\w)*?[^\s_](?P=lines)(?![\w_])"),
)
#: Rules that search the text (or the line) for an end: the pattern of their beginning, whose groups name the end.
#: Where one found no end, a later one of the same name in that reach has none either and isn't tried.
_OPENINGS = {
    r"<!--.*?-->": (r"<!--", False),
    r"\\\[.+?\\\]": (r"\\\[", False),
    r"\\\(.+?\\\)": (r"\\\(", False),
    "h_raw": (r"<(?P<raw>(?i:script|style|pre|textarea|svg|math|code|nowiki))\b[^<>]*>", False),
    "x_verbatim": (r"\\begin\{(\w+\*?)\}", False),
    "w_quotes": (r"(?<![\w'])('{2,5})(?=[^\s'])", True),
}
LANGUAGE = {kind: language for kind, language, _, _ in RULES}
_AT: dict[str, list[tuple[str, re.Pattern, re.Pattern | None, bool]]] = {}
for _kind, _, _letters, _pattern in RULES:
    _opening, _in_line = _OPENINGS.get(_pattern) or _OPENINGS.get(_kind) or (None, False)
    for _letter in _letters:
        _AT.setdefault(_letter, []).append((_kind, re.compile(_pattern, re.M | re.S), re.compile(_opening) if _opening else None, _in_line))
#: Places where a construct can begin; each branch begins with a letter, so that the search skips the others fast.
_START = re.compile(
    r"<[A-Za-z/!%<]|&[#A-Za-z]|`|~~|\\[A-Za-z$%&#_{}(\[]|\$[${A-Za-z\\]|\{[{%|]|\[|!\[|''|\*[^\s*]|\*\*+[^\s*]|_[^\s_]|__+[^\s_]|#[ \t#{]|\||@@|%%|=[^\s]|= \S|---|\]\]>"
)
_LIST = re.compile(r"[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\Z")
_RULE_LINE = re.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?\Z")
_ROW_LINE = re.compile(r"[ \t]*\|(?:[^|\n]+\|){2,}[ \t]*\r?\Z")


@dataclass(slots=True)
class Construct:
    kind: str
    start: int
    end: int
    match: re.Match


def scan(text: str) -> list[Construct]:
    """The constructs of a text in their order."""
    out: list[Construct] = []
    at, search = 0, _START.search
    endless: dict[tuple[str, str], int] = {}  # beginnings up to there have no end
    while (found := search(text, at)) is not None:
        at = begin = found.start()
        letter = text[begin]
        for kind, pattern, opening, in_line in _AT[letter]:
            name = None
            if opening is not None:
                if (o := opening.match(text, begin)) is None:
                    continue
                name = (pattern.pattern, (o.group(1) if opening.groups else "").lower())
                if begin < endless.get(name, 0):
                    continue
            m = pattern.match(text, begin)
            if m is None:
                if name is not None:
                    endless[name] = (text.find("\n", begin) if in_line else -1) % (len(text) + 1)
                continue
            start, end = m.span()
            if kind == "h_ref" and (reference := m.group("ref")) and reference not in REFERENCES:
                continue
            if kind == "m_task" and not _LIST.match(text, text.rfind("\n", 0, begin) + 1, begin):
                continue
            # a path's name stands behind a letter, too, but no brace behind it
            if kind == "x_command" and begin and (text[begin - 1].isalnum() or text[begin - 1] in "_/.") and text[end : end + 1] != "{":
                continue
            if kind == "m_table":
                start, end = text.rfind("\n", 0, begin) + 1, text.find("\n", begin)
                end = len(text) if end < 0 else end
                if out and out[-1].end > start or not (_RULE_LINE.match(text, start, end) or _ROW_LINE.match(text, start, end)):
                    at = begin + 1
                    break
            out.append(Construct(kind, start, end, m))
            at = max(end, begin + 1)
            break
        else:
            # a run of one letter is passed as a whole
            at = begin + 1
            while at < len(text) and text[at] == letter and letter in "*_=-#`~":
                at += 1
    return out


def languages(constructs: list[Construct]) -> list[str]:
    return sorted({x for c in constructs if (x := LANGUAGE[c.kind])})
