"""Markup residue: parser events of HTML, Markdown, wiki and LaTeX, and the clean text that remains without them.

Code is found first, left to right, and masked; then the standard library's HTML parser is fed line by line, and the
line and span grammars of the other families run over what is neither code nor tag. Every event names its span, family
and what stands in its place in the clean text. Lines of page chrome are told from content by the text-to-tag ratio of
each line, smoothed by a Gaussian and split into two clusters by a threshold.
"""

from __future__ import annotations

import bisect
import html.entities
import math
import re
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")
_MASK = "\ue000"

# Element names of HTML.
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd "
    "label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture "
    "pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# Attributes that stand without a value.
BARE_ATTRIBUTES = frozenset("async autofocus checked compact controls defer disabled hidden ismap loop multiple muted nowrap open readonly required reversed selected".split())
_WIKI_TAGS = frozenset(("nowiki", "ref", "references", "gallery", "includeonly", "noinclude", "onlyinclude"))
_BLOCK_TAGS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html main nav ol p pre section summary table tbody tfoot thead title tr ul".split())
# LaTeX commands that stand without an argument.
BARE_COMMANDS = frozenset(
    "item par noindent newline linebreak pagebreak clearpage maketitle tableofcontents centering hline LaTeX TeX ldots dots "
    "cdots quad qquad bfseries itshape ttfamily small large Large tiny alpha beta gamma delta epsilon theta lambda mu pi "
    "sigma phi omega sum prod int infty times cdot leq geq neq approx rightarrow leftarrow Rightarrow log sin cos tan exp "
    "min max sqrt partial nabla forall exists in subset cup cap left right".split()
)
_DUNDERS = frozenset(
    "init new del name main str repr call dict class slots doc file all version enter exit iter next len getitem setitem "
    "delitem contains eq ne lt le gt ge hash bool add sub mul truediv floordiv mod pow and or xor getattr setattr delattr "
    "getattribute get set module qualname annotations annotate future import path spec loader builtins debug wrapped "
    "await aiter anext aenter aexit post_init init_subclass class_getitem set_name missing format bytes index int float".split()
)


class Event(NamedTuple):
    start: int
    end: int
    family: str
    kind: str
    instead: str


#: every alternative starts with one of few characters; the look-ahead passes over all others at once
_CODE = re.compile(
    r"(?=[ \t>`~<\\])(?:(?P<fence>^[ \t]{0,3}(?:>[ \t]?)?(?P<f>`{3,}(?=[^`\n]*$)|~{3,}).*(?:\n|\Z))"
    r"|(?P<pre><(?P<t>pre|code|tt|kbd|samp|script|style)\b[^<>]*>)"
    r"|(?P<verb>\\begin\{(?P<v>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*)"
    r"|(?P<inline>\\verb\*?(?P<d>[^\sA-Za-z*]))"
    r"|(?P<span>(?<![`\\])`+(?!`)))",
    re.M | re.I,
)


def code_regions(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, content start, content end, end, kind) of code from left to right; what opens inside code is content."""
    out, at = [], 0
    unclosed: set[str] = set()  # what has no close up to the end of the text has none later either

    def closing(pattern: str, flags: int, start: int):
        if pattern in unclosed:
            return None
        close = re.compile(pattern, flags).search(text, start)
        if not close:
            unclosed.add(pattern)
        return close

    while m := _CODE.search(text, at):
        if m["fence"]:
            mark = m["f"]
            close = closing(rf"^[ \t]{{0,3}}(?:>[ \t]?)?{re.escape(mark[0])}{{{len(mark)},}}[ \t]*\r?(?:\n|\Z)", re.M, m.end())
            out.append((m.start(), m.end(), *((close.start(), close.end()) if close else (len(text), len(text))), "fence"))
        elif m["pre"]:
            close = closing(rf"</{m['t'].lower()}\s*>", re.I, m.end())
            if not close:
                at = m.end()
                continue
            out.append((m.start(), m.end(), close.start(), close.end(), m["t"].lower()))
        elif m["verb"]:
            close = text.find(f"\\end{{{m['v']}}}", m.end())
            end = close + len(m["v"]) + 6 if close >= 0 else len(text)
            out.append((m.start(), m.end(), close if close >= 0 else end, end, "verbatim"))
        elif m["inline"]:
            line = text.find("\n", m.end())
            close = text.find(m["d"], m.end(), line if line >= 0 else len(text))
            if close < 0:
                at = m.end()
                continue
            out.append((m.start(), m.end(), close, close + 1, "verb"))
        else:
            run = m["span"]
            close = closing(rf"(?<!`){run}(?!`)", 0, m.end())
            if not close or re.search(r"\n[ \t\r]*\n", text[m.end() : close.start()]) or close.start() == m.end():
                at = m.end()
                continue
            out.append((m.start(), m.end(), close.start(), close.end(), "span"))
        at = max(out[-1][3], at + 1)
    return out


class _Html(HTMLParser):
    """Collects tags, comments, declarations and character references with their spans."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.events = text, []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        last = text.rfind(">") + 1  # no tag opens behind the last close
        text = text[:last] + text[last:].replace("<", _MASK)
        for a, b in zip(self.lines, [*self.lines[1:], len(text)]):
            self.feed(text[a:b])
        self.close()

    def set_cdata_mode(self, elem, **_):
        """Scripts and styles that are closed have been masked; an unclosed one hides nothing behind it."""

    def _at(self) -> int:
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def _tag(self, tag: str, raw: str, kind: str, instead: str) -> None:
        at = self._at()
        self.events.append(Event(at, at + len(raw), "wiki" if tag in _WIKI_TAGS else "html", kind, instead))

    def handle_starttag(self, tag, attrs):
        if tag not in TAGS and tag not in _WIKI_TAGS or any(v is None and k not in BARE_ATTRIBUTES for k, v in attrs):
            return
        raw = self.get_starttag_text()
        if tag == "li":
            self._tag(tag, raw, "item", "\n- ")
        elif re.fullmatch("h[1-6]", tag):
            self._tag(tag, raw, f"heading {tag[1]}", "\n\n")
        elif tag == "a":
            self._tag(tag, raw, "anchor", "")
        else:
            self._tag(tag, raw, "tag", "\n" if tag in _BLOCK_TAGS or tag == "br" else "\t" if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        if tag not in TAGS and tag not in _WIKI_TAGS:
            return
        at = self._at()
        end = self.text.find(">", at) + 1
        if end:
            kind = "heading end" if re.fullmatch("h[1-6]", tag) else "anchor end" if tag == "a" else "tag"
            self._tag(tag, self.text[at:end], kind, "\n" if tag in _BLOCK_TAGS else "")

    def handle_comment(self, data):
        at = self._at()
        if self.text.startswith("<!--", at) and self.text.startswith("-->", at + 4 + len(data)):
            self.events.append(Event(at, at + 7 + len(data), "html", "comment", ""))

    def handle_decl(self, decl):
        at = self._at()
        self.events.append(Event(at, at + 3 + len(decl), "html", "comment", ""))

    def handle_entityref(self, name):
        at = self._at()
        if self.text.startswith(f"&{name};", at) and f"{name};" in html.entities.html5:
            raw = f"&{name};"
            self.events.append(Event(at, at + len(raw), "html", "reference", unescape(raw).replace("\xa0", " ")))

    def handle_charref(self, name):
        at = self._at()
        raw = f"&#{name};"
        if self.text.startswith(raw, at):
            self.events.append(Event(at, at + len(raw), "html", "reference", unescape(raw).replace("\xa0", " ")))


#: arguments are only opened here; where they close, a stack of braces tells
_LATEX = re.compile(
    r"(?P<env>\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[lcr|@{} ]+\})?)"
    r"|(?P<disp>\$\$(?P<d>[^$]+?)\$\$)|(?P<square>\\\[)"
    r"|(?P<paren>\\\((?P<g>[^\n]+?)\\\))"
    r"|(?P<math>(?<![\\$\w])\$(?P<m>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\w$]))"
    r"|(?P<head>\\(?P<level>part|chapter|section|subsection|subsubsection|paragraph)\*?\{)"
    r"|(?P<item>\\item\b[ \t]*(?:\[[^\]\n]*\])?)"
    r"|(?P<ref>[~ ]?\\(?:ref|eqref|pageref|cite[a-z]*|label|index|footnote|vspace|hspace|usepackage|documentclass|bibliography)\*?(?:\[[^\]\n]*\])*\{)"
    r"|(?P<url>\\href\{[^{}]*\}\{)"
    r"|(?P<cmd>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{)"
    r"|(?P<bare>\\(?P<b>[A-Za-z]{2,})(?![A-Za-z]))"
)
_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")
_BRACE = re.compile(r"\\[{}\\]|[{}]")


def _braces(text: str) -> dict[int, int]:
    """The closing brace of every opening one."""
    out, stack = {}, []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            stack.append(m.start())
        elif m.group() == "}" and stack:
            out[stack.pop()] = m.start()
    return out


_REGEX_LIKE = re.compile(r"\\[dwsDWSbB.+*?]|\(\?|[*+?]\)|\\\)[*+?]")

_WIKI = re.compile(
    r"(?=[=\[{|!#_' \t])(?:(?P<head>^(?P<h>={2,6})(?!=)[ \t]*(?P<ht>[^=\n](?:.*?[^=\s])?)[ \t]*(?P=h)[ \t]*\r?$)"
    r"|(?P<open>^[ \t]*\{\|[^\n]*\n?)|(?P<close>^[ \t]*\|\}[ \t]*\r?$)|(?P<row>^[ \t]*\|-[^\n|-]*\r?$)|(?P<hcell>^[ \t]*!(?![\[(])[ \t]*(?=\S)(?=[^\n]*\r?\n[ \t]*\|[-}]))"
    r"|(?P<redir>^#REDIRECT[ \t]*)"
    r"|(?P<link>\[\[(?P<lt>[^\[\]\n|]+)(?:\|(?P<ll>[^\[\]\n]*))?\]\])"
    r"|(?P<ext>\[(?:https?|ftp|mailto):[^\s\]]+(?:[ \t]+(?P<et>[^\]\n]+))?\](?!\())"
    r"|(?P<tpl>\{\{(?P<tt>[^{}]+)\}\})"
    r"|(?P<switch>(?-i:__[A-Z]{3,}__))"
    r"|(?P<bold>(?<![\w'=])(?P<q>'{2,5})(?=[^\s'])(?P<bt>(?:[^'\n]|'(?!'))+?)(?<=\S)(?P=q)(?!')))",
    re.M | re.I,
)
_LITERAL = re.compile(r"[\d\s,.'\"-]*[,'\"][\d\s,.'\"-]*")

_MARKDOWN = re.compile(
    r"(?=[ \t#=\-|:>*+\[!<~_])(?:(?P<head>^[ \t]{0,3}(?:>[ \t]?)*\#{1,6}[ \t]+(?=\S))"
    r"|(?P<setext>(?<=\n)[ \t]{0,3}(?:={3,}|-{3,})[ \t]*\r?$)"
    r"|(?P<delim>^[ \t]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?(?:\n|\Z)|^[ \t]{0,3}\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*\r?(?:\n|\Z))"
    r"|(?P<quote>^[ \t]{0,3}(?:>(?!>>)[ \t]?)+(?=[^\s=]))"
    r"|(?P<task>^[ \t]*[-*+][ \t]\[[ xX]\][ \t]+)"
    r"|(?P<def>^[ \t]{0,3}\[[^\]\n^][^\]\n]*\]:[ \t]+\S+[^\n]*\n?)"
    r"|(?P<notedef>^[ \t]{0,3}\[\^\w+\]:[ \t]*)"
    r"|(?P<note>(?<![\\\[])\[\^[\w-]{1,20}\](?![+*?{:]))"
    r"|(?P<image>!\[(?P<it>[^\[\]\n]*)\]\((?P<iu>[^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\))"
    r"|(?P<link>(?<![A-Za-z0-9_\])\\])\[(?P<lt>[^\[\]]+)\]\((?P<lu>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+\"[^\"\n]*\")?\))"
    r"|(?P<ref>\[(?P<rt>[^\[\]]+)\]\[(?P<rr>[^\[\]\n]*)\])"
    r"|(?P<auto><(?:https?://|mailto:)[^<>\s]+>)"
    r"|(?P<strike>(?<!~)~~(?=[^\s~])(?P<st>(?:[^~\n]|~(?!~)|\n(?![ \t\r]*\n))+?)(?<=\S)~~(?!~))"
    r"|(?P<star>(?<![\w*\\])(?P<s>\*{1,3})(?=[^\s*])(?P<sx>(?:[^*\n]|\n(?![ \t\r]*\n)|(?<!\*)\*{1,2}(?!\*)(?=[^*\n]))+?)(?<=[^\s*])(?P=s)(?!\*))"
    r"|(?P<low>(?<![\w\\])(?P<l>_{1,3})(?=[^\s_])(?P<lx>(?:[^_\n]|(?<=\w)_(?=\w)|\n(?![ \t\r]*\n))+?)(?<=[^\s_])(?P=l)(?!\w)))",
    re.M,
)
#: letters of scripts that write no blanks do not count as the inside of a word
_WIDE_LETTER = re.compile("[\u0e00-\u0e7f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff00-\uffef]")
_WIDE_STAR = re.compile(r"(?<![*\\A-Za-z0-9_])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![*\w])|(?<=[\u3000-\u9fff\uff00-\uffef])(\*{2,3}|~~|_{1,2})(?=[^\s*~_])([^*~\n]+?)(?<=[^\s*~])\3(?=[\u3000-\u9fff\uff00-\uffef]|\W|\Z)", re.M)


def _masked(text: str, spans) -> str:
    """The text with spans blanked out, newlines and length kept."""
    out, at = [], 0
    for a, b in spans:
        if a < at:
            continue
        out.append(text[at:a])
        out.append(re.sub(r"[^\r\n]", _MASK, text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


def events(text: str) -> list[Event]:
    """All markup events in order; spans may nest but not cross."""
    found: list[Event] = []
    codes = code_regions(text) if "`" in text or "~~~" in text or "<" in text or "\\" in text else []
    for a, b, c, d, kind in codes:
        if kind == "fence":
            found += [Event(a, b, "markdown", "code", "\n"), *([Event(c, d, "markdown", "code", "\n")] if d > c else [])]
        elif kind == "span":
            found += [Event(a, b, "markdown", "span", ""), Event(c, d, "markdown", "span", "")]
        elif kind in ("verbatim", "verb"):
            found += [Event(a, b, "latex", "code", ""), *([Event(c, d, "latex", "code", "")] if d > c else [])]
        elif kind in ("script", "style"):
            found.append(Event(a, d, "html", "comment", ""))
        else:
            gap = "\n" if kind == "pre" else ""
            found += [Event(a, b, "html", "code" if gap else "span", gap), Event(c, d, "html", "code" if gap else "span", gap)]
            inner = text[b:c]
            if kind == "pre":
                found += [Event(b + x.start(), b + x.end(), "", "inner", "") for x in re.finditer(r"</?code[^<>]*>", inner, re.I)]
            found += [Event(b + x.start(), b + x.end(), "", "inner", unescape(x.group())) for x in re.finditer(r"&(?:#\w+|\w+);", inner)]
    masked = _masked(text, [(a, d) for a, _, _, d, _ in codes]) if codes else text
    if "<" in masked or "&" in masked:
        tags = _Html(masked).events
        found += tags
        if tags:
            masked = _masked(masked, [(e.start, e.end) for e in tags])
    if "\\" in masked or "$" in masked:
        math_spans: list[tuple[int, int]] = []
        braces: dict[int, int] | None = None
        square = -1  # the close of a displayed formula searched last; none further than the text
        for m in _LATEX.finditer(masked):
            kind = m.lastgroup if m.lastgroup in ("env", "item", "ref", "url", "cmd", "bare", "square") else next(k for k in ("disp", "paren", "math", "head", "bare") if m[k])
            if kind == "bare":
                if m["b"] in BARE_COMMANDS:
                    found.append(Event(*m.span(), "latex", "command", ""))
            elif kind in ("env", "item"):
                found.append(Event(*m.span(), "latex", "item" if kind == "item" else "command", "- " if kind == "item" else ""))
            elif kind in ("disp", "paren", "math", "square"):
                if math_spans and m.start() < math_spans[-1][1]:
                    continue
                if kind == "square":
                    if square < m.end():
                        square = masked.find("\\]", m.end() + 1)
                        square = square if square >= 0 else len(masked)
                    inner, end = (m.end(), square), square + 2
                    formula = masked[inner[0] : inner[1]] if square < len(masked) else ""
                    if not formula or _REGEX_LIKE.search(formula) and not re.search(r"[=^_]", formula):
                        continue
                else:
                    inner, end = m.span({"disp": "d", "paren": "g", "math": "m"}[kind]), m.end()
                    if kind == "paren" and _REGEX_LIKE.search(m[0]):
                        continue
                found += [Event(m.start(), inner[0], "latex", "formula", ""), Event(inner[1], end, "latex", "formula end", "")]
                math_spans.append((m.start(), end))
            else:
                if braces is None:
                    braces = _braces(masked)
                close = braces.get(m.end() - 1, -1)
                if close < 0 or math_spans and m.start() < math_spans[-1][1]:
                    continue
                if kind == "ref":
                    found.append(Event(m.start(), close + 1, "latex", "command", ""))
                    continue
                name = f"heading {_LEVELS.index(m['level']) or 1}" if kind == "head" else "command"
                found += [Event(m.start(), m.end(), "latex", name, ""), Event(close, close + 1, "latex", name.split()[0] + " end", "")]
        if math_spans:
            masked = _masked(masked, math_spans)
    if any(x in masked for x in ("[", "{", "''", "==", "__", "|", "#R", "#r")):
        in_table = False
        for m in _WIKI.finditer(masked):
            a, b = m.span()
            if m["head"]:
                found += [Event(a, m.start("ht"), "wiki", f"heading {len(m['h'])}", ""), Event(m.end("ht"), b, "wiki", "heading end", "")]
            elif m["open"]:
                in_table = True
                found.append(Event(a, b, "wiki", "table", ""))
            elif m["close"] or m["row"] or m["hcell"]:
                if in_table:
                    found.append(Event(a, b, "wiki", "table", ""))
                    in_table = not m["close"]
            elif m["link"]:
                if not _LITERAL.fullmatch(m["lt"]):
                    if re.match(r"(?i)(?:category|file|image|категория|kategorie|catégorie|categoría):", m["lt"]):
                        found.append(Event(a, b, "wiki", "link", ""))
                    else:
                        g = "ll" if m["ll"] else "lt"
                        found += [Event(a, m.start(g), "wiki", "link", ""), Event(m.end(g), b, "wiki", "link end", "")]
            elif m["ext"]:
                if m["et"]:
                    found += [Event(a, m.start("et"), "wiki", "link", ""), Event(m.end("et"), b, "wiki", "link end", "")]
                else:
                    found.append(Event(a, b, "wiki", "link", ""))
            elif m["bold"]:
                if m["q"] == "''" and masked[a - 1 : a] in ("(", "[", ","):  # an empty Python string
                    continue
                found += [Event(a, m.start("bt"), "wiki", "emphasis", ""), Event(m.end("bt"), b, "wiki", "emphasis end", "")]
            else:
                found.append(Event(a, b, "wiki", "template", ""))
    _markdown(masked, found)
    found.sort(key=lambda e: (e.start, e.end))
    return found


_STARS = re.compile(r"\*+|\n[ \t\r]*\n")


def _unopened(text: str) -> str:
    """The text without stars that open nothing, as no stars behind them in their paragraph can close them."""
    runs = list(_STARS.finditer(text))
    closers: set[int] = set()
    gone = []
    for m in reversed(runs):
        a, b = m.span()
        if text[a] == "\n":
            closers.clear()
            continue
        n = b - a
        if n not in closers and b < len(text) and not text[b].isspace() and (a == 0 or not text[a - 1].isalnum()):
            gone.append((a, b))
        if a and not text[a - 1].isspace():
            closers.add(n)
    return _masked(text, gone[::-1]) if gone else text


def _markdown(masked: str, found: list[Event]) -> None:
    if "*" in masked:
        masked = _unopened(masked)
    defined = {x.casefold() for x in re.findall(r"^[ \t]{0,3}\[([^\]\n]+)\]:", masked, re.M)} if "]:" in masked else set()
    for m in _MARKDOWN.finditer(masked):
        a, b = m.span()
        pair = None
        if m["setext"]:
            before = masked[masked.rfind("\n", 0, a - 1) + 1 : a - 1].rstrip("\r")
            up = max(0, masked.rfind("\n", 0, a - 1))
            earlier = masked[masked.rfind("\n", 0, up) + 1 : up].strip()
            if not before.strip() or earlier or re.match(r"[ \t]*(?:[-*+|>]|\d+[.)])", before) or before.strip()[-1] in "|":
                continue
            kind = f"heading {1 if '=' in m['setext'] else 2}"
            found.append(Event(masked.rfind("\n", 0, a - 1) + 1, masked.rfind("\n", 0, a - 1) + 1, "markdown", kind, ""))
            kind = "heading end"
        elif m["delim"]:
            before = masked[masked.rfind("\n", 0, max(0, a - 1)) + 1 : max(0, a - 1)]
            if "|" not in before:
                continue
            kind = "table"
        elif m["ref"]:
            if (m["rr"] or m["rt"]).casefold() not in defined:
                continue
            kind, pair = "link", m.span("rt")
        elif m["link"]:
            if not re.search(r"[/.#:@]", m["lu"]):
                continue
            kind, pair = "link", m.span("lt")
        elif m["image"]:
            kind, pair = "image", m.span("it")
        elif m["strike"]:
            kind, pair = "emphasis", m.span("st")
        elif m["star"]:
            kind, pair = "emphasis", m.span("sx")
        elif m["low"]:
            if m["lx"] in _DUNDERS or re.fullmatch("[A-Z]{3,}", m["lx"]) and m["l"] == "__":
                continue
            kind, pair = "emphasis", m.span("lx")
        else:
            kind = next(k for k in ("head", "quote", "task", "def", "notedef", "note", "auto") if m[k])
        if pair:
            found += [Event(a, pair[0], "markdown", kind, ""), Event(pair[1], b, "markdown", kind + " end", "")]
        else:
            instead = {"head": "", "task": "- ", "auto": masked[a + 1 : b - 1]}.get(kind, "")
            found.append(Event(a, b, "markdown", {"head": f"heading {m[0].count('#')}", "task": "item"}.get(kind, kind), instead))
    taken = {e.start for e in found}
    for m in _WIDE_STAR.finditer(masked):
        g = 2 if m[2] is not None else 4
        if m.start() not in taken:
            found += [Event(m.start(), m.start(g), "markdown", "emphasis", ""), Event(m.end(g), m.end(), "markdown", "emphasis end", "")]


def families(found: list[Event]) -> list[str]:
    have = {e.family for e in found}
    return [f for f in FAMILIES if f in have]


def line_ratios(text: str, found: list[Event]) -> tuple[list[int], list[float], list[tuple[int, int, int]]]:
    """Line starts; per line its text-to-tag ratio, for which only text outside links counts; and per line the characters
    of its text, of that in links, and the links."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    tags, hidden, linked, links, k, anchor = *([0] * len(starts) for _ in range(4)), 0, -1
    for e in found:
        while k + 1 < len(starts) and starts[k + 1] <= e.start:
            k += 1
        tags[k] += e.family == "html"
        hidden[k] += e.end - e.start
        if e.kind == "anchor":
            anchor = e.end
        elif e.kind == "anchor end" and anchor >= starts[k]:
            linked[k] += len(text[anchor : e.start].strip())
            links[k] += 1
            anchor = -1
    ends = [*starts[1:], len(text)]
    shown = [max(0, len(text[a:b].strip()) - h) for a, b, h in zip(starts, ends, hidden)]
    return starts, [max(0, n - x) / max(1, t) for n, x, t in zip(shown, linked, tags)], list(zip(shown, linked, links))


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Values smoothed by a Gaussian of ``sigma`` places."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Splits values into two clusters: the mean of both cluster means, repeated until it stands."""
    if not values:
        return 0.0
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            return cut
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def chrome_regions(text: str, found: list[Event], sigma: float = 1.0) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the regions that hold no content: runs of lines whose ratio, smoothed and own, lies in
    the low cluster, whose text is links for the greater part, with two links at least. Code, formulas and headings are content wherever they stand."""
    starts, ratios, shown = line_ratios(text, found)
    smooth = smoothed(ratios, sigma)
    cut = threshold(smooth)
    ends = [*starts[1:], len(text)]
    content = [max(s, r) > cut for s, r in zip(smooth, ratios)]
    k = 0
    for e in found:
        while k + 1 < len(starts) and starts[k + 1] <= e.start:
            k += 1
        if e.kind.startswith(("heading", "code", "formula")):
            content[k] = True
    # a line without text belongs to the region it stands in
    bare = [not c and (not n or x * 2 > n) for c, (n, x, _) in zip(content, shown)]
    out, i = [], 0
    while i < len(starts):
        j = i
        while j < len(starts) and bare[j]:
            j += 1
        if sum(shown[x][2] for x in range(i, j)) > 1:
            out.append((starts[i], ends[j - 1], j - i))
        i = j + 1
    return out


class Cleaned(NamedTuple):
    text: str
    families: list[str]
    dropped: int
    structure: list[tuple[str, int, int, int]]


def clean(text: str) -> Cleaned:
    """The clean text, the families of markup found, the number of lines dropped as chrome, and the structure kept:
    (``heading``, ``item``, ``code`` or ``formula``, level, start, end) in the clean text.

    Headings stay lines of their own, list items keep a mark, code keeps its lines and indentation, formulas keep their
    source; delimiters go, and what they told is in the structure. Regions without content go (:func:`chrome_regions`).
    """
    found = events(text)
    have = families(found)
    regions = chrome_regions(text, found) if "html" in have else []
    drop = [(a, b) for a, b, _ in regions]
    out, at, d, size = [], 0, 0, 0
    marks: list[list] = []
    open_: dict[str, list] = {}

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for e in found:
        while d < len(drop) and drop[d][1] <= e.start:
            d += 1
        if e.start < at or d < len(drop) and drop[d][0] <= e.start < drop[d][1]:
            continue
        put(_kept(text, at, e.start, drop))
        kind, _, rest = e.kind.partition(" ")
        if rest == "end" or kind == "code" and "code" in open_:
            if kind in open_:
                open_.pop(kind)[3] = size
            put(e.instead)
        else:
            put(e.instead)
            if kind in ("heading", "item", "code", "formula"):
                begins = size - len(e.instead) + len(e.instead) - len(e.instead.lstrip("\n"))
                marks.append([kind, int(rest) if rest else 0, begins, -1])
                if kind != "item":
                    open_[kind] = marks[-1]
        at = e.end
    put(_kept(text, at, len(text), drop))
    result = "".join(out)
    for m in marks:
        if m[3] < 0:  # up to the end of the line, code up to the end of the text
            line = result.find("\n", m[2])
            m[3] = line if line >= 0 and m[0] != "code" else len(result)
    places = [p for m in marks for p in m[2:]]
    for pattern, instead in ((re.compile(r"(?<![ \t])[ \t]+(?=\r?\n)"), ""), (re.compile(r"(?:\r?\n){3,}"), "\n\n"), (re.compile(r"\A[\r\n]+|[\r\n]+\Z"), "")):
        result, places = _replaced(pattern, instead, result, places)
    structure = [(m[0], m[1], *_trimmed(result, a, b)) for m, a, b in zip(marks, places[::2], places[1::2])]
    return Cleaned(result, have, sum(n for *_, n in regions), [x for x in structure if x[2] < x[3]])


def _replaced(pattern: re.Pattern, instead: str, text: str, places: list[int]) -> tuple[str, list[int]]:
    """The text with every match replaced, and where places in it have moved to."""
    out, starts, shifts, at, gone = [], [], [], 0, 0
    for m in pattern.finditer(text):
        out += (text[at : m.start()], instead)
        at = m.end()
        starts.append(m.start())
        shifts.append((m.end(), gone))
        gone += m.end() - m.start() - len(instead)
    if not starts:
        return text, places
    moved = []
    for p in places:
        k = bisect.bisect_right(starts, p) - 1
        if k < 0:
            moved.append(p)
            continue
        end, before = shifts[k]
        kept = min(p, starts[k] + len(instead)) if p < end else p - (end - starts[k] - len(instead))
        moved.append(kept - before)
    return "".join((*out, text[at:])), moved


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in "\r\n":
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _kept(text: str, a: int, b: int, drop: list[tuple[int, int]]) -> str:
    out = []
    for x, y in drop[bisect.bisect_left(drop, a, key=lambda s: s[1]) :]:
        if x >= b:
            break
        out.append(text[a : max(a, x)])
        a = max(a, min(y, b))
    out.append(text[a:b])
    return "".join(out)


def clean_markup(df: DataFrame, id_col: str = "cpt_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, ``clean_text``, ``markup``, ``dropped_lines``, ``structure``): every text without its markup, the families
    found, and the headings with their levels, list items, code and formulas of the clean text by their code points.

    A null text stays null with empty lists; empty and blank texts have no markup; unclosed fences run to the end of
    the text, unclosed tags are tags, other unclosed marks are text. Repeated rows are cleaned alike, an empty table gives
    an empty table, other columns are ignored. Rows are handled where they lie, without a shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "clean_text", "markup", "dropped_lines", "structure"]
    part = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for b in batches:
            got = [clean(t) if t else Cleaned(t, [], 0, []) for t in b.column(1).to_pylist()]
            text, families_, dropped, structure = list(zip(*got)) or [[]] * 4
            spans = [[dict(zip(("kind", "level", "start", "end"), x)) for x in s] for s in structure]
            columns = (pa.array(text, pa.string()), pa.array(families_, pa.list_(pa.string())), pa.array(dropped, pa.int32()), pa.array(spans, pa.list_(part)))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    schema = f"`{id_col}` {kind}, clean_text string, markup array<string>, dropped_lines int, structure array<struct<kind:string,level:int,start:int,end:int>>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def markup_found(df: DataFrame, id_col: str = "cpt_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, ``markup``): one row per text and family of markup in it; cases as in :func:`clean_markup`."""
    return clean_markup(df, id_col, text_col).select(id_col, F.explode("markup").alias("markup"))
