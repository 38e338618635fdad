"""reStructuredText rendered as Markdown, line by line."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import LINE_BREAK, with_suffix
from quernstone.operators.doctree import CHANGE_DIRECTIVES, ENTRY_DIRECTIVES

_BREAK = re.compile(LINE_BREAK)
_RULE = re.compile(r"([=\-~^\"'`#*+<>_:.])\1{2,}\s*\Z")
_DIRECTIVE = re.compile(r"(\s*)\.\.\s+(?:[a-z]+:)?([\w-]+)::\s*(.*)\Z")
_NAMED = re.compile(r"`([^`<]+?)\s*<([^`>]+)>`__?")
_ROLE = re.compile(r":[a-z][a-z:+-]*:`(?:[^`<]*<)?[!~]?([^`<>]+)>?`")
_LITERAL = re.compile(r"``(.+?)``")
_PLAIN = re.compile(r"(?<![`\w])`([^`\n]+)`_?(?![`\w])")
_NOTE = re.compile(r"\[#?(\w+)\]_")


def inline(text: str) -> str:
    """Roles, literals, links and footnotes of one line."""
    kept: list[str] = []

    def keep(made: str) -> str:
        kept.append(made)
        return f"\0{len(kept) - 1}\0"

    text = _LITERAL.sub(lambda m: keep(f"`{m[1]}`"), text)
    text = _NAMED.sub(lambda m: keep(f"[{m[1]}]({m[2]})"), text)
    text = _ROLE.sub(lambda m: keep(f"`{m[1]}`"), text)
    text = _PLAIN.sub(lambda m: keep(f"*{m[1]}*"), text)
    text = _NOTE.sub(r"[^\1]", text)
    while "\0" in text:
        text = re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)
    return text


def to_markdown(text: str) -> str:
    """The Markdown of a document; it ends with one line break unless it is empty."""
    lines = _BREAK.split(text)
    out: list[str] = []
    marks: list[str] = []
    k, n = 0, len(lines)
    while k < n:
        line = lines[k]
        if k + 2 < n and _RULE.match(line) and lines[k + 1].strip() and lines[k + 2].rstrip() == line.rstrip():
            k += 1  # an overline belongs to the title below it
            continue
        if line.strip() and not line[0].isspace() and k + 1 < n and _RULE.match(lines[k + 1]) and not _RULE.match(line):
            mark = lines[k + 1][0]
            if mark not in marks:
                marks.append(mark)
            out.append("#" * min(6, marks.index(mark) + 1) + " " + inline(line.strip()))
            k += 2
            continue
        m = _DIRECTIVE.match(line)
        deep = len(line) - len(line.lstrip())
        if m:
            name, rest = m[2], m[3].strip()
            body = k + 1
            while body < n and re.match(r"\s+:[\w-]+:", lines[body]):
                body += 1
            if name in ("code-block", "code", "sourcecode", "parsed-literal", "doctest", "math"):
                end = body
                while end < n and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > deep):
                    end += 1
                out += _fenced(lines[body:end], rest if name != "math" else "math")
                k = end
                continue
            if name in CHANGE_DIRECTIVES:
                out.append(f"*{name} {rest}*".replace("  ", " "))
            elif name in ENTRY_DIRECTIVES:
                out.append(f"**{name}** `{rest}`")
            elif name in ("note", "warning", "tip", "important", "seealso", "caution", "hint", "danger", "attention", "admonition"):
                out.append(f"> **{name.capitalize()}** {inline(rest)}".rstrip())
            elif name in ("image", "figure"):
                out.append(f"![]({rest})")
            k = body
            continue
        if line.lstrip().startswith("..") and (line.strip() == ".." or line.lstrip()[2:3] == " "):
            k += 1  # a comment or a target
            while k < n and lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) > deep:
                k += 1
            continue
        if line.rstrip().endswith("::"):
            head = line.rstrip()[:-2].rstrip()
            if head:
                out.append(inline(head.strip()) + ":")
            end = k + 1
            while end < n and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > deep):
                end += 1
            out += ["", *_fenced(lines[k + 1 : end], "")]
            k = end
            continue
        item = re.match(r"\s*(?:[*+•-]|#\.|\(?\d+[.)])\s+", line)
        if item and line.strip():
            sign = "1." if "#" in item[0] else item[0].strip() if any(c.isdigit() for c in item[0]) else "-"
            out.append(f"{sign} {inline(line[item.end() :].rstrip())}")
        else:
            out.append(inline(line.strip()))
        k += 1
    made = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")
    return made + "\n" if made else ""


def _fenced(lines: list[str], language: str) -> list[str]:
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    cut = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    fence = "```" if not any(x.lstrip().startswith("```") for x in lines) else "````"
    return ["", fence + language, *(x[cut:] for x in lines), fence, ""]


def render_markdown(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(``filename``, ``text``): every document as Markdown under its own name; a null text stays null."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else to_markdown(t) for t in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    made = docs.select(F.col(path_col).cast("string"), F.col(text_col)).mapInArrow(run, "path string, text string")
    return made.select(with_suffix("path", ".md", ".rst").alias("filename"), "text")
