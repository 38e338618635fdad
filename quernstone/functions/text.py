"""Scalar text functions as Catalyst expressions; none of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that Python's str.isspace() accepts.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# What str.splitlines() breaks at.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Characters of a line of code, marks of a line of prose, its openings, the fence of code, the note of a cut.
_CODE_CHARS = r"[=:().\\]"
_MARKS = r"^[#\-*>`]"
_OPENINGS = "^(?:I'm|You|Here)"
_FENCED = r"(?s)```python\s*\n(.*?)```"
_CUT = ("... [truncated, ", " more characters]")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """str.strip(): both ends without any Unicode white space (``trim`` knows U+0020 only)."""
    return F.btrim(_col(c), F.lit(WS))


def is_blank(c: Column | str) -> Column:
    """Whether nothing but white space is left; null for null."""
    return strip(c) == ""


def splitlines(c: Column | str) -> Column:
    """str.splitlines(): no empty element after a final line break, none at all for the empty text."""
    parts = F.split(_col(c), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncate(c: Column | str, limit: int = 12_000) -> Column:
    """At most ``limit`` code points, and how many more there were."""
    c = _col(c)
    more = F.concat(F.substring(c, 1, limit), F.lit(_CUT[0]), (F.length(c) - limit).cast("string"), F.lit(_CUT[1]))
    return F.when(F.length(c) <= limit, c).otherwise(F.when(c.isNotNull(), more))


def strip_prompt(completion: Column | str, prompt: Column | str) -> Column:
    """The completion without the prompt, where it starts with exactly that."""
    completion, prompt = _col(completion), _col(prompt)
    return F.when(F.coalesce(F.startswith(completion, prompt), F.lit(False)), F.substring(completion, F.length(prompt) + 1, F.length(completion))).otherwise(completion)


def longest(items: Column) -> Column:
    """The longest string of an array, the first one on a tie, null if there is none."""
    return F.aggregate(items, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def extract_fence(c: Column | str) -> Column:
    """The longest ```python block, stripped; null if there is none."""
    return strip(longest(F.regexp_extract_all(_col(c), F.lit(_FENCED), F.lit(1))))


def _is_prose(line: Column) -> Column:
    """No character of code and more than ten words."""
    return ~line.rlike(_CODE_CHARS) & (F.size(F.filter(F.split(line, rf"[{_class(WS)}]+"), lambda w: w != "")) > 10)


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def extract_heuristic(c: Column | str) -> Column:
    """The text without leading and trailing lines that read as markup or prose, stripped. A blank line stops the trimming."""
    lines = F.split(strip(c), "\n")
    lead = F.transform(lines, lambda x: x.rlike(_MARKS) | x.rlike(_OPENINGS) | _is_prose(x))
    first = F.array_position(lead, F.lit(False))  # 0: every line goes
    rest = F.slice(lines, first, F.size(lines))
    tail = F.transform(rest, lambda x: x.rlike(_MARKS) | x.contains("---") | _is_prose(x))
    last = F.size(rest) - F.array_position(F.reverse(tail), F.lit(False)) + 1
    kept = F.when(F.array_position(F.reverse(tail), F.lit(False)) == 0, F.lit("")).otherwise(strip(F.array_join(F.slice(rest, 1, last), "\n")))
    return F.when(_col(c).isNull(), F.lit(None).cast("string")).when(first == 0, "").otherwise(kept)


def extract_code(c: Column | str) -> Column:
    """The longest fenced block, else what the line heuristic leaves."""
    return F.coalesce(extract_fence(c), extract_heuristic(c))


def mentions_version(c: Column | str, version: str) -> Column:
    """Whether the version stands in the text as a word of its own: 3.15.1 counts for 3.15; 13.15, 3.150 and v3.15 do not."""
    return _col(c).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){re.escape(version)}(?:[^\p{{L}}\p{{N}}_]|$)")


def tokens(c: Column | str) -> Column:
    """The offline tokenizer: white-space separated words."""
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def response(explanation: Column | str, code: Column | str) -> Column:
    """An explanation followed by its code in a fence."""
    return F.concat(_col(explanation), F.lit("\n\n```python\n"), _col(code), F.lit("\n```"))


def render_context(schema: Column | None, json_prose: Column | None, documents: Column | None, prompt: Column) -> Column:
    """Parts in fixed order parted by empty lines: schema, JSON prose, titled documents, prompt. Null parts drop out;
    ``documents`` is an array of (title, document), whose order is kept."""
    titled = None if documents is None else F.transform(documents, lambda d: F.concat(F.lit("--- "), d["title"], F.lit(" ---\n"), d["document"]))
    parts = [F.array(p) for p in (schema, json_prose) if p is not None] + ([titled] if titled is not None else []) + [F.array(prompt)]
    return F.array_join(F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda p: p.isNotNull()), "\n\n")


def put_document(documents: Column, title: Column, document: Column) -> Column:
    """Adds a titled document; one with a known title replaces the text and keeps its place."""
    known = F.exists(documents, lambda d: d["title"] == title)
    put = F.struct(title.alias("title"), document.alias("document"))
    return F.when(known, F.transform(documents, lambda d: F.when(d["title"] == title, put).otherwise(d))).otherwise(F.concat(documents, F.array(put)))


def base_name(c: Column | str) -> Column:
    """What follows the last slash, or all of it."""
    return F.element_at(F.split(_col(c), "/"), -1)


def with_suffix(c: Column | str, old: str, new: str) -> Column:
    return F.regexp_replace(_col(c), re.escape(old) + "$", new)


def indent(c: Column | str, by: str = "  ") -> Column:
    """textwrap.indent(): lines that are not blank get a prefix."""
    return F.regexp_replace(_col(c), r"(?m)^(?=[^\n]*[^\s])", by)


def path_key(c: Column | str) -> Column:
    """Sort key of paths: component by component."""
    return F.split(_col(c), "/")


def visible(line: Column | str) -> Column:
    """What a terminal shows of a line: the text after its last carriage return."""
    return F.element_at(F.split(_col(line), "\r"), -1)


def log_lines(text: Column | str) -> Column:
    """The lines a log keeps: complete ones only, as shown, without those with escape sequences and blank ones."""
    lines = F.split(_col(text), "\n")
    complete = F.slice(lines, 1, F.size(lines) - 1)
    return F.filter(F.transform(complete, visible), lambda x: ~x.contains("\x1b") & (strip(x) != ""))


def worker_grid(n: Column | str) -> tuple[Column, Column]:
    """(files at once, ideas at once) for a number of workers, as square as it gets."""
    n = _col(n)
    rows = F.floor(F.sqrt(n)).cast("bigint")
    return rows, F.floor(n / rows).cast("bigint")
