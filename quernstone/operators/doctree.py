"""Version changes in reStructuredText: node table, enclosing sections, line ranges, extracted texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import LINE_BREAK, mentions_version, splitlines, strip

NODE_SCHEMA = (
    "document string, node_id int, parent_id int, ordinal int, kind string, line int, source string, text string, "
    "ancestors array<struct<id:int,kind:string>>"
)
# Directives that document one API entry, and those that note a change.
ENTRY_DIRECTIVES = frozenset("function class method staticmethod classmethod decorator decoratormethod data attribute property exception module opcode cfunction macro type var member struct describe object option envvar program pdbcommand".split())
CHANGE_DIRECTIVES = frozenset("versionadded versionchanged versionremoved deprecated deprecated-removed".split())

_DIRECTIVE = re.compile(r"^(\s*)\.\.\s+(?:[a-z]+:)?([\w-]+)::\s*(.*)$")
_UNDERLINE = re.compile(r"^([=\-~^\"'`#*+<>_:.])\1{2,}\s*$")
_BREAK = re.compile(LINE_BREAK)


def parse_rst(text: str) -> list[tuple]:
    """Nodes in document order: (node_id, parent_id, ordinal, kind, line, source, text, ancestors).

    Lines count from 1; a section's line is that of its title's underline. Kinds are ``document``, ``section``, ``desc``
    (an API entry), ``versionmodified``, ``paragraph``, ``literal`` and the names of other directives. Content of code and
    literal blocks is not parsed.
    """
    lines = _BREAK.split(text)
    if lines and not lines[-1]:
        lines.pop()
    nodes: list[list] = [[0, None, 0, "document", None, None, ""]]
    children = [0]
    stack: list[tuple[int, int, int]] = [(0, -1, -1)]  # node, indentation of its content, section level
    levels: list[str] = []

    def add(parent: int, kind: str, line: int, body: str) -> int:
        nodes.append([len(nodes), parent, children[parent], kind, line, None, body])
        children[parent] += 1
        children.append(0)
        return len(nodes) - 1

    k, n = 0, len(lines)
    while k < n:
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        deep = len(line) - len(line.lstrip())
        while len(stack) > 1 and stack[-1][2] < 0 and deep < stack[-1][1]:
            stack.pop()
        m = _DIRECTIVE.match(line)
        if m:
            name, body = m[2], [m[3]]
            end = k + 1
            while end < n and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > deep):
                body.append(lines[end].strip())
                end += 1
            kind = "versionmodified" if name in CHANGE_DIRECTIVES else "desc" if name in ENTRY_DIRECTIVES else "literal" if name in ("code-block", "code", "sourcecode", "parsed-literal", "math", "productionlist", "doctest") else name
            node = add(stack[-1][0], kind, k + 1, " ".join(x for x in body if x))
            if kind == "literal":
                k = end
            else:
                stack.append((node, deep + 1, -1))
                k += 1
            continue
        if line.lstrip().startswith(".. ") or line.strip() == "..":  # comment or target
            k += 1
            while k < n and lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) > deep:
                k += 1
            continue
        if deep == 0 and k + 1 < n and (u := _UNDERLINE.match(lines[k + 1])) and not _UNDERLINE.match(line):
            while len(stack) > 1 and stack[-1][2] < 0:
                stack.pop()
            if u[1] not in levels:
                levels.append(u[1])
            level = levels.index(u[1])
            del levels[level + 1 :]
            while len(stack) > 1 and stack[-1][2] >= level:
                stack.pop()
            node = add(stack[-1][0], "section", k + 2, line.strip())
            stack.append((node, 0, level))
            k += 2
            continue
        if _UNDERLINE.match(line):
            k += 1
            continue
        start, body = k, []
        while k < n and lines[k].strip() and not _DIRECTIVE.match(lines[k]) and len(lines[k]) - len(lines[k].lstrip()) >= min(deep, 1):
            body.append(lines[k].strip())
            k += 1
            if k + 1 < n and _UNDERLINE.match(lines[k + 1]) and lines[k].strip() and not lines[k].startswith(" "):
                break
        add(stack[-1][0], "paragraph", start + 1, " ".join(body))
        if body and body[-1].endswith("::"):
            first = k
            while k < n and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > deep):
                k += 1
            if k > first:
                add(stack[-1][0], "literal", first + 1, "")
    out = []
    for node in nodes:
        up, at = [], node[1]
        while at is not None:
            up.append({"id": at, "kind": nodes[at][3]})
            at = nodes[at][1]
        out.append((*node, up))
    return out


def doctree(docs: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """The node table of every document; null texts have no nodes."""

    def run(batches):
        for b in batches:
            rows = [(d, *node) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for node in parse_rst(t)]
            columns = list(zip(*rows)) or [[]] * 9
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([("id", pa.int32()), ("kind", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in NODE_SCHEMA.split(", ")[:9]])

    return docs.select(F.col(name_col).cast("string"), F.col(text_col)).mapInArrow(run, NODE_SCHEMA)


def enclosing(ancestors: Column) -> tuple[Column, Column]:
    """(whether the nearest ancestor that is an entry or a section is an entry, id of the nearest of that kind or null)."""
    either = F.filter(ancestors, lambda a: a["kind"].isin("desc", "section"))
    entry = F.coalesce(F.try_element_at(either, F.lit(1))["kind"] == "desc", F.lit(False))
    wanted = F.when(entry, "desc").otherwise("section")
    return entry, F.try_element_at(F.filter(ancestors, lambda a: a["kind"] == wanted), F.lit(1))["id"]


def line_ranges(nodes: DataFrame) -> DataFrame:
    """(``document``, ``node_id``, ``start``, ``end``): half-open, 0-based ranges of entries and sections.

    A range ends before the next sibling that has a line and comes from the file (a source in angle brackets is
    synthetic); with none it runs to the end of the file, shown as null. A section starts at its title, one above its line.
    """
    held = nodes.select("document", F.explode(F.concat(F.array(F.col("node_id")), F.col("ancestors.id"))).alias("node_id"), F.col("node_id").alias("at"), "line")
    first = held.where("line is not null").groupBy("document", "node_id").agg((F.min_by("line", "at") - 1).alias("first"))
    placed = nodes.join(first, ["document", "node_id"], "left")
    begin = F.col("first") - F.when(F.col("kind") == "section", 1).otherwise(0)
    usable = F.when(F.coalesce(F.col("source").startswith("<"), F.lit(False)), None).otherwise(begin)
    after = Window.partitionBy("document", "parent_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    ranged = placed.select("document", "node_id", "kind", begin.alias("start"), F.first(usable, ignorenulls=True).over(after).alias("end"))
    return ranged.where("kind in ('desc', 'section')").drop("kind")


def clamp(start: Column, end: Column, at: Column, entry: Column, longest: int = 500, half: int = 100) -> tuple[Column, Column]:
    """A range over ``longest`` lines that is no entry shrinks to ``half`` lines before and after a line."""
    far = ~entry & (end - start > longest)
    return F.when(far, F.greatest(start, at - half)).otherwise(start), F.when(far, F.least(end, at + half)).otherwise(end)


def changed_sections(docs: DataFrame, version: str, name_col: str, text_col: str, longest: int = 500, half: int = 100) -> DataFrame:
    """(``document``, ``section_id``, ``note_id``, ``is_entry``, ``start``, ``end``, ``text``, ``blank``): the sections and
    entries with a change note that names the version, each once, by its first note, whose node is ``note_id``. Notes outside any section are left out."""
    nodes = doctree(docs, name_col, text_col)
    entry, section = enclosing(F.col("ancestors"))
    notes = (
        nodes.where((F.col("kind") == "versionmodified") & mentions_version("text", version))
        .select("document", "node_id", "line", entry.alias("is_entry"), section.alias("section_id"))
        .where("section_id is not null")
        .groupBy("document", "section_id")
        .agg(F.min_by(F.struct("is_entry", "line", F.col("node_id").alias("note_id")), "node_id").alias("note"))
        .select("document", "section_id", "note.*")
    )
    ranges = line_ranges(nodes).withColumnRenamed("node_id", "section_id")
    lines = docs.select(F.col(name_col).cast("string").alias("document"), splitlines(text_col).alias("lines"))
    found = notes.join(ranges, ["document", "section_id"]).join(lines, "document").withColumn("end", F.coalesce("end", F.size("lines")))
    start, end = clamp(F.col("start"), F.col("end"), F.col("line") - 1, F.col("is_entry"), longest, half)
    text = F.array_join(F.slice("lines", F.col("start") + 1, F.greatest(F.lit(0), F.col("end") - F.col("start"))), "\n")
    return (
        found.select("document", "section_id", "note_id", "is_entry", "lines", start.alias("start"), end.alias("end"))
        .withColumn("text", text)
        .select("document", "section_id", "note_id", "is_entry", "start", "end", "text", (strip("text") == "").alias("blank"))
    )


def change_documents(sections: DataFrame) -> DataFrame:
    """(``document``, ``text``): the sections of a document in the order of their first notes, parted by rules; documents in
    order of their names."""
    ordered = F.array_sort(F.collect_list(F.struct("note_id", "section_id", "text")))
    return sections.groupBy("document").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n----\n\n").alias("text")).orderBy("document")
