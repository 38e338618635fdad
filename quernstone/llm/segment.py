"""Cutting oversized texts at topic boundaries: lexical-cohesion valleys between blocks, with overlap."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.S)
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|\w+")
_SENTENCE_END = re.compile(r"[.!?…।][\"'”’»)\]]*(?=\s)|[。！？][」』”’）]*")


def blocks(text: str) -> list[tuple[int, int]]:
    """(first character, end) of every block: lines not parted by a blank line, a code fence never parted."""
    out: list[tuple[int, int]] = []
    start = end = -1
    fence, at, n = "", 0, len(text)
    while at < n:
        line = _LINE.match(text, at)
        body = line.group().rstrip("\r\n")
        if body.strip() or fence:
            if start < 0:
                start = at
            if body.strip():
                end = at + len(body)
            m = _FENCE.match(body)
            if m and fence:
                if m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                    fence = ""
            elif m and not (m[1][0] == "`" and "`" in m[2]):
                fence = m[1]
        elif start >= 0:
            out.append((start, end))
            start = -1
        at = line.end()
    if start >= 0:
        out.append((start, n if fence else end))
    return out


def valley_depths(text: str, parts: list[tuple[int, int]], width: int = 3) -> list[float]:
    """For each part after the first: how deep lexical similarity falls at its start. Similarity is the cosine of the
    word counts of ``width`` blocks on either side; depth is the climb to the nearest peaks on both sides."""
    bags = [Counter(w.casefold() for w in _WORD.findall(text, a, b)) for a, b in parts]
    similar = []
    for k in range(1, len(bags)):
        left, right = Counter(), Counter()
        for b in bags[max(0, k - width) : k]:
            left.update(b)
        for b in bags[k : k + width]:
            right.update(b)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        similar.append(sum(v * right[w] for w, v in left.items() if w in right) / norm if norm else 0.0)
    n = len(similar)
    peak_left, peak_right = similar[:], similar[:]
    for k in range(1, n):
        if similar[k - 1] >= similar[k]:
            peak_left[k] = peak_left[k - 1]
    for k in range(n - 2, -1, -1):
        if similar[k + 1] >= similar[k]:
            peak_right[k] = peak_right[k + 1]
    return [a + b - 2 * s for a, b, s in zip(peak_left, peak_right, similar)]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap, cut): the cores ``text[start:end]`` follow one another and cover the text; a piece is
    ``text[start - overlap:end]`` and has at most ``limit`` code points. ``cut`` tells where the piece starts: ``first``,
    ``between`` two blocks or ``inside`` one, which happens only to blocks longer than the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "first")] if n else []
    parts = blocks(text)
    depths = [0.0, *valley_depths(text, parts)]
    out, at, back, cut, k = [], 0, 0, "first", 0
    while n - at > limit - back:
        while k < len(parts) and parts[k][1] <= at:
            k += 1
        room = at + limit - back
        # block starts and ends that the piece can reach
        starts, last_end, j = [], -1, k
        while j < len(parts) and parts[j][0] <= room:
            if parts[j][0] > at:
                starts.append((depths[j], parts[j][0]))
            if parts[j][1] <= room:
                last_end = parts[j][1]
            j += 1
        late = [x for x in starts if x[1] > at + (limit - back) // 2]
        inside = k < len(parts) and parts[k][0] <= at
        if late:
            to, now = max(late)[1], "between"
        elif starts and (last_end < 0 or starts[-1][1] > last_end):
            to, now = starts[-1][1], "between"
        elif last_end > at:
            to, now = last_end, "between"
        elif starts:
            to, now = starts[-1][1], "between"
        elif not inside:  # white space fills the room
            to, now = room, "between"
        elif back and parts[k][1] - at <= limit:  # the block fits with less overlap
            back = max(0, limit - (parts[k][1] - at))
            to, now = parts[k][1], "between"
        else:
            to, now = _inner_cut(text, at, room), "inside"
        out.append((at, to, back, cut))
        at, cut = to, now
        back = overlap
        if back:
            head = max(at - back, 0)
            m = re.compile(r"(?<=\s)\S").search(text, head, at)
            back = at - (m.start() if m and head else head)
    out.append((at, n, back, cut))
    return out


def _inner_cut(text: str, at: int, room: int) -> int:
    """The last line end, else sentence end, else blank, in the later half of the room, else its end."""
    half = at + (room - at) // 2
    line = text.rfind("\n", half, room)
    if line >= half:
        return line + 1
    last = None
    for last in _SENTENCE_END.finditer(text, half, room):
        pass
    if last:
        return last.end()
    blank = max(text.rfind(" ", half, room), text.rfind("\t", half, room))
    return blank + 1 if blank >= half else room


def cut_oversized(
    df: DataFrame, id_col: str = "cpt_id", text_col: str = "text", limit: int = 6000, overlap: int = 200
) -> DataFrame:
    """(`id_col`, ``piece``, ``start``, ``end``, ``overlap``, ``cut``, ``n_chars``, ``piece_text``): every text as pieces of
    at most ``limit`` code points, numbered from 0, cut at the deepest cohesion valley of each size window.

    ``overlap`` code points of the piece before are put in front (fewer where a word or a block would not fit whole);
    the cores ``[start, end)`` give the text back exactly. A text within the limit is one piece; null and empty texts
    have none; a blank text is cut as white space. Repeated rows are cut alike, an empty table gives an empty table,
    other columns are ignored. Rows are handled where they lie, without a shuffle.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must lie between 0 and half the limit")
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "end", "overlap", "cut", "n_chars", "piece_text"]
    schema = f"`{id_col}` {kind}, piece int, start int, end int, overlap int, cut string, n_chars int, piece_text string"

    def cut(batches):
        for b in batches:
            rows = [
                (i, k, s, e, o, c, e - s + o, t[s - o : e])
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                if t
                for k, (s, e, o, c) in enumerate(pieces(t, limit, overlap))
            ]
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [b.column(0).type, *[pa.int32()] * 4, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return df.select(id_col, text_col).mapInArrow(cut, schema)


def oversized(df: DataFrame, id_col: str = "cpt_id", **options) -> DataFrame:
    """(`id_col`, ``cut``): the texts that had to be cut, ``inside`` if any cut fell inside a block, else ``between``."""
    got = cut_oversized(df, id_col, **options).where(F.col("piece") > 0).select(id_col, "cut")
    return got.groupBy(id_col).agg(F.max(F.col("cut") == "inside").alias("in")).select(id_col, F.when(F.col("in"), "inside").otherwise("between").alias("cut"))
