"""Sentence boundaries by document-centred disambiguation, with corpus fallback and terminator rules per script."""

from __future__ import annotations

import re
from collections import ChainMap, Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import written

# Titles, taken as abbreviations that end no sentence where documents and corpus say nothing about the word.
TITLES = frozenset("Mr Mrs Ms Mx Dr Prof Rev Hon Gen Col Capt Lt Sgt Sr Sra Srta Dña Mme Mlle M MM Me Hr Fr St No Nos Nr Г-н Г-жа".split())
# Names of months, before which a German day number stands.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

_END = re.compile(r"[.!?…。！？｡．।॥؟۔։።៕។]+")
_WIDE = frozenset("。！？｡．।॥؟۔։።៕។")
_CLOSE = "\"'”’»)]}）］」』】〉》“"
_OPEN = "\"'“‘„«([{（［「『【〈《¿¡*_`"
_PAIR = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "«": "»", "“": "”", "„": "“”", "《": "》", "〈": "〉"}
_QUOTE = re.compile("[\"“”„«»()\\[\\]{}（）［］「」『』【】《》〈〉]")
_LINE = re.compile(r"[^\r\n\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]|\Z)")
_ITEM = re.compile(r"\s*(?:[-*+•◦‣·–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))[ \t\u3000]+(?=\S)")
_HEAD = re.compile(r"\s{0,3}#{1,6}\s")
_RULE = re.compile(r"\s*([=\-~^\"'*+#])\1{2,}\s*\Z")
_IDENT = re.compile(r"[^\W\d]\w*(?:\.\w+)*(?:\(|_\w)|[^\W\d]\w*_\w|[^\W\d]\w*\(")
_THAI = re.compile("[฀-๿]")
_CHUNK = re.compile(r"[^\s\"'“”„«»()\[\]{}（）「」『』,;:]*\Z")
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
_SPACED = re.compile(r"(?<!\w)([^\W\d_]{1,2})\.\s+\Z")
_WORD = re.compile(r"[^\W\d_]+")
_WHOLE = re.compile(r"(?<![\w.])[^\W\d_]++(?!\w)")
#: a word, also one with points inside, with a point after it; the gap behind, and the word or character that follows
_POINTED = re.compile(r"(?<![\w.])([^\W\d_]++(?:\.[^\W\d_]++)*+)\.(?![\w.])(?=(\s*+)(?:([^\W\d_]++)(?![\w(.]*+[_(])[ ,;.]|(\S?)))")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_QUOTED = re.compile("[\"“”„«»「」『』《》]")
_MIDDLE = re.compile(r"(?<=[^\W\d_] )[^\W\d_]++|(?<=, )[^\W\d_]++")

#: what is known about a word: a point after it does not end a sentence by itself; it never ends one; it is written small
#: without a point elsewhere
ABBREVIATION, NEVER_FINAL, ORDINARY = 1, 2, 4


class Observed:
    """Unambiguous occurrences of words: ``total`` of any kind, ``point`` with a point behind, of these ``inner`` before a
    comma, number or small word, and ``final`` at the end of a paragraph. A spaced pair such as ``z. B.`` counts also as
    ``z.b``. Points of paragraphs with quotations are left out, as they may stand inside one."""

    def __init__(self):
        self.total, self.point, self.inner, self.final = Counter(), Counter(), Counter(), Counter()

    def add(self, text: str) -> None:
        self.total.update(_WHOLE.findall(text))
        if "." not in text:
            return
        for part in _PARAGRAPH.split(text):
            if _QUOTED.search(part):
                self.total.subtract(_WHOLE.findall(part))
                continue
            before, end = "", -1
            for m in _POINTED.finditer(part):
                word, gap, follows, c = m.groups()
                keys = [word]
                if len(word) <= 3 and 0 < len(before) <= 2 and m.start() - end == 1:
                    keys.append(f"{before}.{word}".lower())
                    self.total[keys[1]] += 1
                elif "." in word:
                    self.total[word] += 1
                before, end = word, m.end()
                inner = follows.islower() if follows else c in (",", ";") and not gap or c.isdigit() and bool(gap)
                final = not follows and not c
                for k in keys:
                    self.point[k] += 1
                    self.inner[k] += inner
                    self.final[k] += final


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): paragraphs, and list items and headings as wholes; blank lines part them."""
    out: list[list] = []
    at, n, open_ = 0, len(text), False
    while at < n:
        line = _LINE.match(text, at)
        body = line.group()
        end = at + len(body.rstrip())
        if end == at or not body.strip():
            open_ = False
        elif _RULE.match(body) and (open_ or len(body.strip()) > 2):
            if open_ and not out[-1][2] and text.find("\n", out[-1][0], out[-1][1]) < 0 and body.strip()[0] in "=-~^":
                out[-1][2] = True  # an underlined heading
            open_ = False
        elif _HEAD.match(body):
            out.append([at, end, True])
            open_ = False
        elif _ITEM.match(body):
            out.append([at, end, True])
            open_ = True
        elif open_:
            out[-1][1] = end
        else:
            out.append([at, end, False])
            open_ = True
        at = line.end()
    return [tuple(x) for x in out]


def _quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of matched quotes and brackets, outermost."""
    stack: list[tuple[int, str]] = []
    awaited: Counter = Counter()
    out: list[tuple[int, int]] = []
    for m in _QUOTE.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c == '"':
            closes = awaited[c] > 0 and not (i + 1 < b and text[i + 1].isalnum() and (i == a or text[i - 1].isspace()))
            want = '"'
        else:
            closes, want = awaited[c] > 0, _PAIR.get(c, "")
        if closes:
            while stack:
                start, wanted = stack.pop()
                awaited.subtract(wanted)
                if c in wanted:
                    out.append((start, i))
                    break
        elif want:
            stack.append((i, want))
            awaited.update(want)
    out.sort()
    outer: list[tuple[int, int]] = []
    for s in out:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


class Document:
    """What unambiguous occurrences in the document tell; what they leave open, the corpus decides."""

    def __init__(self, text: str, corpus: dict[str, int]):
        self.text, self.corpus = text, corpus
        self._words: set[str] | None = None
        self._names: set[str] | None = None
        self._seen: Observed | None = None

    def about(self, word: str) -> int:
        """ABBREVIATION and NEVER_FINAL of the word before a point."""
        if self._seen is None:
            self._seen = Observed()
            self._seen.add(self.text)
        inner = self._seen.inner.get(word, 0)
        known = self.corpus.get(word)
        if known is None and word != word.lower():
            known = self.corpus.get(word.lower())
        if known is None:
            known = ABBREVIATION | NEVER_FINAL if word in TITLES else 0
        return known & (ABBREVIATION | NEVER_FINAL) | (inner >= 2 and inner * 2 > self._seen.total[word])

    def written_small(self, word: str) -> bool:
        low = word.lower()
        if self._words is None:
            self._words = set(_WORD.findall(self.text))
        return low in self._words or bool(self.corpus.get(low, 0) & ORDINARY)

    def starts(self, word: str) -> bool:
        """Whether a capitalised word is an ordinary one, written small elsewhere, and so capitalised as it starts a
        sentence; one that is capitalised inside sentences of this document, and never small in it, is a name."""
        if self._names is None:
            self._names = set(_MIDDLE.findall(self.text))
        return self.written_small(word) and (word not in self._names or word.lower() in self._words)


def ends(text: str, corpus: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of every sentence."""
    out: list[tuple[int, int]] = []
    doc = Document(text, corpus)
    for a, b, whole in blocks(text):
        start = a
        if not whole:
            if _THAI.search(text, a, b):
                for m in re.compile(r"\S+").finditer(text, a, b):
                    out.append((m.start(), m.end()))
                out = _join_thai(text, out, a)
                continue
            for end in _inner_ends(text, a, b, doc):
                if end < b:
                    out.append((start, end))
                    start = end
        out.append((start, b))
    clean = []
    for s, e in out:
        while s < e and (text[s].isspace() or not text[s].isprintable()):
            s += 1
        while e > s and (text[e - 1].isspace() or not text[e - 1].isprintable()):
            e -= 1
        if s < e:
            clean.append((s, e))
    return clean


def _join_thai(text: str, spans: list[tuple[int, int]], a: int) -> list[tuple[int, int]]:
    """Blanks between two words of another script do not part a Thai sentence."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and out[-1][0] >= a and s >= a:
            left, right = text[out[-1][0] : out[-1][1]], text[s:e]
            if not _THAI.search(left) and not _END.search(left[-1]) or not _THAI.search(right) and not _THAI.search(left):
                out[-1] = (out[-1][0], e)
                continue
        out.append((s, e))
    return out


def _inner_ends(text: str, a: int, b: int, doc: Document):
    spans, k = None, 0
    for m in _END.finditer(text, a, b):
        i, e = m.start(), m.end()
        mark, wide = m.group(), m.group()[-1] in _WIDE
        if e >= b:
            break
        nxt = text[e]
        if mark == "." and not nxt.isspace() and (nxt.islower() or nxt.isdigit() or nxt in "_/,;:-=@&"):
            continue
        if spans is None:
            spans = _quoted(text, a, b)
        while k < len(spans) and spans[k][1] < i:
            k += 1
        closed = False
        if k < len(spans) and spans[k][0] < i:
            # inside a quotation or bracket: only an end mark right before its close can end the sentence
            if spans[k][1] != e:
                continue
            e, closed = e + 1, True
        while e < b and text[e] in "\"'”’»)]）」』】" and not (text[e] == '"' and k + closed < len(spans) and spans[k + closed][0] == e):
            e, closed = e + 1, True
        j = e
        while j < b and text[j].isspace():
            j += 1
        if j >= b:
            break
        gap = j > e
        o = j
        while o < b and (text[o] in _OPEN or not text[o].isprintable()):
            o += 1
        c = text[o] if o < b else ""
        opened = o > j
        lower = c.islower()
        ident = bool(lower and _IDENT.match(text, o, b))
        starts = c.isalpha() and (not lower or ident)
        if wide:
            # scripts whose end marks need no blank; a quotation closed before a particle or comma goes on
            if not closed or gap or opened or not (c.isalpha() or c in "，、,—–"):
                yield e
            continue
        if not gap:
            if closed:
                if starts and not lower:
                    yield e
            elif "." == mark:
                prev = text[i - 1] if i > a else " "
                chunk = _CHUNK.search(text, max(a, i - 40), i).group()
                single = len(chunk) >= 1 and (len(chunk) < 2 or not chunk[-2].isalnum()) and chunk[-1].isalpha() and chunk[-1].isupper()
                if (c.isupper() or c.isalpha() and not lower or text[j] in "¿¡«“„") and (prev.isalnum() or prev in _CLOSE or prev in "%°€$") and not single:
                    if not doc.about(chunk):
                        yield e
            elif starts or text[j] in "¿¡«“„(":
                if ident or not lower:
                    yield e
            continue
        if closed:
            if starts or c.isdigit() or opened and c.isalpha() and not lower:
                yield e
            continue
        if mark[-1] in "!?":
            if starts or c.isdigit() or opened or not c.isalpha() and c not in "—–-,;":
                yield e
            continue
        if len(mark) > 1 or mark == "…":
            if starts and not lower and i > a and not text[i - 1].isspace():
                yield e
            continue
        # a single point and a blank
        chunk = _CHUNK.search(text, max(a, i - 40), i).group()
        before = _SPACED.search(text, max(a, i - len(chunk) - 8), i - len(chunk)) if 0 < len(chunk) <= 3 else None
        word = _WORD.match(text, o, b)
        follows = word.group() if word else ""
        if chunk.isdigit() and len(chunk) <= 2 and (follows.lower() in MONTHS):
            continue
        about = doc.about(chunk) | (doc.about(f"{before[1]}.{chunk}".lower()) if before else 0)
        if about & NEVER_FINAL:
            continue
        if len(chunk) == 1 and chunk.isalpha() or before and len(before[1]) <= 2 and chunk.isalpha():
            # an initial, or a spaced abbreviation; one before an ordinary word ends a sentence
            if starts and not lower and doc.starts(follows) and (not chunk.isupper() if before else chunk.isupper()):
                yield e
            continue
        if _ACRONYM.match(chunk):
            if starts and (lower or doc.starts(follows)):
                yield e
            continue
        if about & ABBREVIATION:
            if starts and not lower and doc.starts(follows):
                yield e
            continue
        if starts or c.isdigit() or opened:
            yield e
        elif lower and len(chunk) > 2 and chunk.isalpha() and (len(chunk) > 5 or doc.written_small(chunk)):  # carelessly written; long words are no abbreviations
            yield e


def corpus_evidence(df: DataFrame, text_col: str = "text", share: float = 0.5, rare: float = 0.2, least: int = 3) -> DataFrame:
    """(``word``, ``n``, ``about``): what the occurrences in all texts tell about words, in the bits ABBREVIATION, NEVER_FINAL
    and ORDINARY; words that nothing is known about are left out.

    Occurrences are counted per partition and then summed (:class:`Observed`). At least ``share`` of a word's occurrences
    must be evidence of an abbreviation. A word that always has its point, and stands at paragraph ends less than ``rare``
    times as often as points do on the whole, never ends a sentence, if at least ``least`` such ends were to be expected;
    ``least`` occurrences are asked for in every case.
    """

    def record(seen):
        words = list(seen.total.keys() | seen.point.keys())
        counters = (seen.total, seen.point, seen.inner, seen.final)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counters)], ["word", "total", "point", "inner", "final"])

    def count(batches):
        seen = Observed()
        for b in batches:
            if len(seen.total) > 200_000:  # handed on early, to be summed with the rest
                yield record(seen)
                seen = Observed()
            for text in b.column(0).to_pylist():
                if text:
                    seen.add(text)
        yield record(seen)

    counts = (
        df.select(text_col)
        .mapInArrow(count, "word string, total bigint, point bigint, inner bigint, final bigint")
        .groupBy("word")
        .agg(*(F.sum(c).alias(c) for c in ("total", "point", "inner", "final")))
    )
    counts = written(counts, "words")
    sums = counts.agg(F.sum("point").alias("point"), F.sum("final").alias("final")).first()
    usual = F.col("point") * ((sums["final"] or 0) / max(1, sums["point"] or 0))
    pointed = (F.col("point") >= share * F.col("total")) | (F.col("inner") >= 0.9 * F.col("point"))
    never = (usual >= least) & (F.col("final") <= rare * usual) & pointed & (F.col("point") >= least)
    abbreviation = never | (F.col("inner") >= least) & (F.col("inner") >= share * F.col("total"))
    ordinary = (F.col("total") - F.col("point") >= least) & (F.lower("word") == F.col("word"))
    bits = F.when(never, NEVER_FINAL).otherwise(0) + F.when(abbreviation, ABBREVIATION).otherwise(0) + F.when(ordinary, ORDINARY).otherwise(0)
    return counts.select("word", F.greatest("total", "point").alias("n"), bits.alias("about")).where("about > 0")


def _asked(text: str) -> set[str]:
    """All words about which splitting the text may ask the corpus."""
    out: set[str] = set()
    for m in _END.finditer(text):
        chunk = _CHUNK.search(text, max(0, m.start() - 40), m.start()).group()
        before = _SPACED.search(text, max(0, m.start() - len(chunk) - 8), m.start() - len(chunk))
        word = _WORD.search(text, m.end())
        for w in (chunk, f"{before[1]}.{chunk}".lower() if before else "", word.group() if word else ""):
            out.update((w, w.lower()))
    return out - {""}


def split_sentences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: DataFrame | None = None, with_text: bool = True, most: int = 200_000
) -> DataFrame:
    """(`id_col`, ``sentence``, ``start``, ``end``[, ``sentence_text``]): the sentences of every document in order, from 0;
    ``end`` counts the code points up to and including a sentence's last character.

    Null, empty and blank texts have no sentences; a text without end marks is one sentence per paragraph; very long
    texts are handled whole. Headings and list items are one sentence each, blank lines end one. Repeated rows are split
    alike, an empty table gives an empty table, other columns are ignored. ``evidence`` comes from
    :func:`corpus_evidence`, by default over the same texts. At most ``most`` words of it, the most frequent, are broadcast;
    what documents need of the others is joined to them.
    """
    if evidence is None:
        evidence = corpus_evidence(df, text_col)
    sums = evidence.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    every = sums["words"] <= most
    # a share of 1 / most of all occurrences is held by at most ``most`` words
    often = evidence if every else evidence.where(F.col("n") >= F.lit(sums["n"] / most))
    shared = df.sparkSession.sparkContext.broadcast({r["word"]: r["about"] for r in often.select("word", "about").toLocalIterator()})
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "sentence", "start", "end", *["sentence_text"] * with_text]
    schema = f"`{id_col}` {kind}, sentence int, start int, end int" + ", sentence_text string" * with_text

    def split(batches):
        for b in batches:
            more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            rows = [
                (i, k, s, e, *[t[s:e]] * with_text)
                for i, t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), more)
                if t
                for k, (s, e) in enumerate(ends(t, ChainMap(dict(m), shared.value) if m else shared.value))
            ]
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [b.column(0).type, *[pa.int32()] * 3, *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    texts = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    if every:
        return texts.mapInArrow(split, schema)

    def ask(batches):
        for b in batches:
            keys, words = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                open_ = [w for w in _asked(t) if w not in shared.value] if t else []
                keys += [key] * len(open_)
                words += open_
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["__key", "word"])

    keyed = texts.select("*", F.sha2("__text", 256).alias("__key"))
    asked = keyed.select("__key", "__text").mapInArrow(ask, "__key string, word string").distinct()
    told = asked.join(evidence.where(F.col("n") < F.lit(sums["n"] / most)), "word").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("word", "about"))).alias("__more"))
    return keyed.join(told, "__key", "left").select(id_col, "__text", "__more").mapInArrow(split, schema)
