"""Byte-level BPE as a deterministic tokenization automaton.

Merges are compiled in rank order by merge gadgets. A gadget for the merge ``(u, v) -> w`` removes the arc ``v`` from
every state entered by ``u`` and gives the states that had the path ``u v`` the direct arc ``w``; the state behind ``w``
keeps the arcs that the state behind ``v`` had at that time. The automaton that remains after the last merge accepts
exactly the token sequences that BPE produces. A state is named by the token that enters it (states entered by one
token allow the same arcs), so its arcs need not be stored one by one: the gadget tables (`left`, `right`, `pair`)
decide whether an arc exists and `arcs` keeps the answer. The tables have one entry per token of the vocabulary.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path


def unicode_class(major: str, most: int = sys.maxunicode) -> str:
    """The characters up to ``most`` of one major category as ranges of a character class."""
    out, start = [], None
    for c in range(most + 2):
        hit = c <= most and unicodedata.category(chr(c))[0] == major
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


#: Unicode White_Space (``str.isspace`` has four control characters more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(3)
def pre_splitter(most: int) -> re.Pattern:
    """The splitting pattern for texts without characters beyond ``most``; small classes match many times faster."""
    letter, number = unicode_class("L", most), unicode_class("N", most)
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranked = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranked[i] for i in range(len(ranked))]


def compile_gadgets(tokens: list[bytes]) -> dict:
    """Applies the merge gadgets in rank order; the two parts of a token are those its own merge joined."""
    ids = {t: i for i, t in enumerate(tokens)}
    left, right, pair = array("i", [0]) * len(tokens), array("i", [0]) * len(tokens), {}
    automaton = Automaton({"ids": ids, "left": left, "right": right, "pair": pair})
    for w, token in enumerate(tokens):
        if len(token) == 1:
            left[w] = right[w] = w
            continue
        # the word's path in the automaton of the merges so far has two arcs; they are the operands of this merge
        for cut in range(1, len(token)):
            u, v = ids.get(token[:cut]), ids.get(token[cut:])
            if u is not None and v is not None and u < w and v < w and automaton.arc(u, v):
                left[w], right[w], pair[u << 17 | v] = u, v, w
                automaton.arcs.clear()
                break
        else:
            raise ValueError(f"token {w} is no merge of two earlier tokens")
    return {"ids": ids, "left": left, "right": right, "pair": pair}


class Automaton:
    """Table-driven transitions over the compiled gadgets; picklable through its tables."""

    def __init__(self, tables: dict, most_cached: int = 200_000):
        self.ids, self.left, self.right, self.pair = (tables[k] for k in ("ids", "left", "right", "pair"))
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        #: the longest arc label by its first two bytes
        self.longest: dict[bytes, int] = {}
        for text in self.ids:
            if len(text) > self.longest.get(text[:2], 0):
                self.longest[text[:2]] = len(text)
        self.most_cached = most_cached
        self.labels: list[bytes] | None = None

    def arc(self, state: int, token: int) -> bool:
        """Whether the state entered by one token has an arc for another: no gadget joined a right part of the first
        with a left part of the second while both were whole."""
        key = state << 17 | token
        known = self.arcs.get(key)
        if known is None:
            left, right, pair = self.left, self.right, self.pair
            u, v, limit, known = state, token, 1 << 30, True
            while True:
                w = pair.get(u << 17 | v)
                if w is not None and w < limit:
                    known = False
                    break
                # undo the later of the two merges
                if u > v:
                    limit = u
                    u = right[u]
                    if u == limit:  # a byte: nothing to undo on this side
                        limit = v + 1
                        v = left[v]
                        if v + 1 == limit:
                            break
                else:
                    limit = v + 1
                    v = left[v]
                    if v + 1 == limit:
                        limit = u
                        u = right[u]
                        if u == limit:
                            break
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def word(self, data: bytes) -> list[int]:
        """The one accepted path that spells ``data``: longest arcs first, stepping back where a state has no arc."""
        ids, n = self.ids, len(data)
        whole = ids.get(data)
        if whole is not None:
            return [whole]
        longest, arcs, arc = self.longest, self.arcs, self.arc
        path, at, dead, state, k = [], 0, set(), -1, None
        while at < n:
            if k is None:
                k = min(n - at, longest.get(data[at : at + 2], 1))
            while k:
                t = ids.get(data[at : at + k])
                if t is not None and at + k not in dead:
                    if state < 0:
                        break
                    known = arcs.get(state << 17 | t)
                    if known or known is None and arc(state, t):
                        break
                k -= 1
            if k:
                path.append(t)
                at, state, k = at + k, t, None
            else:  # no arc leads on from here
                dead.add(at)
                k = len(self.label(path.pop()))
                at -= k
                k -= 1
                state = path[-1] if path else -1
        return path

    def label(self, token: int) -> bytes:
        if self.labels is None:
            self.labels = [b""] * len(self.ids)
            for text, i in self.ids.items():
                self.labels[i] = text
        return self.labels[token]

    def decode(self, path) -> bytes:
        """Emits the labels of the arcs."""
        return b"".join(map(self.label, path))

    def _chunk(self, text: str) -> bytes:
        out, words = [], self.words
        most = 0x7F if text.isascii() else 0xFFFF if max(text) <= "\uffff" else sys.maxunicode
        for w in pre_splitter(most).findall(text):
            got = words.get(w)
            if got is None:
                got = array("i", self.word(w.encode("utf-8", "surrogatepass"))).tobytes()
                if len(w) <= 64:
                    if len(words) >= self.most_cached:
                        words.clear()
                    words[w] = got
            out.append(got)
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as native 32-bit integers. It is first cut before single blanks between two other
        characters: no alternative of the splitting pattern crosses such a point, so the chunks are independent and
        repeated ones come from a table."""
        if not text:
            return b""
        parts = _LONE.split(text) if _RUN.search(text) else text.split(" ")
        out, chunks = [self._chunk(parts[0])], self.chunks
        known = chunks.get
        for p in parts[1:]:
            got = known(p)
            if got is None:
                got = self._chunk(" " + p)
                if len(p) <= 64:
                    if len(chunks) >= self.most_cached:
                        chunks.clear()
                    chunks[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def count(self, text: str) -> int:
        return len(self.encode_bytes(text)) // 4


_RUN = re.compile(f" [{SPACE}]| $")
_LONE = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
