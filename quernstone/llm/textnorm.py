"""Text forms under which differently written copies are equal; plain functions, used inside Arrow stages."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

# Letters of other scripts that look like a Latin letter, each with that letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "ë", "і": "i", "ї": "ï", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
}
_LOOK = str.maketrans(LOOK_ALIKES)
_HAS_LOOK = re.compile(f"[{''.join(LOOK_ALIKES)}]")

#: Characters that print nothing: format characters, variation selectors, fillers, controls other than white space.
INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb"
    "\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\U000e0000-\U000e0fff]+"
)
ANSI = re.compile("\x1b\\[[0-9;?]*[A-Za-z]|\\[[0-9;]+m")
WORD = re.compile(r"\w+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]|\\[[0-9;]+m")


def plain(text: str) -> str:
    """Compatibility form without invisible characters; case is kept."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    elif _CONTROL.search(text):
        text = INVISIBLE.sub("", text)
    return text


def folded_words(text: str) -> list[str]:
    """Words in order, apart from case, punctuation, spacing, width and invisible characters."""
    return WORD.findall(plain(text).casefold())


def file_key(name: str | None) -> str | None:
    """One key for all spellings of a path, or None for a name that names nothing (null, blank, ``unknown.rst``)."""
    if name is None:
        return None
    for _ in range(3):
        name, before = unquote(name), name
        if name == before:
            break
    name = plain(name).strip().casefold().replace("\\", "/")
    parts: list[str] = []
    for p in name.split("/"):
        p = p.strip()
        if p == "..":
            if parts and parts[-1] != "..":
                parts.pop()
            else:
                parts.append(p)
        elif p and p != ".":
            parts.append(p)
    return None if parts in ([], ["unknown.rst"]) else "/".join(parts)


# Ideas that stand for a missing one, as their words.
PLACEHOLDERS = ("todo", "to do", "n a", "na", "tbd", "tba", "fixme", "xxx", "none", "null", "nil", "nan", "placeholder", "wip")


def idea_key(idea: str | None) -> str | None:
    """The words of an idea, or None for a null, blank or placeholder one."""
    if idea is None:
        return None
    key = " ".join(folded_words(idea))
    return None if not key or key in PLACEHOLDERS else key


_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|h[1-6]|hr|pre|table|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\]\[[^\[\]]*\]|\[\^[^\]\s]+\]|\[\[[^\[\]|]*\||\[(?:https?|ftp)://[^\s\]]*")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?=\{)|:[a-z:]+:(?=`)")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>#|*+•·%;:-]|//+|\d{1,4}[.):|]|[a-zA-Z][.)](?=\s)|--+|\.\.)+[ \t]*)+", re.M)
_SPLIT = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def match_words(text: str) -> list[str]:
    """Words for passage matching: case, punctuation, spacing, line breaks and prefixes, inline markup, character
    references, look-alike or differently encoded letters and invisible characters make no difference."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", ANSI.sub("", text)))
    elif _CONTROL.search(text):
        text = INVISIBLE.sub("", ANSI.sub("", text))
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "[" in text:
        text = _LINK.sub(" ", text)
    if "\\" in text or ":`" in text:
        text = _COMMAND.sub(" ", text)
    if "\n" in text:
        text = _PREFIX.sub("", text)
        if "-\n" in text or "-\r" in text or "- \n" in text:
            text = _SPLIT.sub("", text)
    text = text.casefold()
    if not text.isascii():
        if _HAS_LOOK.search(text):
            text = text.translate(_LOOK)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
    words = WORD.findall(text)
    return [w for x in words if (w := x.strip("_"))] if "_" in text else words
