"""Defects of prompt and response pairs: clauses tagged by a conditional random field, coverage summed to a defect."""

from __future__ import annotations

import bisect
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.crf import Crf
from quernstone.llm.language import scores
from quernstone.llm.refusals import LEADS, POLITE, TAILS, Wording
from quernstone.llm.refusals import wording as refusal
from quernstone.llm.textnorm import INVISIBLE, plain

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

# Names of languages in several languages, by code.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés английском английски 英語 英语 英文",
    "de": "german deutsch deutsche allemand alemán немецком немецки ドイツ語 德语 德文",
    "fr": "french französisch französische français francés французском французски フランス語 法语 法文",
    "es": "spanish spanisch spanische espagnol español испанском испански スペイン語 西班牙语 西班牙文",
    "ru": "russian russisch russische russe ruso русском русски ロシア語 俄语 俄文",
    "ja": "japanese japanisch japanische japonais japonés японском японски 日本語 日语 日文",
    "zh": "chinese chinesisch chinesische chinois chino китайском китайски 中国語 中文 汉语",
    "ar": "arabic arabisch arabe árabe арабском арабски アラビア語 阿拉伯语",
    "hi": "hindi हिन्दी हिंदी хинди ヒンディー語 印地语",
    "th": "thai thailändisch thaï tailandés тайском тайски タイ語 泰语",
}
_NAMES = {n: code for code, names in LANGUAGE_NAMES.items() for n in names.split()}
_NAME = re.compile("|".join(rf"\b{n}\b" if n[0] < "　" else n for n in sorted(_NAMES, key=len, reverse=True)))

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
_CUT = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+(?=[^\sa-zа-яà-ÿ])|(?<=[。！？])[」』”’）]*(?=\S)")
_ENDED = re.compile(r"[.!?…。！？।؟۔][\"'”’“»)\]」』】）*_`]*\Z")
_STUB = re.compile(
    r"(?:\b(?-i:Mr|Mrs|Ms|Dr|Prof|No|M|Sr|Sra)\.|\b(?:cf|vs|nr|approx|e\.g|i\.e|fig|ca|env|aprox|abschn|z|p|eq|vol)\.|\s\.{2,}|\s…|\s[a-z]\.|(?:\b(?:in|python|version|versión|seit|desde|depuis|since|v|с|версии)\s?)\d\.)\Z", re.I
)
_LISTED = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_URL_LINE = re.compile(r"[ \t<(]*https?://\S+[ \t]*\Z")


class Clause:
    __slots__ = ("text", "kind", "weight")

    def __init__(self, text: str, kind: str):
        self.text, self.kind = text, kind
        self.weight = sum(map(str.isalnum, text))


def clauses(text: str) -> list[Clause]:
    """Clauses of a response: sentences, list items, table rows, addresses, and each code block as one; ``open`` is a
    code block without its end. Clauses without a letter or digit are dropped, but for a code block left open."""
    out: list[Clause] = []
    paragraph: list[str] = []
    fence, code = "", []

    def flush():
        if paragraph:
            for part in _CUT.split(" ".join(paragraph)):
                if part.strip():
                    out.append(Clause(part.strip(), "prose"))
            paragraph.clear()

    for line in INVISIBLE.sub("", text).splitlines():
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and line.strip() == m[1]:
                out.append(Clause("\n".join(code), "code"))
                fence, code = "", []
            else:
                code.append(line)
        elif m:
            flush()
            fence = m[1]
        elif not line.strip():
            flush()
        elif _LISTED.match(line):
            flush()
            out.append(Clause(line.strip(), "list"))
        elif line.lstrip().startswith("|"):
            flush()
            out.append(Clause(line.strip(), "table"))
        elif _URL_LINE.match(line):
            flush()
            out.append(Clause(line.strip(), "url"))
        else:
            paragraph.append(line.strip())
    flush()
    if fence:
        out.append(Clause("\n".join(code), "open"))
    while out and out[-1].kind != "open" and not out[-1].weight:
        out.pop()
    return [c for c in out if c.weight or c.kind == "open"]


@lru_cache(8192)
def squeezed(text: str) -> str:
    """Letters and digits only, apart from case, width and invisible characters."""
    return "".join(c for c in plain(text).casefold() if c.isalnum())


def _unbalanced(text: str) -> bool:
    return text.count('"') % 2 == 1 or any(text.count(a) > text.count(b) for a, b in ("()", "[]", "«»", "「」")) or ("„" not in text and text.count("“") > text.count("”")) or text.count("„") > text.count("“") + text.count("”") or text.count("`") % 2 == 1


#: bounds of the wording score (:class:`Wording`) between its features
SCORES = (-0.5, 1.0, 2.5)
FEATURES = (
    "bias", "prose", "code", "open", "list", "table", "url", "first", "last", "only", "echoed", "echoes all", "overlaps", "echo context", "foreign", "foreign context", "own language",
    "ended", "last unended", "last stub", "last unbalanced", "last open", "last item cut", "empty", "after wording", "before wording", "names", "names of the prompt", "short reply", "bare reply",
    *(f"wording {k}" for k in range(len(SCORES) + 1)),
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_NAME_LIKE = re.compile(r"`|\w_\w|\w\(|[a-z][A-Z]|\d|\w\.\w")
_NAMED = re.compile(r"[A-Za-z_]\w{3,}")


@lru_cache(8192)
def _strongest(text: str):
    found = scores(text)
    return max(found.items(), key=lambda x: (x[1], x[0])) if found else (None, 0.0)


@lru_cache(1024)
def requested(prompt: str) -> frozenset[str]:
    return frozenset(_NAMES[n] for n in _NAME.findall(prompt.casefold()))


def featured(parts: list[Clause], prompt: str, wording: Wording) -> np.ndarray:
    """Binary features of every clause of a response to ``prompt``: clues, none of which decides."""
    x = np.zeros((len(parts), len(FEATURES)))
    if not parts:
        return x
    asked = squeezed(prompt)
    asked_words = set(re.findall(r"\w+", prompt.casefold()))
    asked_names = {w.casefold() for w in _NAMED.findall(prompt)}
    own, _ = _strongest(prompt)
    allowed = requested(prompt) | {own}
    spoken, weight = _strongest(" ".join(c.text for c in parts if c.kind in ("prose", "list")))
    context = spoken is not None and weight >= 2 and own is not None and spoken not in allowed
    scored = [wording.score(c.text) if c.kind in ("prose", "list") else None for c in parts]
    n = len(parts)
    coded = any(c.kind in ("code", "open", "table") for c in parts)
    whole = ["short reply"] * (n <= 3) + ["bare reply"] * (n <= 3 and not coded)
    for k, c in enumerate(parts):
        on = ["bias", c.kind, *whole]
        if k == 0:
            on.append("first")
        if k == n - 1:
            on.append("last")
        if n == 1:
            on.append("only")
        if not c.weight:
            on.append("empty")
        low = c.text.casefold()
        if scored[k] is not None:
            on.append(f"wording {bisect.bisect_left(SCORES, scored[k])}")
            if _NAME_LIKE.search(c.text):
                on.append("names")
            if not asked_names.isdisjoint(_NAMED.findall(low)):
                on.append("names of the prompt")
        if k and (scored[k - 1] or 0) > SCORES[1]:
            on.append("after wording")
        if k + 1 < n and (scored[k + 1] or 0) > SCORES[1]:
            on.append("before wording")
        bare = squeezed(c.text)
        if len(bare) >= 6 and len(asked) >= 6:
            if bare in asked:
                on.append("echoed")
            if asked in bare:
                on.append("echoes all")
            words = re.findall(r"\w+", low)
            if len(words) > 3 and sum(w in asked_words for w in words) >= 0.85 * len(words):
                on.append("overlaps")
        if c.kind in ("prose", "list"):
            here, strength = _strongest(c.text)
            if context:
                on.append("foreign context")
                if here not in allowed:
                    on.append("foreign")
            elif here == own and strength:
                on.append("own language")
        if _ENDED.search(c.text):
            on.append("ended")
        if k == n - 1:
            if c.kind == "open":
                on.append("last open")
            elif c.kind == "prose":
                if not _ENDED.search(c.text):
                    on.append("last unended")
                elif _STUB.search(c.text):
                    on.append("last stub")
                tail = " ".join(p.text for p in parts[max(0, k - 2) :] if p.kind == "prose")
                if _unbalanced(c.text) and _unbalanced(tail):
                    on.append("last unbalanced")
            elif c.kind == "list" and _unbalanced(c.text) or c.kind == "table" and not c.text.endswith("|"):
                on.append("last item cut")
        for f in on:
            x[k, _AT[f]] = 1
    weights = np.array([c.weight for c in parts])
    repeated = x[:, [_AT["echoed"], _AT["echoes all"], _AT["overlaps"]]].any(1)
    if weights[repeated].sum() >= 0.6 * weights.sum() > 0:
        x[:, _AT["echo context"]] = 1
    return x


Planted = list[tuple[list[Clause], str, list[int]]]


def planted(rows: list[tuple[str, str]], seed: int = 7, longest: int = 12) -> Planted:
    """(clauses, prompt, tags): pairs as they are, all clauses answers, and pairs with planted defects, whose tags are
    known. Responses of more than ``longest`` clauses are not used for training."""
    rng = random.Random(seed)
    out: Planted = []

    def add(parts, prompt, tags):
        if parts and len(parts) == len(tags) and len(parts) <= longest:
            out.append((parts, prompt, tags))

    sound = [(p, r, parts) for p, r in rows if p and p.strip() and (parts := clauses(r or ""))]
    spoken = [_strongest(p)[0] for p, _, _ in sound]
    for k, (prompt, response, parts) in enumerate(sound):
        bare = len(parts) <= 3 and all(c.kind in ("prose", "list") for c in parts)
        if not bare:  # most refusals among the pairs as they are would stand as answers; short answers are made of long ones
            add(parts, prompt, [ANSWER] * len(parts))
            told = [c for c in parts if c.kind == "prose" and _ENDED.search(c.text) and not _STUB.search(c.text)]
            if told and rng.random() < 0.3:
                few = told[: rng.randrange(1, 4)]
                add(few, prompt, [ANSWER] * len(few))
            if rng.random() < 0.15:
                polite = clauses(rng.choice(POLITE))
                add(polite + parts, prompt, [ANSWER] * (len(polite) + len(parts)))
        topic = max(_NAMED.findall(prompt) or ["this"], key=len) if rng.random() < 0.7 else "3.14"
        for _ in range(2):
            ahead = clauses(rng.choice(LEADS)) if rng.random() < 0.3 else []
            said = clauses(refusal(rng, topic) + (" " + rng.choice((refusal(rng, topic), rng.choice(TAILS).replace("{t}", topic))) if rng.random() < 0.4 else ""))
            add(ahead + said, prompt, [ANSWER] * len(ahead) + [REFUSAL] * len(said))
        ahead = clauses(rng.choice(LEADS)) if rng.random() < 0.3 else []
        text = prompt.strip()
        copy = clauses(rng.choice((prompt, prompt.upper(), f"“{text}”", f"```\n{prompt}\n```", f"{prompt}\n\n{prompt}", f"> {text}", text.rstrip("?.!"), f"Q: {text}", text[: len(text) // 2 + 20])))
        add(ahead + copy, prompt, [ANSWER] * len(ahead) + [ECHO] * len(copy))
        if bare:
            continue
        end = len(response.rstrip())
        cuts = [rng.randrange(len(response) // 3, max(len(response) // 3 + 1, end - 2)) for _ in range(2)]
        fence = response.find("```")
        cuts += [response.find("\n", fence) + 1] * (fence >= 0 and rng.random() < 0.3)
        for cut in cuts:
            short = clauses(response[:cut])
            # a cut between two sentences or items cannot be told from an answer
            if short and (short[-1].kind == "open" or short[-1].kind == "prose" and (not _ENDED.search(short[-1].text) or _STUB.search(short[-1].text)) or short[-1].kind in ("list", "table") and _unbalanced(short[-1].text)):
                add(short, prompt, [ANSWER] * (len(short) - 1) + [UNFINISHED])
        for _ in range(2 * (not requested(prompt))):
            other = rng.randrange(len(sound))
            for _ in range(20):
                if spoken[other] != spoken[k]:
                    break
                other = rng.randrange(len(sound))
            if spoken[other] != spoken[k]:
                add(sound[other][2], prompt, [FOREIGN if c.kind in ("prose", "list") else ANSWER for c in sound[other][2]])
    return out


class Tagger(NamedTuple):
    """Tags the clauses of responses."""

    wording: Wording
    crf: Crf

    def tag(self, parts: list[list[Clause]], prompts: list[str]) -> list[np.ndarray]:
        return self.crf.decode([featured(c, p, self.wording) for c, p in zip(parts, prompts)])


def _spoken(made: Planted) -> tuple[list[str], list[bool]]:
    texts = {(c.text, t == REFUSAL) for parts, _, tags in made for c, t in zip(parts, tags) if c.kind in ("prose", "list")}
    texts = sorted(texts)
    return [t for t, _ in texts], [r for _, r in texts]


def train(rows: list[tuple[str, str]], folds: int = 2) -> Tagger:
    """A tagger from pairs in which defects are planted. The wording scores that the random field is trained on come from a
    model that has not seen the fold they stand in, and the tagger has the mean of these models; pairs that a first tagger finds defective are not answers, and are left
    out of the training of the second, which is returned."""
    tagger = None
    for rounds in (80, 250):
        if tagger:
            parts = [clauses(r or "") for _, r in rows]
            tags = tagger.tag(parts, [p or "" for p, _ in rows])
            rows = [row for row, c, t in zip(rows, parts, tags) if defect(c, t) is None]
        made = planted(rows)
        if not made:
            return tagger or Tagger(Wording(), Crf(LABELS, len(FEATURES)))
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []
        models: list[Wording] = []
        for fold in range(folds):
            own = made[fold::folds]
            wording = Wording().fit(*_spoken([m for k, m in enumerate(made) if k % folds != fold] or own))
            models.append(wording)
            xs += [featured(parts, prompt, wording) for parts, prompt, _ in own]
            ys += [np.array(tags) for _, _, tags in own]
        tagger = Tagger(Wording.mean(models), Crf(LABELS, len(FEATURES)).fit(xs, ys, rounds))
    return tagger


def defect(parts: list[Clause], tags: np.ndarray) -> str | None:
    """The defect that the coverage of the clauses' tags tells, or None."""
    if not any(c.weight for c in parts):
        return "empty"
    cover = np.zeros(len(LABELS))
    spoken = np.zeros(len(LABELS))
    for c, t in zip(parts, tags):
        cover[t] += c.weight
        if c.kind in ("prose", "list"):
            spoken[t] += c.weight
    total = cover.sum()
    if cover[ECHO] >= 0.6 * total and cover[ANSWER] <= 0.3 * total:
        return "copied"
    if cover[REFUSAL] >= 0.35 * total:
        return "refusal"
    if spoken[FOREIGN] > 0 and spoken[FOREIGN] >= 0.5 * spoken.sum():
        return "other_language"
    return "truncated" if tags[-1] == UNFINISHED else None


def contents(column: str, role: str | None = None) -> Column:
    """The message contents of an array of messages, joined by line feeds; null messages and contents drop out."""
    messages = F.coalesce(F.col(column), F.array())
    kept = F.filter(messages, lambda m: m["role"] == role) if role else messages
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


def fit_tagger(df: DataFrame, id_col: str = "sft_id", sample: int = 800, longest: int = 4000) -> Tagger:
    """The clause tagger, trained (:func:`train`) on at most ``sample`` pairs with responses below ``longest`` characters,
    those with the lowest hash of their id. A bound on the hash first leaves about four times as many, over all partitions."""
    share = min(1.0, 4.0 * sample / max(1, df.count()))
    rows = (
        df.select(contents("prompt", "user").alias("p"), contents("completion").alias("c"), F.xxhash64(id_col).alias("h"))
        .where((F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))) & (F.length("c") < longest))
        .orderBy("h", "p", "c")
        .limit(sample)
        .collect()
    )
    return train([(r["p"], r["c"]) for r in rows])


def pair_defects(df: DataFrame, id_col: str = "sft_id", sample: int = 800, tagger: Tagger | None = None) -> DataFrame:
    """(`id_col`, ``defect``, ``clauses``, ``tags``): every pair with its defect, null for a sound one.

    ``empty``: a null, empty or missing completion, or one without a letter or digit; ``truncated``, ``refusal``,
    ``copied`` and ``other_language`` by the coverage of its clauses' tags. A pair without a user prompt can be
    empty, truncated or a refusal only. Very long responses are tagged whole; repeated rows are judged alike; an empty
    table gives an empty table; other columns are ignored. The trained tagger, a weight for each word and pair of
    words of the sample, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger or fit_tagger(df, id_col, sample))
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "defect", "clauses", "tags"]

    def judge(batches):
        tagger = shared.value
        for b in batches:
            parts = [clauses(t or "") for t in b.column(2).to_pylist()]
            tags = tagger.tag(parts, [p or "" for p in b.column(1).to_pylist()])
            found = [defect(c, t) for c, t in zip(parts, tags)]
            named = [[LABELS[k] for k in t.tolist()] for t in tags]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.string()), pa.array([len(c) for c in parts], pa.int32()), pa.array(named, pa.list_(pa.string()))], names
            )

    pairs = df.select(F.col(id_col), contents("prompt", "user").alias("p"), contents("completion").alias("c"))
    return pairs.mapInArrow(judge, f"`{id_col}` {kind}, defect string, clauses int, tags array<string>")
