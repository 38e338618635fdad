"""Token budget of rows by source, language, domain and version."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.encode import TOKENIZERS, automaton, compiled
from quernstone.llm.language import language
from quernstone.llm.textnorm import file_key, plain

LANGUAGES = ("en", "de", "fr", "es", "ru", "ja", "zh")

def _class(c: str) -> int:
    """0 white space, 1 letter, 2 number, 3 other: the classes of the tokenizer's splitting pattern."""
    if c.isalpha():
        return 1
    if c.isspace():
        return 3 if c in "\x1c\x1d\x1e\x1f" else 0
    return 2 if unicodedata.category(c)[0] == "N" else 3


def independent(text: str, i: int) -> bool:
    """Whether the text before ``i`` and that from ``i`` on are split as in the whole. Each alternative of the pattern takes
    white space, letters, numbers or other characters, with at most a blank in front, or an apostrophe and letters. So a
    split ends wherever a character that is no white space is followed by one of another class, but for an apostrophe before
    a letter. Nothing in the pattern looks back, and what looks ahead sees white space only."""
    before, after = _class(text[i - 1]), _class(text[i])
    return before != 0 and before != after and not (text[i - 1] == "'" and after == 1)


def safe_chunks(text: str, size: int) -> list[str]:
    """The text cut into chunks of about ``size`` characters, only where the tokenizer's splits are proven independent
    (:func:`independent`); a longer stretch of one class, which is one split, stays whole."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        i = at + size
        while i < n and not independent(text, i):
            i += 1
        if i == n:
            break
        out.append(text[at:i])
        at = i
    out.append(text[at:])
    return out


_VERSION = re.compile(r"(?:^|[^\d.])(?:v|py|cp|python|cpython)?[\s_-]*([1-9])\.(\d{1,2})(?!\d)|(?:py|cp|python)[\s_-]*([1-9])(\d{1,2})(?!\d)")


def version_of(name: str | None) -> str | None:
    """major.minor told by a spelling of a Python version, None where it tells none."""
    if not name:
        return None
    m = _VERSION.search(plain(name).strip().casefold())
    return f"{m[1] or m[3]}.{int(m[2] or m[4])}" if m else None


def token_totals(
    df: DataFrame, id_col: str, text_col: str, labels: dict | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = 16_384
) -> DataFrame:
    """(`id_col`, labels, ``n_tokens``) of every row, from one pass over its texts.

    Texts up to ``chunk`` characters are counted where they lie; longer ones are cut at independent points, their chunks
    salted across workers, and the chunk counts summed. ``labels`` names columns and gives for each a source column and a
    function of its value. Null and empty texts have 0 tokens; rows that share an id are summed, with the least of their
    labels.
    """
    labels = labels or {}
    path = f"{folder}/{tokenizer}.tiktoken"
    tables = df.sparkSession.sparkContext.broadcast(compiled(path))
    kind = df.schema[id_col].dataType.simpleString()
    sources = [c for c, _ in labels.values()]
    functions = [f for _, f in labels.values()]
    names = [id_col, *labels, "n_tokens", "__chunk", "__salt"]

    def read(batches):
        a = automaton(path, tables)
        salt = 0
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for i, t, *values in zip(*(c.to_pylist() for c in b.columns)):
                told = [f(v) for f, v in zip(functions, values)]
                parts = safe_chunks(t, chunk) if t and len(t) > chunk else []
                rows = [(i, *told, 0 if len(parts) > 1 else a.count(t or ""), None, salt)]
                rows += [(i, *[None] * len(told), 0, part, salt + k) for k, part in enumerate(parts)] if len(parts) > 1 else []
                salt += len(rows)
                for row in rows:
                    for c, v in zip(columns, row):
                        c.append(v)
            kinds = [b.column(0).type, *[pa.string()] * len(labels), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def count(batches):
        a = automaton(path, tables)
        for b in batches:
            n = [n if part is None else a.count(part) for n, part in zip(b.column("n_tokens").to_pylist(), b.column("__chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(labels)], pa.array(n, pa.int64())], names[: 2 + len(labels)])

    schema = f"`{id_col}` {kind}, " + "".join(f"`{x}` string, " for x in labels) + "n_tokens bigint"
    passed = df.select(F.col(id_col), F.col(text_col), *(F.col(c).alias(f"__{k}") for k, c in enumerate(sources))).mapInArrow(read, schema + ", __chunk string, __salt bigint")
    counted = passed.repartition(F.xxhash64(id_col, "__salt")).mapInArrow(count, schema)
    return counted.groupBy(id_col).agg(*(F.min(x).alias(x) for x in labels), F.sum("n_tokens").alias("n_tokens"))


def _labels(df: DataFrame, columns: list[str], functions: list, names: list[str]) -> DataFrame:
    """The first column with labels computed from the others, in Arrow batches."""

    def run(batches):
        for b in batches:
            made = [pa.array([f(x) for x in b.column(k + 1).to_pylist()], pa.string()) for k, f in enumerate(functions)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [columns[0], *names])

    kind = df.schema[columns[0]].dataType.simpleString()
    return df.select(*columns).mapInArrow(run, f"`{columns[0]}` {kind}, " + ", ".join(f"{n} string" for n in names))


def row_slices(cpt: DataFrame, sft: DataFrame, catalogue: DataFrame, **options) -> DataFrame:
    """(``tab``, ``row_id``, ``slice_kind``, ``slice_value``, ``n_tokens``): the slices each row counts for, with its tokens.

    ``cpt`` rows (``cpt_id``, ``filename``, ``text``) count for the language of their prose unless the text is null or
    blank, and for the source and domain of the catalogue entry that the file name means, whatever the text. ``sft``
    rows (``sft_id``, ``prompt``, ``completion``, ``python_version``) count for the version told; their tokens are those of
    all message contents. A row without any slice is in none; null names, versions and texts give no slice of their
    kind; rows that share an id are one row; empty tables give an empty table; other columns are ignored.
    """
    entries = _labels(
        catalogue.select(F.col("name").alias("source"), F.col("category").alias("domain"), F.concat_ws("/", "category", F.concat("name", F.lit(".rst"))).alias("path")).select("path", "path", "source", "domain").toDF("__path", "__p", "source", "domain"),
        ["__path", "__p", "source", "domain"], [file_key, lambda x: x, lambda x: x], ["__key", "source", "domain"],
    ).drop("__path").where(F.col("__key").isNotNull()).dropDuplicates(["__key"])
    labels = {"lang": ("text", lambda t: language(t, LANGUAGES)), "__key": ("filename", file_key)}
    pairs = F.array(*(F.struct(F.lit(k).alias("slice_kind"), F.col(c).alias("slice_value")) for k, c in (("lang", "lang"), ("source", "source"), ("domain", "domain"))))
    of_cpt = (
        token_totals(cpt, "cpt_id", "text", labels, **options)
        .join(entries, "__key", "left")
        .select("cpt_id", "n_tokens", F.explode(F.filter(pairs, lambda p: p["slice_value"].isNotNull())).alias("s"))
        .select(F.lit("cpt").alias("tab"), F.col("cpt_id").alias("row_id"), "s.slice_kind", "s.slice_value", "n_tokens")
    )
    messages = F.concat(*(F.coalesce(F.col(c), F.array()) for c in ("prompt", "completion")))
    said = F.array_join(F.transform(messages, lambda m: m["content"]), "\n")
    told = token_totals(sft.select("sft_id", said.alias("text"), "python_version"), "sft_id", "text", {"slice_value": ("python_version", version_of)}, **options)
    of_sft = told.where(F.col("slice_value").isNotNull()).select(
        F.lit("sft").alias("tab"), F.col("sft_id").alias("row_id"), F.lit("version").alias("slice_kind"), "slice_value", "n_tokens"
    )
    return of_cpt.unionByName(of_sft)


def token_budget(cpt: DataFrame, sft: DataFrame, catalogue: DataFrame, **options) -> DataFrame:
    """(``tab``, ``slice_kind``, ``slice_value``, ``n_rows``, ``n_tokens``): totals of every slice, cases as in
    :func:`row_slices`. Partial sums are made before the shuffle, so a slice with most of the rows is no hot spot."""
    rows = row_slices(cpt, sft, catalogue, **options)
    return rows.groupBy("tab", "slice_kind", "slice_value").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
