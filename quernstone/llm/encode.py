"""Token ids of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bpe_automaton import Automaton, compile_gadgets, read_ranks

#: Where the public vocabularies lie; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

_ready: dict[str, Automaton] = {}


@lru_cache(4)
def compiled(path: str) -> dict:
    """Gadget tables of a rank file, compiled once on the driver; at most one entry per vocabulary token."""
    return compile_gadgets(read_ranks(path))


def automaton(key: str, tables) -> Automaton:
    """The worker's automaton over broadcast tables, kept between tasks."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Automaton(tables.value)
    return _ready[key]


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """(`id_col`, ``ids``): the token ids of every text, one row per input row, no special tokens.

    A null text and an empty text both have the empty list. Blank texts, control, combining and astral characters are
    encoded as they stand; lone surrogates cannot occur in Parquet strings. Repeated rows stay repeated, an empty table
    gives an empty table, other columns (also one named ``ids``) are ignored. One pass over the rows, without a shuffle.
    """
    spark = df.sparkSession
    path = f"{folder}/{tokenizer}.tiktoken"
    tables = spark.sparkContext.broadcast(compiled(path))

    def encode(batches):
        a = automaton(path, tables)
        for b in batches:
            parts = [a.encode_bytes(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`id_col`, ``text``): the text of ``ids``; a null or empty list gives the empty text. Ids that do not form valid
    UTF-8 give replacement characters, an id outside the vocabulary is an error."""
    path = f"{folder}/{tokenizer}.tiktoken"
    tables = df.sparkSession.sparkContext.broadcast(compiled(path))

    def decode(batches):
        a = automaton(path, tables)
        for b in batches:
            texts = [a.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col("ids")).mapInArrow(decode, f"`{id_col}` {kind}, text string")
