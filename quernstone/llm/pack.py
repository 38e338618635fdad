"""Cost-balanced packing of documents into sequences of fixed token capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.encode import TOKENIZERS, automaton, compiled
from quernstone.session import written


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`id_col`, ``n_tokens``): tokens of every text, 0 for null and empty ones."""
    path = f"{folder}/{tokenizer}.tiktoken"
    tables = df.sparkSession.sparkContext.broadcast(compiled(path))

    def count(batches):
        a = automaton(path, tables)
        for b in batches:
            n = pa.array([a.count(t or "") for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint")


def attention_cost(n, linear: float, quadratic: float):
    """Cost of a document of ``n`` tokens in a sequence where documents do not attend to one another."""
    return linear * n + quadratic * n * n


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, first token) of each item, items in descending length: each goes to the sequence of lowest cost that
    still has room; a new one is opened where none has. As many are open at first as the tokens need at least."""
    n = max(1, -(-int(lengths.sum()) // capacity))
    room = np.full(n + len(lengths), capacity, np.int64)
    cost = np.zeros(n + len(lengths))
    into, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        masked = np.where(room[:n] >= size, cost[:n], np.inf)
        best = int(masked.argmin())
        if masked[best] == np.inf:
            best, n = n, n + 1
        into[i], offset[i] = best, capacity - room[best]
        room[best] -= size
        cost[best] += attention_cost(size, linear, quadratic)
    return into, offset


def pack_items(
    sizes: DataFrame,
    id_col: str,
    size_col: str = "n_tokens",
    capacity: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    shard_items: int = 4096,
) -> DataFrame:
    """(`id_col`, ``part``, ``n_tokens``, ``from_token``, ``container``, ``offset``): every item with the container it goes
    into and the token there at which it starts.

    An item larger than the capacity comes in parts: full containers and a rest, numbered from 0; no other item is
    split. Items are spread at random over shards of about ``shard_items`` and each shard is packed on its own, on ids and
    sizes only; so the work is parallel and each shard leaves about one container part empty. A null or zero size takes
    no room but still has a container. Repeated ids are items of their own; ties go by id and part; an empty table gives
    an empty table; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = sizes.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    items = (
        sizes.select(F.col(id_col), size.alias("__n"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("__n") / capacity) - 1).cast("int"))))
        .withColumn("from_token", F.col("part").cast("bigint") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("from_token")))
        .drop("__n")
    )
    items = written(items.withColumn("__row", F.monotonically_increasing_id()), "pack")
    shards = max(1, -(-items.count() // shard_items))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", id_col, "part"], ascending=[False, True, True], kind="stable")
        into, offset = assign(pdf["n_tokens"].to_numpy(), capacity, linear, quadratic)
        return pdf.assign(container=pdf["__shard"] * (1 << 32) + into, offset=offset)[[id_col, "part", "n_tokens", "from_token", "container", "offset"]]

    return (
        items.withColumn("__shard", F.pmod(F.xxhash64(id_col, "part", "__row"), F.lit(shards)))
        .groupBy("__shard")
        .applyInPandas(pack, f"`{id_col}` {kind}, part int, n_tokens bigint, from_token bigint, container bigint, offset bigint")
    )


def pack_texts(df: DataFrame, id_col: str = "cpt_id", text_col: str = "text", capacity: int = 4096, **options) -> DataFrame:
    """:func:`pack_items` over the token counts of texts; null and empty texts count no tokens."""
    return pack_items(token_counts(df, id_col, text_col), id_col, capacity=capacity, **options)
