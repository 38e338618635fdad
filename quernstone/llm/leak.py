"""Passages of held-out items in training documents, found through an FM-index per shard of the training text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.fm_index import FMIndex
from quernstone.llm.textnorm import match_words


def test_phrases(items: list[tuple], window: int) -> dict:
    """Windows of ``window`` consecutive words of each item, as symbols of the items' own vocabulary."""
    vocabulary: dict[str, int] = {}
    windows: dict[tuple, set] = {}
    for item, *texts in items:
        words = match_words("\n".join(t for t in texts if t))
        symbols = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        for k in range(len(symbols) - window + 1):
            windows.setdefault(tuple(symbols[k : k + window]), set()).add(item)
    return {
        "vocabulary": vocabulary,
        "patterns": np.array(list(windows), np.int64).reshape(-1, window),
        "items": [sorted(x) for x in windows.values()],
    }


class Shard:
    """Part of the corpus as one symbol sequence. Only runs of at least ``window`` consecutive words of the items'
    vocabulary can hold a match, so only those enter the index, each followed by a separator that is in no pattern."""

    def __init__(self, phrases: dict, window: int):
        self.phrases, self.window = phrases, window
        self.separator = len(phrases["vocabulary"]) + 1
        self.seq: list[int] = []
        self.starts: list[int] = []
        self.owner: list[tuple] = []

    def add(self, doc, text: str) -> None:
        known = self.phrases["vocabulary"].get
        symbols = [known(w, 0) for w in match_words(text)]
        window, n, at = self.window, len(symbols), 0
        while at < n:
            if not symbols[at]:
                at += 1
                continue
            end = at + 1
            while end < n and symbols[end]:
                end += 1
            if end - at >= window:
                self.starts.append(len(self.seq))
                self.owner.append((doc, at))
                self.seq += symbols[at:end]
                self.seq.append(self.separator)
            at = end + 1

    def spans(self) -> list[tuple]:
        """(document, item, first word, word after the last) of merged matches."""
        if not self.seq or not len(self.phrases["patterns"]):
            return []
        index = FMIndex(np.array(self.seq, np.int64), self.separator)
        pattern, position = index.locate(*index.search(self.phrases["patterns"]))
        run = np.searchsorted(self.starts, position, side="right") - 1
        hits = set()
        for p, at, r in zip(pattern.tolist(), position.tolist(), run.tolist()):
            doc, word = self.owner[r]
            word += at - self.starts[r]
            hits.update((doc, item, word) for item in self.phrases["items"][p])
        out: list[list] = []
        for doc, item, word in sorted(hits):
            if out and out[-1][:2] == [doc, item] and word <= out[-1][3]:
                out[-1][3] = word + self.window
            else:
                out.append([doc, item, word, word + self.window])
        return [tuple(x) for x in out]


def leaked_spans(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_texts: tuple[str, ...] = ("prompt", "answer"),
    window: int = 10,
    most_items: int = 100_000,
    shard_words: int = 2_000_000,
) -> DataFrame:
    """(`id_col`, `item_col`, ``first_word``, ``end_word``): the merged spans of a document's words that an item's texts
    contain too, where at least ``window`` consecutive words agree.

    The items are the benchmark, a table of fixed size: their texts go to the driver, after a check that there are at
    most ``most_items`` (more is an error: pass the benchmark in parts). The corpus is indexed where it lies, one index
    per ``shard_words`` indexed words, and never shuffled. A null or empty document has no spans; an item with null texts
    or fewer words than the window matches nothing; repeated documents give repeated spans; a benchmark item given
    twice counts once; empty tables give an empty table; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.select(item_col, *item_texts).where(F.col(item_col).isNotNull()).limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items")
    phrases = spark.sparkContext.broadcast(test_phrases([tuple(r) for r in rows], window))
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, id_col), (items, item_col)))
    schema = f"`{id_col}` {doc_kind}, `{item_col}` {item_kind}, first_word int, end_word int"

    def search(batches):
        shard, types = Shard(phrases.value, window), None

        def flush():
            columns = list(zip(*shard.spans())) or [[], [], [], []]
            kinds = [types, None if columns[1] else pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, item_col, "first_word", "end_word"])

        for b in batches:
            types = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc is not None and text:
                    shard.add(doc, text)
            if len(shard.seq) >= shard_words:
                yield flush()
                shard = Shard(phrases.value, window)
        if types is not None and shard.seq:
            yield flush()

    return documents.select(id_col, text_col).mapInArrow(search, schema)


def leaked(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(`id_col`, `item_col`), distinct: which items leaked into which documents; cases as in :func:`leaked_spans`."""
    spans = leaked_spans(documents, items, **options)
    return spans.select(options.get("id_col", "doc_id"), options.get("item_col", "item_id")).distinct()
