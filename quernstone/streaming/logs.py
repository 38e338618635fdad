"""Terminal logs as a stream, and incremental, restartable output."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.functions.text import WS, strip, visible
from quernstone.session import written


def assemble(pending: str, chunk: str) -> tuple[list[str], str]:
    """(lines to keep, what is pending): complete lines as a terminal shows them, without escape sequences and blanks."""
    *complete, pending = (pending + chunk).split("\n")
    shown = (line.rsplit("\r", 1)[-1] for line in complete)
    return [x for x in shown if "\x1b" not in x and x.strip(WS)], pending


class Tee:
    """Text written to a stream goes on to it unchanged, and as kept lines into a file that several tees may share; each has
    its own unfinished line, which is lost unless a line break ends it. As a context it stands in for the named streams of
    ``sys`` and puts them back."""

    def __init__(self, stream, into):
        self.stream, self.into, self.pending = stream, into, ""

    def write(self, text: str) -> int:
        lines, self.pending = assemble(self.pending, text)
        self.into.writelines(f"{x}\n" for x in lines)
        return self.stream.write(text)

    def flush(self) -> None:
        self.stream.flush()
        self.into.flush()

    def __getattr__(self, name):
        return getattr(self.stream, name)


@contextmanager
def teed(path: str, names: tuple[str, ...] = ("stdout", "stderr")):
    """Everything the named streams of ``sys`` are given, also as kept lines at the end of a file."""
    import sys

    before = {n: getattr(sys, n) for n in names}
    with open(path, "a", encoding="utf-8") as into:
        for n, stream in before.items():
            setattr(sys, n, Tee(stream, into))
        try:
            yield
        finally:
            for n, stream in before.items():
                setattr(sys, n, stream)


def log_batch(chunks: DataFrame) -> DataFrame:
    """(``stream``, ``line_no``, ``line``) of chunks (``stream``, ``seq``, ``chunk``): each stream on its own, an
    unterminated last line is lost. Null chunks add nothing.

    A stream may be larger than a task: chunks are range-partitioned by stream and sequence, every partition gives its own
    complete lines, and only what stands before the first and after the last line break of a partition is stitched
    together, one row per stream and partition.
    """
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.select("stream", "seq", "chunk").where("stream is not null").repartitionByRange(parts, "stream", "seq").sortWithinPartitions("stream", "seq")

    def cut(batches):
        p, name, head, pending, number = TaskContext.get().partitionId(), None, None, "", 0

        def ends():
            # text without any line break stands as "all"; else as the "head" before the first and the "tail" after the last
            return [(name, p, "all", 0, pending)] if head is None else [(name, p, "head", 0, head), (name, p, "tail", number, pending)]

        for b in batches:
            rows = []
            for stream, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if stream != name:
                    rows += ends() if name is not None else []
                    name, head, pending, number = stream, None, "", 0
                if head is None and "\n" in (chunk or ""):
                    first, chunk = chunk.split("\n", 1)
                    head, pending = pending + first, ""
                if head is None:
                    pending += chunk or ""
                    continue
                lines, pending = assemble(pending, chunk or "")
                rows += [(name, p, "line", number + k, x) for k, x in enumerate(lines)]
                number += len(lines)
            yield _batch(rows)
        if name is not None:
            yield _batch(ends())

    made = written(ordered.mapInArrow(cut, "stream string, p int, kind string, n int, text string"), "log")
    edges = made.where("kind <> 'line'")
    # a line that runs over partitions belongs to the group that the next partition with a line break closes
    whole = edges.groupBy("stream", "p").agg(F.max(F.when(F.col("kind") == "tail", F.col("n"))).alias("inner"))
    by_stream = Window.partitionBy("stream").orderBy("p")
    groups = whole.withColumn("g", F.coalesce(F.count("inner").over(by_stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = edges.join(groups, ["stream", "p"]).withColumn("g", F.col("g") + F.when(F.col("kind") == "tail", 1).otherwise(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", (F.col("kind") == "tail").alias("t"), "text"))), lambda x: x["text"]), "")
    line = visible(text)
    stitched = pieces.groupBy("stream", "g").agg(line.alias("line"))
    first = groups.where("inner is not null").join(stitched, ["stream", "g"]).withColumn("kept", ~F.col("line").contains("\x1b") & (strip("line") != ""))
    placed = first.withColumn("before", F.coalesce(F.sum(F.col("inner") + F.col("kept").cast("int")).over(by_stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = made.where("kind = 'line'").join(placed.select("stream", "p", "before", "kept"), ["stream", "p"])
    return (
        inner.select("stream", (F.col("before") + F.col("kept").cast("int") + F.col("n")).cast("int").alias("line_no"), F.col("text").alias("line"))
        .unionByName(placed.where("kept").select("stream", F.col("before").cast("int").alias("line_no"), "line"))
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["stream", "p", "kind", "n", "text"])


def log_stream(chunks: DataFrame) -> DataFrame:
    """The same over a streaming frame: what is pending in each stream is its state, carried from batch to batch."""

    def step(key, frames, state: GroupState):
        pending, number = state.get if state.exists else ("", 0)
        data = pd.concat(list(frames)).sort_values("seq", kind="stable")
        lines, pending = assemble(pending, "".join(c for c in data["chunk"] if c is not None))
        state.update((pending, number + len(lines)))
        yield pd.DataFrame({"stream": [key[0]] * len(lines), "line_no": pd.Series(range(number, number + len(lines)), dtype="int32"), "line": pd.Series(lines, dtype="object")})

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, line_no int, line string", "pending string, number int", "append", GroupStateTimeout.NoTimeout)


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Runs a stream over what is there now and appends its rows as JSON lines, each batch once: a batch that is run again
    replaces its own directory. Returns the query after it has ended."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def unseen(docs: DataFrame, manifest: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """The documents whose content hash is not in the manifest (``name``, ``hash``): the others need no new parse."""
    hashed = docs.withColumn("__h", F.sha2(F.col(text_col), 256))
    seen = manifest.select(F.col("name").alias("__n"), F.col("hash").alias("__s"))
    return hashed.join(seen, (F.col(name_col) == F.col("__n")) & (F.col("__h") == F.col("__s")), "left_anti").drop("__h")
