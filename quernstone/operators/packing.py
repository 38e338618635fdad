"""Token windows and sequence packing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import written


def windows(tokens: Column, length: int) -> Column:
    """Full tumbling windows of ``length`` tokens."""
    n = F.floor(F.size(tokens) / length).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * length + 1, length))
    return F.when(n > 0, made).otherwise(F.array().cast("array<array<string>>"))



def token_windows(df: DataFrame, id_col: str, tokens: Column, length: int) -> DataFrame:
    """(`id_col`, ``window``, ``tokens``): the full windows of documents longer than one window."""
    long = df.select(F.col(id_col), tokens.alias("__t")).where(F.size("__t") > length)
    return long.select(id_col, F.posexplode(windows(F.col("__t"), length)).alias("window", "tokens"))


def tails(df: DataFrame, id_col: str, tokens: Column, length: int, overlap: float = 0.3) -> DataFrame:
    """(`id_col`, ``kind``, ``tokens``): what full windows leave of each document.

    A short document is a ``whole`` fragment. The tail of a long one is a last ``window`` that repeats tokens, where at
    most ``floor(overlap * length)`` are repeated; else a ``fragment`` with that many repeated. No tail, no row.
    """
    most = int(overlap * length)
    t = F.col("__t")
    n = F.size(t)
    tail = n % length
    last = F.when(F.lit(length) - tail <= most, F.struct(F.lit("window").alias("kind"), F.slice(t, -length, length).alias("tokens"))).otherwise(
        F.struct(F.lit("fragment").alias("kind"), F.slice(t, -(tail + most), tail + most).alias("tokens"))
    )
    made = F.when(n <= length, F.struct(F.lit("whole").alias("kind"), t.alias("tokens"))).when(tail > 0, last)
    return df.select(F.col(id_col), tokens.alias("__t")).select(id_col, made.alias("m")).where("m is not null").select(id_col, "m.kind", "m.tokens")


def first_fit_decreasing(fragments: DataFrame, id_col: str, size_col: str, capacity: int, gap: int = 1) -> DataFrame:
    """(`id_col`, `size_col`, ``bin``, ``place``): each fragment goes to the first bin with room for it and a separator.

    Fragments are taken in descending size, ties by id; the result is that of the sequential rule, but no task sees all
    fragments. What first fit does depends on sizes only, and equal sizes follow one another, so it is played on the driver
    over sizes and their counts (:func:`plan_first_fit`, at most ``capacity`` + 1 sizes). A fragment then finds its bin from
    its rank among those of its size; ranks come from a range partitioning by size and id, counted per partition. A null
    size counts as 0, a size over the capacity is an error, repeated ids are fragments of their own.
    """
    spark = fragments.sparkSession
    kind = fragments.schema[id_col].dataType.simpleString()
    sized = fragments.select(F.col(id_col).alias("i"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("n"))
    sized = sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "n", "i").withColumn("p", F.spark_partition_id())
    sized = written(sized, "fragments")
    counts = {r["n"]: r["c"] for r in sized.groupBy("n").agg(F.count("*").alias("c")).where(F.col("n") <= capacity).collect()}
    if sized.where(F.col("n") > capacity).head(1):
        raise ValueError("a fragment is larger than the capacity")
    shared = spark.sparkContext.broadcast(plan_first_fit(counts, capacity, gap))
    per = sized.groupBy("n", "p").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("n", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("b"))
    ranked = sized.join(offsets, ["n", "p"]).select("i", "n", (F.row_number().over(Window.partitionBy("p", "n").orderBy("i")) - 1 + F.col("b")).alias("r"))

    def place(batches):
        for b in batches:
            n, r = b.column(1).to_numpy(), b.column(2).to_numpy()
            bins, places = np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
            for size in np.unique(n).tolist():
                on = n == size
                first, into, each, held = shared.value[size]
                k = np.searchsorted(first, r[on], side="right") - 1
                past = r[on] - first[k]
                bins[on] = into[k] + past // each[k]
                places[on] = held[k] + past % each[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bins), pa.array(places)], [id_col, size_col, "bin", "place"])

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, `{size_col}` bigint, bin bigint, place int")


def plan_first_fit(counts: dict[int, int], capacity: int, gap: int = 1) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size the segments of its ranks: (first rank, first bin, fragments per bin, fragments held before).

    Bins are kept as runs of neighbours with equal room. A run takes as many of a size as its bins hold; only the last one
    touched is left in between, so a size adds at most a few runs, and their number does not depend on the counts.
    """
    runs: list[list[int]] = []  # number of bins, room, fragments held
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for size in sorted(counts, reverse=True):
        left, rank, start, need = counts[size], 0, 0, size + gap
        segments, after = plan.setdefault(size, []), []
        for n, room, held in runs:
            each = room // need if need else left
            if not left or not each:
                after.append([n, room, held])
            else:
                full, rest = min(n, left // each), 0
                if full < n:
                    rest = left - full * each
                segments.append((rank, start, each, held))
                rank += full * each + rest
                left -= full * each + rest
                after += [[m, room - k * need, held + k] for m, k in ((full, each), (1 if rest else 0, rest), (n - full - (1 if rest else 0), 0)) if m]
            start += n
        if left:
            each = 1 + (capacity - size) // need if need else left
            full, rest = divmod(left, each)
            segments.append((rank, start, each, 0))
            after += [[m, capacity - size - (k - 1) * need, k] for m, k in ((full, each), (1 if rest else 0, rest)) if m]
        runs = []
        for run in after:
            if runs and runs[-1][1:] == run[1:]:
                runs[-1][0] += run[0]
            else:
                runs.append(run)
    return {size: tuple(np.array(c, np.int64) for c in zip(*segments)) for size, segments in plan.items() if segments}


def place_best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Best fit: the fullest bin that still has room; sizes beyond the capacity count as the capacity (truncation)."""
    room: dict[int, list[int]] = {}
    out, opened = [], 0
    for size in sizes:
        size = min(size, capacity)
        fit = min((r for r in room if r >= size and room[r]), default=None)
        if fit is None:
            at, left = opened, capacity - size
            opened += 1
        else:
            at, left = heapq.heappop(room[fit]), fit - size
        heapq.heappush(room.setdefault(left, []), at)
        out.append(at)
    return out


def plan_best_fit(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size the segments of its ranks: (first rank, first bin, items per bin), as :func:`place_best_fit` places them.

    The fullest bin with room stays the fullest while it takes more of the same size, so bins fill one after another. Bins
    of equal room are kept as runs of neighbours; a size moves whole runs and splits at most one, so the work depends on the
    number of sizes, not of items.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins)
    plan, opened = {}, 0
    for size in sorted(counts, reverse=True):
        left, rank, segments, moved = counts[size], 0, [], []

        def fill(room: int, start: int, n: int) -> int:
            """Puts items into ``n`` bins; gives the number of bins touched."""
            nonlocal left, rank
            each = room // size if size else left
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            segments.append((rank, start, each))
            moved.extend(x for x in ((room - each * size, start, full), (room - rest * size, start + full, int(rest > 0))) if x[2])
            rank += full * each + rest
            left -= full * each + rest
            return full + (rest > 0)

        for room in sorted(r for r in runs if r >= size):
            for start, n in runs.pop(room):
                used = fill(room, start, n) if left else 0
                if used < n:
                    moved.append((room, start + used, n - used))
            if not left:
                break
        if left:
            each = capacity // size if size else left
            opened += fill(capacity, opened, -(-left // each))
        for room, start, n in moved:
            runs.setdefault(room, []).append((start, n))
        for room in {room for room, *_ in moved}:
            runs[room].sort()
        plan[size] = tuple(np.array(c, np.int64) for c in zip(*segments))
    return plan


def best_fit_decreasing(fragments: DataFrame, id_col: str, size_col: str, capacity: int, split: bool = False) -> DataFrame:
    """(`id_col`, ``part``, `size_col`, ``bin``): best-fit packing without separators. Items over the capacity are truncated,
    or with ``split`` come in parts of the capacity and a rest. Items are taken in descending size, ties by id and part; the
    result is that of the sequential rule (:func:`place_best_fit`) at every size, as it is played on the driver over sizes
    and their counts (at most ``capacity`` + 1 of them), and every item finds its bin from its rank."""
    spark = fragments.sparkSession
    kind = fragments.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int") if split else F.lit(1)
    items = fragments.select(F.col(id_col).alias("i"), size.alias("__n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    items = items.select("i", "part", F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("part") * capacity).alias("n"))
    sized = items.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "n", "i", "part").withColumn("p", F.spark_partition_id())
    sized = written(sized, "items")
    counts = {r["n"]: r["c"] for r in sized.groupBy("n").agg(F.count("*").alias("c")).collect()}
    shared = spark.sparkContext.broadcast(plan_best_fit(counts, capacity))
    per = sized.groupBy("n", "p").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("n", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("b"))
    ranked = sized.join(offsets, ["n", "p"]).select("i", "part", "n", (F.row_number().over(Window.partitionBy("p", "n").orderBy("i", "part")) - 1 + F.col("b")).alias("r"))

    def place(batches):
        for b in batches:
            n, r = b.column(2).to_numpy(), b.column(3).to_numpy()
            bins = np.zeros(len(n), np.int64)
            for one in np.unique(n).tolist():
                on = n == one
                first, into, each = shared.value[one]
                k = np.searchsorted(first, r[on], side="right") - 1
                bins[on] = into[k] + (r[on] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bins)], [id_col, "part", size_col, "bin"])

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, part int, `{size_col}` bigint, bin bigint")


def pack_documents(df: DataFrame, id_col: str, tokens: Column, sequence_length: int, overlap: float = 0.3, separator: str = "<eos>") -> DataFrame:
    """(``part``, ``document``, ``ordinal``, ``tokens``): full windows of every document (part 0), in order of document and
    number, its overlapping last one behind them, then bins of leftovers (part 1) in order of bin.

    Every sequence is shorter than ``sequence_length``, which leaves room for the end token a trainer adds. Bins hold
    their fragments in descending size with the separator between. The empty document is a fragment of no tokens. Ids must
    be unique.
    """
    length = sequence_length - 1
    left = tails(df, id_col, tokens, length, overlap)
    full = token_windows(df, id_col, tokens, length).select(F.col(id_col).alias("document"), F.col("window").cast("bigint").alias("ordinal"), "tokens")
    last = left.where("kind = 'window'").select(F.col(id_col).alias("document"), F.lit(2**62).alias("ordinal"), "tokens")
    fragments = left.where("kind <> 'window'")
    placed = first_fit_decreasing(fragments.select(id_col, F.size("tokens").alias("n")), id_col, "n", length)
    joined = fragments.join(placed, id_col).groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("f"))
    glued = F.flatten(F.transform("f", lambda x, i: F.when(i == 0, x["tokens"]).otherwise(F.concat(F.array(F.lit(separator)), x["tokens"]))))
    bins = joined.select(F.lit(1).alias("part"), F.lit(None).cast(df.schema[id_col].dataType).alias("document"), F.col("bin").alias("ordinal"), glued.alias("tokens"))
    return full.unionByName(last).select(F.lit(0).alias("part"), "document", "ordinal", "tokens").unionByName(bins)
