"""Exact similarity join of word sets by pivot regions with windows, joined recursively.

Distance between two sets is the size of their symmetric difference; a Jaccard similarity of at least ``t`` means a
distance of at most ``(1 - t) / (1 + t)`` times the sum of their sizes. Pivots are words in one order, rare ones first.
The region of a pivot holds the sets that have the word near enough to the front of their order: a set that is cut out
of every region up to there would already differ from its partner by more than the distance allows. So a set lies in the
region of its first word and, as a boundary set, in those of the window behind it; the window's length follows from the
distance. The members of every region are counted; one that holds too many is divided by its next pivots, windows one
longer, and so on, as long as that at least halves its work; what cannot be divided is compared in salted blocks. The sets
of a region are compared within size, position and mark windows, which the same distance gives, and the survivors
verified exactly.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.splits import components
from quernstone.session import written

_WORD = re.compile(r"\w+")


def _hash64(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def word_sets(df: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """(``id``, ``set``, ``words``): the distinct words of the columns joined by blanks, as ascending 64-bit hashes, and a
    128-bit hash of them; rows with a null or blank column, or without a word, are left out."""

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            ids, keys, flat, ends = [], [], [], [0]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] is None or any(t is None or not t.strip() for t in row[1:]):
                    continue
                words = {w.lower() for w in _WORD.findall(" ".join(row[1:]))}
                if not words:
                    continue
                if len(known) > 500_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = _hash64(w)
                made = np.unique(np.array([known[w] for w in words], np.int64))
                ids.append(row[0])
                keys.append(hashlib.md5(made.tobytes()).digest())
                flat.append(made)
                ends.append(ends[-1] + len(made))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(keys, pa.binary()), lists], ["id", "set", "words"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *columns).mapInArrow(run, f"id {kind}, set binary, words array<bigint>")


def frequencies(sets: DataFrame, share: float, cells: int) -> tuple[dict[int, int], np.ndarray]:
    """Number of sets of every word that at least ``share`` of all sets hold (at most mean set size / ``share`` words), and
    the counts of all other words summed in ``cells`` cells by hash."""
    n = sets.count()
    counts = written(sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "counts")
    floor = max(2, math.ceil(share * n))
    kept = counts.where(F.col("n") >= floor).toArrow()
    rest = counts.where(F.col("n") < floor).groupBy(F.pmod("w", F.lit(cells)).alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    summed = np.zeros(cells, np.int64)
    summed[rest.column(0).to_numpy()] = rest.column(1).to_numpy()
    return dict(zip(kept.column(0).to_pylist(), kept.column(1).to_pylist())), summed


def _ranked(words: np.ndarray, often: dict[int, int], summed: np.ndarray) -> list[tuple[int, int]]:
    """(frequency, word) of a set, rare words first. A frequency of 1 is exact: no other set has the word."""
    cells = summed[words % len(summed)].tolist()
    return sorted((often.get(w, c), w) for w, c in zip(words.tolist(), cells))


def _link(chain: int, word: int) -> int:
    """The hash of a chain of pivots with one more; equal hashes of different chains only merge their regions."""
    both = chain.to_bytes(8, "little", signed=True) + word.to_bytes(8, "little", signed=True)
    return int.from_bytes(hashlib.blake2b(both, digest_size=8).digest(), "little", signed=True)


def _need(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


_MEMBER = ("key", "id", "size", "at", "marks", "last", "depth")


def similar_sets(sets: DataFrame, threshold: float, share: float = 2e-4, most: int = 256, cells: int = 1 << 18) -> DataFrame:
    """(``a``, ``b``, ``similarity``) of all pairs of different sets (``id``, ``words``) that are similar enough, ``a`` < ``b``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    pairs = _candidates(sets, threshold, share, most, cells)
    left, right = sets.select(F.col("id").alias("x_id"), F.col("words").alias("x_words")), sets.select(F.col("id").alias("y_id"), F.col("words").alias("y_words"))
    both = pairs.join(left, "x_id").join(right, "y_id")
    common = F.size(F.array_intersect("x_words", "y_words"))
    total = F.size("x_words") + F.size("y_words") - F.col("common")
    return (
        both.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), "x_words", "y_words", common.alias("common"))
        .withColumn("similarity", F.col("common") / total)
        .where(F.col("common") >= F.lit(threshold) * total - 1e-9)
        .select("a", "b", "similarity")
    )


def regions(sets: DataFrame, threshold: float, share: float, most: int, cells: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """The regions' members, from the sets (``id``, ``words``), in three lists of tables.

    Regions of at most ``most`` members; larger ones that no division makes cheaper, with their number ``n``; and the sets
    too small to share more words than the pivots of a divided region (``key``, ``id``, ``size``, ``depth``), which are
    similar by these pivots alone. ``at`` is the position of the last pivot less the pivots before it, ``last`` that
    position, ``marks`` 64 bits of the set's words.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequencies(sets, share, cells))
    kind = sets.schema["id"].dataType.simpleString()
    kinds = (pa.int64(), None, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    schema = f"key bigint, id {kind}, size int, at int, marks bigint, last int, depth int"

    def own_words(column):
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]

    def record(columns, id_kind, more=()):
        filled = [pa.array(c, k or id_kind) for c, k in zip(columns, (*kinds, *(k for _, k in more)))]
        return pa.RecordBatch.from_arrays(filled, [*_MEMBER, *(n for n, _ in more)])

    def first(batches):
        often, summed = shared.value
        for b in batches:
            out: list[list] = [[] for _ in _MEMBER]
            for i, own in zip(b.column(0).to_pylist(), own_words(b.column(1))):
                size = len(own)
                ranked = _ranked(own, often, summed)
                marks = int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), own.view(np.uint64) % np.uint64(64))).view(np.int64))
                # the first shared word lies within the first size - need + 1 words of either set
                for k in range(size - _need(size, threshold) + 1):
                    if ranked[k][0] > 1:
                        for c, v in zip(out, (ranked[k][1], i, size, k, marks, k, 1)):
                            c.append(v)
            yield record(out, b.column(0).type)

    def next_pivots(batches):
        often, summed = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(len(_MEMBER) + 1)]
            rows = zip(*(b.column(k).to_pylist() for k in range(7)), own_words(b.column(7)))
            for key, i, size, _, marks, last, depth, own in rows:
                ranked = _ranked(own, often, summed)
                for k in range(last + 1, min(size, size - _need(size, threshold) + depth + 1)):
                    if ranked[k][0] > 1:
                        for c, v in zip(out, (_link(key, ranked[k][1]), i, size, k - depth, marks, k, depth + 1, key)):
                            c.append(v)
            yield record(out, b.column(1).type, (("parent", pa.int64()),))

    def large(counts):
        return written(counts.where(F.col("n") > most), "large")

    members = written(sets.select("id", "words").mapInArrow(first, schema), "members")
    crowded = large(members.groupBy("key").agg(F.count("*").alias("n")))
    small, whole, few = [members.join(crowded, "key", "left_anti")], [], []
    words = sets.select("id", "words")
    while crowded.head(1):
        members = written(members.select(*_MEMBER).join(crowded, "key"), "crowded")
        children = members.select(*_MEMBER).join(words, "id").select(*_MEMBER, "words").mapInArrow(next_pivots, schema + ", parent bigint")
        counts = written(children.groupBy("parent", "key").agg(F.count("*").alias("n")), "children")
        # work: comparisons, and the rows that have to be made and moved for them
        work = F.col("n") * (F.col("n") / 2 + 8)
        made = counts.groupBy(F.col("parent").alias("key")).agg(F.sum(work).alias("made"))
        judged = crowded.join(made, "key", "left").select("key", (F.coalesce("made", F.lit(0.0)) <= work / 2).alias("divided"))
        judged = written(judged, "judged")
        divided = judged.where("divided").select("key")
        whole.append(members.join(judged.where(~F.col("divided")).select("key"), "key"))
        few.append(members.join(divided, "key").where(F.ceil(F.lit(threshold) * F.col("size") - 1e-9) <= F.col("depth")).select("key", "id", "size", "depth"))
        parents = members.join(divided, "key").select(*_MEMBER)
        kept = counts.join(divided.withColumnRenamed("key", "parent"), "parent").select("key", "n")
        crowded = large(kept.groupBy("key").agg(F.sum("n").alias("n")))
        members = written(parents.join(words, "id").select(*_MEMBER, "words").mapInArrow(next_pivots, schema + ", parent bigint").drop("parent"), "members")
        small.append(members.join(crowded, "key", "left_anti"))
    return small, whole, few


def _candidates(sets: DataFrame, threshold: float, share: float, most: int, cells: int) -> DataFrame:
    """(``x_id``, ``y_id``), ``x_id`` < ``y_id``: all pairs that share a region and pass its windows."""
    small, whole, few = regions(sets, threshold, share, most, cells)
    columns = ("id", "size", "at", "marks")

    def sides(members, *keys):
        return (members.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "xy")

    # size window; position window: what is left from both pivots on must suffice for the overlap needed; and mark window:
    # every mark that only one of the sets has is an element that only one has
    both = F.col("x_size") + F.col("y_size")
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * both - 1e-9)
    near = (
        (F.col("x_id") < F.col("y_id"))
        & (F.col("x_size") >= threshold * F.col("y_size") - 1e-9)
        & (F.col("y_size") >= threshold * F.col("x_size") - 1e-9)
        & (F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) >= overlap)
        & (F.bit_count(F.col("x_marks").bitwiseXOR(F.col("y_marks"))) <= both - 2 * overlap)
    )
    out = []
    for members in small:
        x, y = sides(members, "key")
        out.append(x.join(y, "key").where(near))
    salts = F.ceil(F.col("n") / most).cast("int")
    for members in whole:
        x, _ = sides(members.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")), "key", "salt")
        _, y = sides(members.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "key", "salt")
        out.append(x.join(y, ["key", "salt"]).where(near))
    pairs = [p.select("x_id", "y_id") for p in out]
    for members in few:
        # of these sets every two are similar whose sizes leave no more than the distance allows beside the pivots
        room = F.floor(F.col("depth") * F.lit(1 + 1 / threshold) + 1e-9).cast("int") - F.col("size")
        x = members.where(room >= F.col("size")).select("key", F.col("id").alias("x_id"), F.col("size").alias("own"), F.explode(F.sequence(F.col("size"), room)).alias("size"))
        y = members.select("key", F.col("id").alias("y_id"), "size")
        met = x.join(y, ["key", "size"]).where((F.col("x_id") < F.col("y_id")) | (F.col("own") < F.col("size")))
        pairs.append(met.select(F.least("x_id", "y_id").alias("x_id"), F.greatest("x_id", "y_id").alias("y_id")))
    total = pairs[0]
    for p in pairs[1:]:
        total = total.unionByName(p)
    return total.distinct()


def near_links(df: DataFrame, id_col: str = "sft_id", columns: tuple[str, ...] = ("idea", "code"), threshold: float = 0.75, **options) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with equal word sets (``rep``, ``id``), and the links between the classes' representatives (``a``,
    ``b``, ``similarity``). Every class is joined once, so copies, however many, cost nothing in the join."""
    sets = written(word_sets(df, id_col, columns), "sets")
    classes = written(sets.select("id", "set").join(sets.groupBy("set").agg(F.min("id").alias("rep")), "set").select("rep", "id").distinct(), "classes")
    reps = written(sets.groupBy("set").agg(F.min_by("words", "id").alias("words"), F.min("id").alias("id")).select("id", "words"), "reps")
    return classes, written(similar_sets(reps, threshold, **options), "links")


def near_pairs(df: DataFrame, id_col: str = "sft_id", columns: tuple[str, ...] = ("idea", "code"), threshold: float = 0.75, block: int = 2048, **options) -> DataFrame:
    """(`id_col`_a, `id_col`_b): all pairs of rows whose word sets have at least the Jaccard similarity, smaller id first.

    Rows with a null or blank column are in no pair; equal rows are pairs with similarity 1; a row is never paired with
    itself, also where its id stands twice; an empty table gives an empty table; other columns are ignored. Sets are
    compared by 64-bit hashes of their words.
    """
    classes, links = near_links(df, id_col, columns, threshold, **options)
    # a class is met block by block, so no task gets all rows of one, however many copies there are
    sized = classes.join(classes.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "rep")
    rows = written(sized.select("rep", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "blocks")
    parts = rows.select("rep", "block").distinct()
    within = rows.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    met = links.select("a", "b").unionByName(within)
    met = met.join(parts.toDF("a", "block_a"), "a").join(parts.toDF("b", "block_b"), "b").where("a <> b or block_a <= block_b")
    met = written(met, "met")
    side = [rows.select(F.col("rep").alias(k), F.col("block").alias(f"block_{k}"), F.col("id").alias(i)) for k, i in ("ai", "bj")]
    i, j = (met.join(s, [s.columns[0], s.columns[1]]) for s in side)
    every = i.join(j, ["a", "block_a", "b", "block_b"]).where("i <> j and (a <> b or block_a <> block_b or i < j)")
    return every.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b")).distinct()


def near_groups(df: DataFrame, id_col: str = "sft_id", columns: tuple[str, ...] = ("idea", "code"), threshold: float = 0.75, **options) -> DataFrame:
    """(`id_col`, ``group``, ``links``): each row that has a word set, with the least id of its group of chained links and
    the number of its class's links to other classes; cases as in :func:`near_pairs`, but a row alone is its own group."""
    classes, links = near_links(df, id_col, columns, threshold, **options)
    roots = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        classes.join(roots.withColumnRenamed("v", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select(F.col("id").alias(id_col), F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )
