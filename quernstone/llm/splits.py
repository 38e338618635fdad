"""Splits that keep related records together: components by hooking and shortcutting, totals by subset-sum bitsets."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.textnorm import file_key, idea_key
from quernstone.session import cut_lineage, written


def _node(kind: bytes, key: str | None) -> bytes | None:
    """A vertex: 128 bits of its key."""
    return None if key is None else hashlib.md5(kind + key.encode("utf-8", "surrogatepass")).digest()


def keyed(df: DataFrame, id_col: str, file_col: str, idea_col: str) -> DataFrame:
    """(`id_col`, ``name``, ``f``, ``i``): the raw file name and the vertices of file and idea, null where they link nothing."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = [_node(b"f", file_key(x)) for x in b.column(1).to_pylist()]
            i = [_node(b"i", idea_key(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary()), pa.array(i, pa.binary())], [id_col, "name", "f", "i"])

    rows = df.select(F.col(id_col), F.col(file_col).cast("string"), F.col(idea_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, name string, f binary, i binary")


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``) of every vertex of undirected ``edges`` (``a``, ``b``): the least vertex of its component.

    Every round hooks each root onto the least root next to it, then shortcuts all parents to their roots, and replaces
    the edges by the distinct ones between different roots; edges inside a component vanish, so what is moved shrinks from
    round to round, and a star of any size is done after one. Rounds grow with the logarithm of the longest path. Each
    round is checkpointed in the shared folder; nothing goes to the driver but counts.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    live = written(live, "edges")
    parent = live.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root"))
    while live.head(1):
        # hook: every root takes the least root among its neighbours, if that is less than itself
        hooks = cut_lineage(live.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("to")))
        # shortcut: follow the hooks until all of them end at a root
        while True:
            nxt = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.r"), "left")
            jumped = cut_lineage(nxt.select("x.r", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            hooks = jumped.select("r", "to")
            if not jumped.where("moved").head(1):
                break
        parent = cut_lineage(
            parent.join(hooks, parent["root"] == hooks["r"], "left").select("v", F.coalesce("to", "root").alias("root"))
        )
        left = hooks.select(F.col("r").alias("ra"), F.col("to").alias("ta"))
        right = hooks.select(F.col("r").alias("rb"), F.col("to").alias("tb"))
        moved = live.join(left, live["a"] == left["ra"], "left").join(right, live["b"] == right["rb"], "left")
        moved = moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        live = cut_lineage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return parent


def looked_up(rows: DataFrame, key: str, table: DataFrame, most: int = 10_000, least: int = 100_000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once, or nulls. A key may hold any share of the rows: rows
    without a key are not moved, and keys of more than ``least`` rows and one in ``most`` of all, so fewer than ``most``
    keys, meet a broadcast part of the table where they lie."""
    none = rows.where(F.col(key).isNull())
    for c in table.columns:
        if c != key:
            none = none.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    keyed_rows = rows.where(F.col(key).isNotNull())
    floor = max(least, rows.count() // most)
    often = keyed_rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > floor).select(key)
    often = written(often, "often")
    if not often.head(1):
        return keyed_rows.join(table, key, "left").unionByName(none)
    held = F.broadcast(often.join(table, key, "left"))
    rest = keyed_rows.join(F.broadcast(often), key, "left_anti").join(table, key, "left")
    return keyed_rows.join(held, key).unionByName(rest).unionByName(none)


def linked(df: DataFrame, id_col: str = "sft_id", file_col: str = "filename", idea_col: str = "idea") -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and the component root of every file and idea vertex.

    Ideas that only one row has link nothing and make no edge. Rows are first reduced to distinct pairs of file and idea.
    """
    rows = written(keyed(df, id_col, file_col, idea_col), "keyed")
    pairs = rows.where("i is not null").groupBy("f", "i").count()
    often = pairs.groupBy("i").agg(F.sum("count").alias("n"), F.min("f").alias("least")).where("n > 1 and least is not null")
    stars = pairs.where("f is not null").join(often, "i").select(F.col("f").alias("a"), F.col("least").alias("b"))
    ideas = often.select(F.col("i").alias("a"), F.col("least").alias("b"))
    roots = components(stars.unionByName(ideas))
    return rows, roots


def split_together(df: DataFrame, proportions: dict[str, float] | None = None, id_col: str = "sft_id", file_col: str = "filename", idea_col: str = "idea") -> DataFrame:
    """(`id_col`, ``split``, ``component``): one row per input row; rows linked by file or idea, directly or through
    others, get the same split, and the splits' row totals are as close to the proportions as the components allow.

    The first split named takes what the others leave. Null, blank and ``unknown.rst`` names and null, blank and
    placeholder ideas link nothing; a row with neither is a component of its own. A component larger than every other
    split's share stays in the first. Repeated rows are rows of their own and stay together; an empty table gives an
    empty table; other columns, whatever their names, are ignored.
    """
    proportions = proportions or {"train": 0.9, "validation": 0.05, "test": 0.05}
    rows, roots = linked(df, id_col, file_col, idea_col)
    # a file vertex first, else the idea's, else the row alone; ideas without an edge still hold their repeated rows
    at = F.coalesce("f", "i")
    alone = F.unhex(F.md5(F.concat_ws("\x1f", F.lit("r"), F.col(id_col).cast("string"))))
    labelled = (
        looked_up(written(rows.select(id_col, at.alias("v")), "at"), "v", roots)
        .select(id_col, F.coalesce("root", "v", alone).alias("component"))
    )
    labelled = written(labelled, "labelled")
    sizes = written(labelled.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    quotas = choose({r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()}, proportions)
    names = list(proportions)
    spark = df.sparkSession
    # rank the components of one size by hash: within buckets, plus the counts of the buckets before; no task gets a whole size
    ranked = sizes.withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod(F.col("h"), F.lit(256)))
    counts = ranked.groupBy("size", "bucket").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "component")) + F.col("before")
    table = [(size, *taken) for size, taken in sorted(quotas.items())]
    quota = spark.createDataFrame(table, "size bigint, " + ", ".join(f"q{k} bigint" for k in range(1, len(names))))
    ranked = ranked.join(before.drop("count"), ["size", "bucket"]).withColumn("rank", rank).join(quota, "size", "left")
    split, seen = F.lit(None).cast("string"), F.lit(0)
    for k in range(1, len(names)):
        seen = seen + F.coalesce(F.col(f"q{k}"), F.lit(0))
        split = F.coalesce(split, F.when(F.col("rank") <= seen, names[k]))
    assigned = ranked.select("component", F.coalesce(split, F.lit(names[0])).alias("split"))
    return looked_up(labelled, "component", assigned).select(id_col, "split", F.lower(F.hex("component")).alias("component"))


def choose(multiplicity: dict[int, int], proportions: dict[str, float], most_bits: int = 1 << 29) -> dict[int, tuple[int, ...]]:
    """How many components of each size every split but the first takes, so that its total is closest to its share.

    The reachable totals of a split are a bitset: each size enters in powers of two of its multiplicity, as one shift.
    The number of different sizes is at most about the square root of twice the rows. If all bitsets together would
    exceed ``most_bits``, only one in about the square root of their number is kept and those between are made again;
    the result is the same.
    """
    left = dict(multiplicity)
    total = sum(s * n for s, n in multiplicity.items())
    taken: dict[int, list[int]] = {s: [] for s in multiplicity}
    for name in list(proportions)[1:]:
        target = round(total * proportions[name] / sum(proportions.values()))
        got = _closest(left, target, most_bits)
        for s in left:
            left[s] -= got.get(s, 0)
            taken[s].append(got.get(s, 0))
    return {s: tuple(t) for s, t in taken.items() if any(t)}


def _closest(multiplicity: dict[int, int], target: int, most_bits: int) -> dict[int, int]:
    """The sub-multiset of sizes whose total is closest to ``target`` (the lower one on a tie)."""
    items = []
    for size, n in sorted(multiplicity.items(), reverse=True):
        part = 1
        while n > 0:
            part = min(part, n)
            if size * part <= 2 * target + 1:
                items.append((size, part))
            n -= part
            part *= 2
    mask = (1 << (2 * target + 2)) - 1
    step = 1 if len(items) * (2 * target + 2) <= most_bits else max(1, math.isqrt(len(items)))
    reach, used, kept = 1, 0, []
    for size, part in items:
        if used % step == 0:
            kept.append(reach)
        reach |= reach << size * part & mask
        used += 1
        if reach >> target & 1:
            break
    low = reach & ((1 << (target + 1)) - 1)
    below = low.bit_length() - 1
    above = reach >> (target + 1)
    if above and (above & -above).bit_length() < target - below:
        below = target + (above & -above).bit_length()
    got: dict[int, int] = {}
    while kept:
        stretch, history = items[(len(kept) - 1) * step : used], [kept.pop()]
        for size, part in stretch[:-1]:
            history.append(history[-1] | history[-1] << size * part & mask)
        for (size, part), before in zip(reversed(stretch), reversed(history)):
            if before >> below & 1:
                continue
            got[size] = got.get(size, 0) + part
            below -= size * part
        used -= len(stretch)
    return got


def names_together(df: DataFrame, id_col: str = "sft_id", file_col: str = "filename", idea_col: str = "idea", block: int = 2048) -> DataFrame:
    """(``filename_a``, ``filename_b``): pairs of different raw names in one component, the smaller first by code points.
    Names that name nothing are in no pair; other cases as in :func:`split_together`."""
    rows, roots = linked(df, id_col, file_col, idea_col)
    names = rows.where("f is not null").select("name", F.col("f").alias("v")).distinct()
    named = written(names.join(roots, "v", "left").select("name", F.coalesce("root", "v").alias("root")), "names")
    # the names of one component meet in blocks: no task gets all pairs of a large one
    sizes = written(named.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n"), "blocks")
    met = looked_up(named, "root", sizes).where("blocks is not null")
    a = met.select("root", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"), F.col("name").alias("filename_a"))
    b = met.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("name").alias("filename_b"))
    return a.join(b, ["root", "block"]).where("filename_a < filename_b").select("filename_a", "filename_b").distinct()
