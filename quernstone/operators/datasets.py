"""Rows of continued-pretraining and fine-tuning datasets, their splits and manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import response, strip, with_suffix
from quernstone.session import written

MESSAGES = "array<struct<role:string,content:string>>"
SFT_SCHEMA = f"prompt {MESSAGES}, completion {MESSAGES}, filename string, python_version string, idea string, code string, trace string, expected_output string"
CPT_SCHEMA = "filename string, text string"


def cpt_rows(rendered: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(``filename``, ``text``): rendered Markdown under the name of its source."""
    return rendered.select(with_suffix(path_col, ".md", ".rst").alias("filename"), F.col(text_col).alias("text"))


def messages(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def sft_rows(made: DataFrame) -> DataFrame:
    """The eight columns of a fine-tuning row from prompt, explanation, code, trace, expected output and origin."""
    return made.select(
        messages("user", F.col("prompt")).alias("prompt"),
        messages("assistant", response("explanation", "code")).alias("completion"),
        "filename", "python_version", "idea", "code", "trace", "expected_output",
    )


def turn_pairs(turns: DataFrame, by: str, order: str) -> DataFrame:
    """(`by`, `order`, ``prompt``, ``response``): every user turn followed at once by an assistant's."""
    w = Window.partitionBy(by).orderBy(order)
    nxt = turns.withColumn("__r", F.lead("role").over(w)).withColumn("__c", F.lead("content").over(w))
    return nxt.where("role = 'user' and __r = 'assistant'").select(by, order, F.col("content").alias("prompt"), F.col("__c").alias("response"))


def verified(actual: Column, expected: Column) -> Column:
    """Whether an output is the expected one but for outer white space; how the run ended does not matter."""
    return F.coalesce(strip(actual) == strip(expected), F.lit(False))


def settle(is_verified: Column, passed: Column, expected: Column, actual: Column) -> tuple[Column, Column]:
    """(``kept``, expected output): verified rows keep the expected output, rows a judge accepts take the actual one, all
    others are not kept."""
    kept = is_verified | F.coalesce(passed, F.lit(False))
    return kept, F.when(is_verified, expected).when(F.coalesce(passed, F.lit(False)), actual)


def exact_split(df: DataFrame, id_col: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exactly ``ceil(ratio * n)`` rows are ``eval``, those first by md5 of seed and id.

    The cut is found without one global sort: hashes are counted by their first four digits (65,536 groups at most), the
    group that holds the cut is found on the driver, and only its rows are ranked. Rows that share an id, and those without
    one, have one hash and come into the same split, so repeated ids at the cut make ``eval`` longer by their number.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))
    hashed = df.withColumn("__h", F.coalesce(h, F.md5(F.lit(str(seed))))).withColumn("__g", F.substring("__h", 1, 4))
    counts = sorted((r["__g"], r["n"]) for r in hashed.groupBy("__g").agg(F.count("*").alias("n")).collect())
    wanted, group = math.ceil(ratio * sum(n for _, n in counts)), None
    for g, n in counts:
        group = g
        if wanted <= n:
            break
        wanted -= n
    border = hashed.where(F.col("__g") == F.lit(group)).orderBy("__h", id_col).limit(wanted).agg(F.max("__h")).first()[0] if group is not None and wanted else None
    is_eval = (F.col("__h") <= F.lit(border)) if border is not None else (F.col("__g") < F.lit(group or ""))
    return hashed.withColumn("split", F.when(is_eval, "eval").otherwise("train")).drop("__h", "__g")


def step_plan(df: DataFrame, by: str, batch: int, accumulation: int, epochs: int) -> DataFrame:
    """(`by`, ``n_rows``, ``steps``): optimizer steps a stage takes."""
    rows = df.groupBy(by).agg(F.count("*").alias("n_rows"))
    return rows.withColumn("steps", (F.ceil(F.col("n_rows") / (batch * accumulation)) * epochs).cast("bigint"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; partial minima are merged, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(``table_name``, ``n_rows``) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def ranked(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of every row in the whole order, from 1. Rows are range-partitioned and ranked per partition,
    on top of the counts of the partitions before; no task sees all rows."""
    spark = df.sparkSession
    parted = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id()), "ranked")
    counts = parted.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", before.alias("__b"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__b")
    return parted.join(F.broadcast(offsets), "__p").withColumn(name, place.cast("bigint")).drop("__p", "__b")


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``df`` with its ``place`` in an order that depends on seed and id only, ties by id."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("/"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return ranked(df.withColumn("__h", h), ["__h", id_col]).drop("__h")


def text_column(df: DataFrame, name: str = "text") -> Column:
    """What a trainer reads: the column ``text`` where there is one, else all message contents joined by line feeds."""
    if name in df.columns:
        return F.col(name)
    messages_ = F.concat(*(F.coalesce(F.col(c), F.array()) for c in ("prompt", "completion")))
    return F.array_join(F.transform(messages_, lambda m: m["content"]), "\n")


def unknown_columns(df: DataFrame, known: set[str]) -> list[str]:
    """Columns beyond the known ones, in order."""
    return [c for c in df.columns if c not in known]
