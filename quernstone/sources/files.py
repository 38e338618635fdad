"""Document scans, JSONL with strict schemas, catalogues, per-document text files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import path_key


def scan_documents(spark: SparkSession, path: str, suffix: str = "*.rst", must_exist: bool = True) -> DataFrame:
    """(``path``, ``filename``, ``text``): the documents below a directory, or a single file of any suffix.

    ``path`` is relative with forward slashes; :func:`quernstone.functions.text.path_key` orders it component by
    component. With ``must_exist`` an empty scan is an error.
    """
    single = os.path.isfile(path)
    options = {} if single else {"recursiveFileLookup": True, "pathGlobFilter": suffix}
    root = os.path.abspath(os.path.dirname(path) if single else path).rstrip("/") + "/"
    found = spark.read.text(path, wholetext=True, **options).select(F.col("value").alias("text"), F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("full"))
    df = found.select(F.substring_index("full", root, -1).alias("path"), F.element_at(F.split("full", "/"), -1).alias("filename"), "text")
    if must_exist and not df.head(1):
        raise ValueError(f"no {suffix} under {path}")
    return df


def ordered_documents(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.orderBy(path_key(path_col))


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of JSONL files in argument order, with ``path_ordinal``. Blank lines are skipped, a malformed line is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no paths")
    out = None
    for k, p in enumerate(paths):
        one = spark.read.schema(schema).option("mode", "FAILFAST").json(p).withColumn("path_ordinal", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def write_jsonl(df: DataFrame, path: str, if_exists: str = "error", order: list[str] | None = None) -> None:
    """Rows as JSON lines under ``path``, which must end in ``.jsonl``; ``if_exists`` is error, overwrite or append.

    With ``order`` the files are range-partitioned and sorted, so reading them in name order gives the order back.
    """
    if not path.endswith(".jsonl"):
        raise ValueError("the output must end in .jsonl")
    if if_exists not in ("error", "overwrite", "append"):
        raise ValueError(f"unknown policy {if_exists}")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("errorifexists" if if_exists == "error" else if_exists).option("ignoreNullFields", False).json(path)


def write_documents(df: DataFrame, root: str, name_col: str = "document", text_col: str = "text", suffix: str = ".rst") -> None:
    """One file per document below ``root``, directories kept; each task writes its own documents, a repeated one again."""
    root = os.path.abspath(root)

    def put(rows):
        for r in rows:
            at = os.path.abspath(os.path.join(root, r[0] + suffix))
            if not at.startswith(root + os.sep):
                raise ValueError(f"{r[0]} leaves the output directory")
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{at}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r[1])
            os.replace(part, at)

    df.select(name_col, text_col).where(F.col(text_col).isNotNull()).foreachPartition(put)


def require_file(root: str, name: str = "conf.py") -> None:
    """Raises unless a documentation root holds its configuration file."""
    if not os.path.isfile(os.path.join(root, name)):
        raise ValueError(f"no {name} in {root}")


def example_rows(spark: SparkSession, examples: list[tuple[str, str]]) -> DataFrame:
    """(``ordinal``, ``description``, ``code``): a literal table of examples, in order."""
    return spark.createDataFrame([(k, *e) for k, e in enumerate(examples)], "ordinal int, description string, code string")


def with_patterns(seeds: DataFrame, patterns: list[str], most: int = 1000) -> DataFrame:
    """Every seed with every approved pattern (``pattern``, numbered by ``pattern_no``): each row is multiplied where it lies
    by a literal list of at most ``most`` patterns; no join, no shuffle."""
    if len(patterns) > most:
        raise ValueError(f"more than {most} patterns")
    return seeds.select("*", F.posexplode(F.array(*map(F.lit, patterns)).cast("array<string>")).alias("pattern_no", "pattern"))


def catalogue(spark: SparkSession, nested: dict[str, dict[str, dict[str, str]]]) -> DataFrame:
    """A nested literal, version to category to name to address, as rows."""
    rows = [(v, c, n, u) for v, cs in nested.items() for c, ns in cs.items() for n, u in ns.items()]
    return spark.createDataFrame(rows, "target_version string, category string, name string, url string")


def of_version(entries: DataFrame, version: str) -> DataFrame:
    """The entries of one version; an unknown version is an error that names the known ones."""
    known = sorted(r[0] for r in entries.select("target_version").distinct().limit(1000).collect() if r[0] is not None)
    if version not in known:
        raise ValueError(f"{version} is none of {', '.join(known)}")
    return entries.where(F.col("target_version") == version).select("*", F.concat_ws("/", F.lit("input"), "category", F.concat("name", F.lit(".rst"))).alias("destination"))
