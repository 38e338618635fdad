"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import WS
from quernstone.llm import budget as _budget
from quernstone.llm import encode as _encode
from quernstone.llm import leak as _leak
from quernstone.llm import markup as _markup
from quernstone.llm import neardup as _neardup
from quernstone.llm import pack as _pack
from quernstone.llm import pairs as _pairs
from quernstone.llm import segment as _segment
from quernstone.llm import sentences as _sentences
from quernstone.llm import splits as _splits
from quernstone.session import spread, table


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows, over all cores where it comes in few pieces."""
    return spread(table(spark, sf_dir, name))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of markup left in every ``cpt.text``."""
    return _markup.markup_found(_rows(spark, sf_dir, "cpt"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``cpt.text`` without its markup."""
    return _markup.clean_markup(_rows(spark, sf_dir, "cpt"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs with their defect."""
    return _pairs.pair_defects(_rows(spark, sf_dir, "sft")).where(F.col("defect").isNotNull()).select("sft_id", "defect")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of raw file names whose rows must share a split."""
    return _splits.names_together(_rows(spark, sf_dir, "sft"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every ``sft`` row."""
    return _splits.split_together(_rows(spark, sf_dir, "sft"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``sft`` rows whose idea and code have word sets with a Jaccard similarity of at least 0.75."""
    return _neardup.near_pairs(_rows(spark, sf_dir, "sft"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every ``sft`` row."""
    return _neardup.near_groups(_rows(spark, sf_dir, "sft"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than 6,000 code points, and whether a block of theirs had to be cut."""
    return _segment.oversized(_rows(spark, sf_dir, "cpt"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as pieces of at most 6,000 code points with 200 of overlap."""
    return _segment.cut_oversized(_rows(spark, sf_dir, "cpt"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 4,096 tokens."""
    return _pack.pack_texts(_rows(spark, sf_dir, "cpt"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices each ``cpt`` and ``sft`` row counts for."""
    rows = _budget.row_slices(_rows(spark, sf_dir, "cpt"), _rows(spark, sf_dir, "sft"), table(spark, sf_dir, "source_catalogue"))
    return rows.select("tab", "row_id", "slice_kind", "slice_value").distinct()


def p7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and tokens of every slice."""
    return _budget.token_budget(_rows(spark, sf_dir, "cpt"), _rows(spark, sf_dir, "sft"), table(spark, sf_dir, "source_catalogue"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every ``documents.text`` under ``byte_bpe_50k``."""
    return _encode.encode_corpus(_rows(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of an item's prompt followed by its answer."""
    return _leak.leaked(_rows(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_prompts"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word spans to remove from each document, per leaked item."""
    return _leak.leaked_spans(_rows(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_prompts"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the sentences of every prose document; the evidence comes from all documents."""
    documents = _rows(spark, sf_dir, "documents")
    evidence = _sentences.corpus_evidence(documents)
    prose = documents.where(F.col("kind") == "prose")
    found = _sentences.split_sentences(prose, evidence=evidence, with_text=False)
    return found.select("doc_id", F.col("end").alias("end_pos"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say: the other operators are tested against brute force, round trips and public libraries."""
    blank = "||".join(f"chr({ord(c)})" for c in WS)
    return {
        "p4_found": f"""with s as (select sft_id, unnest(list_distinct(regexp_extract_all(lower(idea || ' ' || code), '[\\p{{L}}\\p{{N}}_]+'))) as w
  from sft where trim(idea, {blank}) <> '' and trim(code, {blank}) <> ''), n as (select sft_id, count(*) as n from s group by 1)
select sft_id_a, sft_id_b from (select a.sft_id as sft_id_a, b.sft_id as sft_id_b, count(*) as k from s a join s b on a.w = b.w and a.sft_id < b.sft_id group by 1, 2)
join n x on x.sft_id = sft_id_a join n y on y.sft_id = sft_id_b where k >= 0.75 * (x.n + y.n - k)"""
    }
