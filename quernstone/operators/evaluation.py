"""The evaluation loop: prompt, completion, strip, extract, validate, rate."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import extract_code, strip_prompt
from quernstone.operators.generation import Model
from quernstone.operators.quality import pass_rate


def completions(items: DataFrame, id_col: str, prompt_col: str, make_model: Callable[[], Model]) -> DataFrame:
    """(`id_col`, ``prompt``, ``completion``) of every item with a prompt; the model is made once per task."""

    def run(batches):
        model = make_model()
        for b in batches:
            got = [model.complete([{"role": "user", "content": p}]) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [id_col, "prompt", "completion"])

    kind = items.schema[id_col].dataType.simpleString()
    asked = items.where(F.col(prompt_col).isNotNull()).select(F.col(id_col), F.col(prompt_col).alias("prompt"))
    return asked.mapInArrow(run, f"`{id_col}` {kind}, prompt string, completion string")


def judged(answered: DataFrame, id_col: str, check: Callable[[Column], Column]) -> DataFrame:
    """(`id_col`, ``code``, ``passed``): the code of each completion without the prompt it may repeat, and whether it passes;
    a completion without code fails."""
    code = extract_code(strip_prompt("completion", "prompt"))
    rows = answered.select(F.col(id_col), code.alias("code"))
    return rows.select(id_col, "code", (F.coalesce(F.length("code") > 0, F.lit(False)) & F.coalesce(check(F.col("code")), F.lit(False))).alias("passed"))


def evaluate(items: DataFrame, id_col: str, prompt_col: str, by: str, make_model: Callable[[], Model], check: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(judged items, pass rate by `by`); the failed ones are those with ``passed`` false."""
    result = judged(completions(items, id_col, prompt_col, make_model), id_col, check)
    rated = pass_rate(result.join(items.select(id_col, by), id_col), by, F.col("passed"))
    return result, rated
