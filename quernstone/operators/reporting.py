"""What is shown, counted and logged about rows: previews, limits, run metrics, progress, seed examples."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.generation import Runner, capped

KNOWN = ("filename", "python_version", "idea", "code", "trace", "expected_output", "prompt", "completion")
# Colours of message roles.
COLOURS = {"user": "cyan", "assistant": "green", "system": "yellow"}


def preview(row: dict) -> str:
    """One row for reading: origin, code in a fence, trace and output, then unknown keys with a true value, then messages."""
    out = [f"{k}: {row[k]}" for k in KNOWN[:3] if row.get(k)]
    if row.get("code"):
        out.append(f"```python\n{row['code']}\n```")
    out += [f"{k}: {row[k]}" for k in KNOWN[4:6] if row.get(k)]
    out += [f"{k}: {v}" for k, v in row.items() if k not in KNOWN and v]
    for m in [*(row.get("prompt") or []), *(row.get("completion") or [])]:
        out.append(f"[{COLOURS.get(m['role'], 'white')}] {m['role']}: {m['content']}")
    return "\n".join(out)


def previews(df: DataFrame, n: int = 3) -> list[str]:
    return [preview(r.asDict(recursive=True)) for r in df.limit(n).collect()]


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered frame; 0 means all."""
    return df.limit(n) if n else df


def seed_rows(df: DataFrame, feature: str, description: Column, code: Column) -> DataFrame:
    """(``text``): a comment with the description above the code."""
    return df.select(F.concat(F.lit(f"# {feature}: "), description, F.lit("\n"), code).alias("text"))


def partition_by_check(df: DataFrame, check: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, failed) rows; an unknown result fails."""
    ok = F.coalesce(check, F.lit(False))
    return df.where(ok), df.where(~ok)


def check_totals(df: DataFrame, check: Column) -> DataFrame:
    """(``total``, ``kept``, ``failed``): one row, zeros for an empty table; an unknown result fails. The failed rows
    themselves are those of :func:`partition_by_check`."""
    ok = F.coalesce(check, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("failed"))


def share(part: Column, whole: Column) -> Column:
    """A percentage with four decimals, as text; null where there is nothing to share."""
    return F.when(whole != 0, F.format_string("%.4f", 100.0 * part / whole))


def python_json(df: DataFrame, column: str = "json") -> DataFrame:
    """(`column`): every row as Python's ``json.dumps`` writes it (blanks after separators, ASCII escapes, null keys kept)."""
    names = df.columns

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(dict(zip(names, r)), default=str) for r in rows], pa.string())], [column])

    return df.mapInArrow(run, f"`{column}` string")


def pair_json(df: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    """(`id_col`, ``messages``, ``json``): a user's and an assistant's message, and their list as indented JSON text."""
    kind = df.schema[id_col].dataType.simpleString()
    pair = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("user", prompt_col), ("assistant", response_col))))

    def run(batches):
        for b in batches:
            text = pa.array([json.dumps(m, indent=2) for m in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [id_col, "messages", "json"])

    return df.select(F.col(id_col), pair.alias("messages")).mapInArrow(run, f"`{id_col}` {kind}, messages array<struct<role:string,content:string>>, json string")


def write_metrics(spark: SparkSession, metrics: dict[str, object], path: str) -> None:
    """A run's parameters and figures as one JSON row per name, appended."""
    rows = [(str(k), ",".join(map(str, v)) if isinstance(v, (list, tuple)) else None if v is None else str(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("append").json(path)


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is taken while it runs: ``observation.get`` has it after the action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def log_run(directory: str, name: str = "quernstone") -> logging.Logger:
    """A logger that writes ``run.log`` in a run's directory."""
    os.makedirs(directory, exist_ok=True)
    logger = logging.getLogger(f"{name}.{directory}")
    if not logger.handlers:
        handler = logging.FileHandler(os.path.join(directory, "run.log"), encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
    return logger


def image_tag(version: str, known: set[str]) -> str:
    """The slim image of a version, else that of its release candidate."""
    for tag in (f"{version}-slim", f"{version}-rc-slim"):
        if tag in known:
            return tag
    raise ValueError(f"no image for {version}")


def self_verified(df: DataFrame, id_col: str, make_runner: Callable[[], Runner], degenerate: tuple[str, ...] = ("", "pass", "print()")) -> DataFrame:
    """(`id_col`, ``status``, ``reason``) of rows (``code``, ``expected_output``): ``ok``; ``wrong`` where a row's own code does
    not give its output; ``vacuous`` where a degenerate candidate gives it too; ``failed`` where the runner fails."""
    kind = df.schema[id_col].dataType.simpleString()

    def judge(runner: Runner, code: str | None, expected: str | None) -> tuple[str, str | None]:
        if code is None or expected is None:
            return "wrong", "nothing to run"
        try:
            if capped(runner.run(code)).strip() != expected.strip():
                return "wrong", None
            for d in degenerate:
                if capped(runner.run(d)).strip() == expected.strip():
                    return "vacuous", d
        except Exception as e:
            return "failed", f"{type(e).__name__}: {e}"
        return "ok", None

    def run(batches):
        runner = make_runner()
        for b in batches:
            got = [judge(runner, c, o) for c, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (list(zip(*got)) or [[], []]))], [id_col, "status", "reason"])

    return df.select(id_col, "code", "expected_output").mapInArrow(run, f"`{id_col}` {kind}, status string, reason string")
