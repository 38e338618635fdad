"""Model-made rows: pluggable model and runner, schema retries, verification, judging, quarantine."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.datasets import sft_rows

MAX_OUTPUT = 12_000


class Model(Protocol):
    def complete(self, messages: list[dict[str, str]], effort: str = "medium") -> str: ...


class Runner(Protocol):
    """Runs a snippet in isolation and returns its merged output; the exit status does not matter."""

    def run(self, code: str) -> str: ...


def conforms(value: Any, schema: dict) -> bool:
    """JSON-schema check of the parts used here: type, required, properties, items, maxItems; extra keys pass, and no type
    is coerced into another."""
    kind = schema.get("type")
    if kind == "object":
        return isinstance(value, dict) and all(k in value for k in schema.get("required", ())) and all(k not in value or conforms(value[k], s) for k, s in schema.get("properties", {}).items())
    if kind == "array":
        return isinstance(value, list) and len(value) <= schema.get("maxItems", len(value)) and all(conforms(v, schema.get("items", {})) for v in value)
    if kind == "string":
        return isinstance(value, str)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return True


def record(**properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties)}


TEXT, FLAG = {"type": "string"}, {"type": "boolean"}
IDEAS = record(ideas={"type": "array", "items": TEXT, "maxItems": 50})
CODE_BLOCK = record(code=TEXT, trace=TEXT, expected_output=TEXT)
VERDICT = record(judgement=TEXT, passed=FLAG)
CONVERSATION = record(prompt=TEXT, explanation=TEXT)


def ask(model: Model, messages: list[dict[str, str]], schema: dict, attempts: int = 3) -> dict:
    """A reply that fits the schema; each that does not goes back with a correction, up to ``attempts`` in all."""
    messages = list(messages)
    for _ in range(attempts):
        content = model.complete(messages)
        try:
            value = json.loads(content)
        except ValueError as e:
            fault = str(e)
        else:
            if conforms(value, schema):
                return value
            fault = "the value does not fit the schema"
        messages += [{"role": "assistant", "content": content}, {"role": "user", "content": f"The reply was no match for the schema ({fault}). Send a corrected one."}]
    raise ValueError(f"no reply fits the schema after {attempts} attempts")


def capped(text: str, limit: int = MAX_OUTPUT) -> str:
    return text if len(text) <= limit else f"{text[:limit]}... [truncated, {len(text) - limit} more characters]"


def verified_code(model: Model, runner: Runner, messages: list[dict[str, str]], attempts: int = 3) -> tuple[dict, int]:
    """A code block whose run gives the predicted output, or whose other output a judge accepts (which it then carries),
    and the attempts it took. The request for a retry repeats the block and the judgement, never the actual output."""
    for attempt in range(1, attempts + 1):
        block = ask(model, messages, CODE_BLOCK)
        actual = capped(runner.run(block["code"]))
        if actual.strip() == block["expected_output"].strip():
            return block, attempt
        shown = json.dumps({**block, "actual_output": actual})
        verdict = ask(model, [*messages[:1], {"role": "user", "content": f"Judge whether the output fits the idea: {shown}"}], VERDICT)
        if verdict["passed"]:
            return {**block, "expected_output": actual}, attempt
        retry = "\n\n".join((messages[-1]["content"], "Earlier attempt:", block["code"], block["trace"], block["expected_output"], verdict["judgement"], "Its output was another. Correct it."))
        messages = [*messages[:-1], {"role": "user", "content": retry}]
    raise ValueError(f"no verified code after {attempts} attempts")


def _system(text: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": text}]


def ideas_of(docs: DataFrame, make_model: Callable[[], Model], name_col: str = "filename", text_col: str = "text") -> DataFrame:
    """(``filename``, ``idea_idx``, ``idea``): 0 to 50 ideas per document. A reply that never fits fails the job."""

    def run(batches):
        model = make_model()
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    got = ask(model, [*_system("Propose ideas for examples."), {"role": "user", "content": f"--- {name} ---\n{text}"}], IDEAS)
                    rows += [(name, k, idea) for k, idea in enumerate(got["ideas"])]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["filename", "idea_idx", "idea"])

    return docs.select(F.col(name_col), F.col(text_col)).mapInArrow(run, "filename string, idea_idx int, idea string")


_MADE = "filename string, idea_idx int, idea string, code string, trace string, expected_output string, prompt string, explanation string, attempts int, status string, reason string"


def rows_of(ideas: DataFrame, make_model: Callable[[], Model], make_runner: Callable[[], Runner], docs: DataFrame | None = None, name_col: str = "filename", text_col: str = "text") -> DataFrame:
    """One row per idea with ``status`` ``ok``, ``rejected`` (the retries or the judge) or ``failed`` (any other error).

    With ``docs`` every prompt carries the whole document that the idea comes from, joined by name; an idea whose document
    is not there goes without. Model and runner are made once per task. Results depend on the inputs only, so a repeated task gives the same rows;
    write them before two consumers read them, or the model is asked twice.
    """

    def run(batches):
        model, runner = make_model(), make_runner()
        for b in batches:
            rows = []
            for name, k, idea, text in zip(*(c.to_pylist() for c in b.columns)):
                about = f"--- {name} ---\n{text}\n\n{idea}" if text else f"{name}: {idea}"
                base, status, reason = {}, "ok", None
                try:
                    block, attempts = verified_code(model, runner, [*_system("Write the example."), {"role": "user", "content": about}])
                    talk = ask(model, [*_system("Write the exchange."), {"role": "user", "content": f"{about}\n\n{json.dumps(block)}"}], CONVERSATION)
                    base = {**block, **talk, "attempts": attempts}
                    verdict = ask(model, [*_system("Judge the exchange."), {"role": "user", "content": f"{about}\n\n{json.dumps({**block, **talk})}"}], VERDICT)
                    if not verdict["passed"]:
                        status, reason = "rejected", verdict["judgement"]
                except ValueError as e:
                    status, reason = "rejected", str(e)
                except Exception as e:
                    status, reason = "failed", f"{type(e).__name__}: {e}"
                rows.append({"filename": name, "idea_idx": k, "idea": idea, "status": status, "reason": reason, **base})
            schema = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in _MADE.split(", ")])
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)

    wanted = ideas.select("filename", "idea_idx", "idea")
    if docs is None:
        return wanted.withColumn("text", F.lit(None).cast("string")).mapInArrow(run, _MADE)
    texts = docs.groupBy(F.col(name_col).alias("filename")).agg(F.min(text_col).alias("text"))
    return wanted.join(texts, "filename", "left").select("filename", "idea_idx", "idea", "text").mapInArrow(run, _MADE)


def accepted(made: DataFrame, python_version: str) -> DataFrame:
    """The dataset rows of what was accepted."""
    return sft_rows(made.where("status = 'ok'").withColumn("python_version", F.lit(python_version)))


def quarantined(made: DataFrame) -> DataFrame:
    return made.where("status <> 'ok'").select("filename", "idea_idx", "idea", "status", "reason")


class HashModel:
    """An offline model: replies are a pure function of the messages' hash, so a task that runs again repeats itself."""

    def complete(self, messages: list[dict[str, str]], effort: str = "medium") -> str:
        h = int.from_bytes(hashlib.md5(json.dumps(messages).encode()).digest()[:4], "little")
        task = messages[0]["content"]
        if "ideas" in task:
            return json.dumps({"ideas": [f"idea {h % 1000}-{k}" for k in range(h % 4)]})
        if "Judge" in task or "Judge" in messages[-1]["content"]:
            return json.dumps({"judgement": f"verdict {h % 7}", "passed": h % 5 != 0})
        if "exchange" in task:
            return json.dumps({"prompt": f"question {h % 1000}", "explanation": f"answer {h % 1000}"})
        return json.dumps({"code": f"print({h % 100})", "trace": "so it is", "expected_output": f"{h % 100 + (h % 3 == 0)}"})


class Limited:
    """A runner whose runs end: one that takes longer than ``seconds`` gives the note below in place of its output, and long
    output is cut. The run itself goes on in a thread of its own; an isolating runner must end it."""

    # The note of a run that did not end.
    NOTE = "[did not terminate within {} seconds]"

    def __init__(self, runner: Runner, seconds: float = 10, limit: int = MAX_OUTPUT):
        self.runner, self.seconds, self.limit = runner, seconds, limit

    def run(self, code: str) -> str:
        got: list = []

        def call():
            try:
                got.append((self.runner.run(code), None))
            except Exception as e:
                got.append((None, e))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(self.seconds)
        if not got:
            return self.NOTE.format(f"{self.seconds:g}")
        if got[0][1]:
            raise got[0][1]
        return capped(got[0][0], self.limit)


class EchoRunner:
    """An offline runner: the output of ``print(n)`` is n; nothing is executed."""

    def run(self, code: str) -> str:
        return code.removeprefix("print(").removesuffix(")") + "\n"


def answers(questions: list[str], stages: list[str], make_model: Callable[[], Model], spark) -> DataFrame:
    """(``stage``, ``question``, ``answer``): fixed questions asked at every stage."""
    df = spark.createDataFrame([(s, q) for s in stages for q in questions], "stage string, question string")

    def run(batches):
        model = make_model()
        for b in batches:
            got = [model.complete([{"role": "user", "content": f"{s}: {q}"}]) for s, q in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], ["stage", "question", "answer"])

    return df.mapInArrow(run, "stage string, question string, answer string")


_BACKENDS: dict[str, Callable[[str], Model]] = {"hash": lambda name: HashModel()}


def register(provider: str, make: Callable[[str], Model]) -> None:
    _BACKENDS[provider] = make


def get_model(provider: str, name: str = "") -> Model:
    if provider not in _BACKENDS:
        raise ValueError(f"unknown provider {provider}")
    return _BACKENDS[provider](name)
