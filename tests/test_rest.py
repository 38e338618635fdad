import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.operators import config, datasets, generation, quality
from quernstone.sources import files
from quernstone.streaming import logs


def test_jsonl_files_order_blank_lines_and_faults(spark, tmp_path):
    a, b, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl", tmp_path / "bad.jsonl"
    a.write_text('\n{"text": "one"}\n   \n{"text": "two"}\n\n')
    b.write_text('{"text": "three"}\n')
    bad.write_text('{"text": \n')
    got = files.read_jsonl(spark, [str(a), str(b)], "text string").orderBy("path_ordinal").collect()
    assert [r["text"] for r in got] == ["one", "two", "three"]
    assert [r["text"] for r in files.read_jsonl(spark, str(a), "text string").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_jsonl(spark, str(bad), "text string").collect()


def test_jsonl_sink_policies(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, text string")
    path = str(tmp_path / "out.jsonl")
    with pytest.raises(ValueError):
        files.write_jsonl(df, str(tmp_path / "out.json"))
    files.write_jsonl(df, path, order=["id"])
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_jsonl(df, path)
    files.write_jsonl(df, path, "append")
    assert files.read_jsonl(spark, path, "id int, text string").count() == 4
    files.write_jsonl(df, path, "overwrite")
    assert files.read_jsonl(spark, path, "id int, text string").count() == 2


def test_document_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/b.rst", "a-b.rst", "a.rst", "skip.txt"):
        (tmp_path / name).write_text(name + "\nx")
    got = files.ordered_documents(files.scan_documents(spark, str(tmp_path))).collect()
    assert [r["path"] for r in got] == ["a/b.rst", "a-b.rst", "a.rst"] and got[0]["text"] == "a/b.rst\nx"
    assert files.scan_documents(spark, str(tmp_path / "skip.txt")).collect()[0]["filename"] == "skip.txt"
    with pytest.raises(ValueError):
        files.scan_documents(spark, str(tmp_path), "*.md")


def test_document_sink(spark, tmp_path):
    files.write_documents(spark.createDataFrame([("x/y", "body"), ("n", None)], "document string, text string"), str(tmp_path))
    assert (tmp_path / "x/y.rst").read_text() == "body" and not (tmp_path / "n.rst").exists()


def test_catalogue(spark):
    df = files.catalogue(spark, {"3.15": {"docs": {"a": "u"}}, "3.14": {"docs": {"b": "v"}}})
    assert files.of_version(df, "3.15").collect()[0]["destination"] == "input/docs/a.rst"
    with pytest.raises(ValueError, match="3.14, 3.15"):
        files.of_version(df, "3.1")


def test_exact_split_counts(spark):
    for n in (0, 1, 30, 1000, 1537):
        got = datasets.exact_split(spark.range(n), "id").where("split = 'eval'").count()
        assert got == -(-n // 10)


def test_generation_retries_and_quarantine(spark):
    class Script:
        def __init__(self):
            self.calls = 0

        def complete(self, messages, effort="medium"):
            self.calls += 1
            last = messages[-1]["content"]
            if "Judge whether" in last:
                return json.dumps({"judgement": "no", "passed": "accept" in last})
            if messages[0]["content"].startswith("Judge"):
                return json.dumps({"judgement": "poor", "passed": "poor" not in last})
            if messages[0]["content"].startswith("Write the exchange"):
                return json.dumps({"prompt": "q poor" if "poor" in last else "q", "explanation": "e"})
            if "broken" in last and "no match for the schema" not in last:
                return "{"
            tag = next(t for t in ("good", "accept", "never", "poor", "broken", "boom") if any(t in m["content"] for m in messages))
            return json.dumps({"code": tag, "trace": "t", "expected_output": "out" if tag in ("good", "poor", "broken") else "else", "extra": 1})

    class Run:
        def run(self, code):
            if code == "boom":
                raise OSError("no runner")
            return " out\n"

    ideas = spark.createDataFrame([("f", k, t) for k, t in enumerate(("good", "accept", "never", "poor", "broken", "boom"))], "filename string, idea_idx int, idea string").coalesce(1)
    made = {r["idea"]: r for r in generation.rows_of(ideas, Script, Run).collect()}
    assert {k: r["status"] for k, r in made.items()} == {"good": "ok", "accept": "ok", "never": "rejected", "poor": "rejected", "broken": "ok", "boom": "failed"}
    assert made["accept"]["expected_output"] == " out\n" and made["good"]["expected_output"] == "out"
    assert made["boom"]["reason"] == "OSError: no runner" and "3 attempts" in made["never"]["reason"]
    frame = generation.rows_of(ideas, Script, Run)
    assert generation.accepted(frame, "3.15").count() == 3 and generation.quarantined(frame).count() == 3


def test_schema_is_strict():
    assert generation.conforms({"judgement": "x", "passed": True, "more": 1}, generation.VERDICT)
    assert not generation.conforms({"judgement": "x", "passed": "true"}, generation.VERDICT)
    assert not generation.conforms({"ideas": ["a"] * 51}, generation.IDEAS)
    with pytest.raises(ValueError):
        generation.get_model("unknown")


CHUNKS = [("out", 0, "ab"), ("out", 1, "c\nxx\ry\n"), ("err", 0, "z\r\n\x1b[0mq\nlast"), ("err", 1, None)]


def test_logs_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(CHUNKS, "stream string, seq int, chunk string")
    want = [("out", 0, "abc"), ("out", 1, "y")]
    assert sorted(map(tuple, logs.log_batch(df).collect())) == want
    for k, (s, n, c) in enumerate(CHUNKS):
        at = tmp_path / "in" / f"{k}.json"
        at.parent.mkdir(exist_ok=True)
        at.write_text(json.dumps({"stream": s, "seq": n, "chunk": c}) + "\n")
        os.utime(at, (k + 1, k + 1))
    source = spark.readStream.schema("stream string, seq int, chunk string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    logs.append_stream(logs.log_stream(source), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema("stream string, line_no int, line string").json(str(tmp_path / "out"))
    assert sorted((r["stream"], r["line_no"], r["line"]) for r in got.collect()) == want


def test_log_of_one_hot_stream_against_plain(spark):
    import random

    rng = random.Random(6)
    rows = []
    for stream, n in (("hot", 400), ("a", 3), ("b", 40)):
        rows += [(stream, k, rng.choice([None, "", "x", "ab\n", "\n", "c\rd", "q\x1b[0m\n", " \n", "one\ntwo\nthr"])) for k in range(n)]
    want = []
    for stream in ("hot", "a", "b"):
        lines, _ = logs.assemble("", "".join(c or "" for s, _, c in rows if s == stream))
        want += [(stream, k, x) for k, x in enumerate(lines)]
    rng.shuffle(rows)
    got = logs.log_batch(spark.createDataFrame(rows, "stream string, seq int, chunk string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_unseen_documents(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, text string")
    seen = docs.where("name = 'a'").select("name", F.sha2("text", 256).alias("hash"))
    assert [r["name"] for r in logs.unseen(docs, seen, "name", "text").collect()] == ["b"]


def test_config():
    made = config.compose({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}, {"d": [1]})
    assert made == {"a": {"b": 1, "c": 3}, "d": [1]}
    assert config.override(made, "a.b=7", "x.y=text") == {"a": {"b": 7, "c": 3}, "d": [1], "x": {"y": "text"}}
    assert config.resolve({"r": 8, "alpha": ["mul", "$r", 2], "n": ["basename", "org/model"], "m": ["max", "$r", 9]}) == {"r": 8, "alpha": 16, "n": "model", "m": 9}
    ok = config.validated(config.Experiment, {"name": "n", "model": "m", "sources": {"cpt": "a.jsonl"}, "cpt": {"seq_len": 64}})
    assert config.stages(ok) == ["cpt"]
    for bad in ({"name": "n", "model": "m", "more": 1}, {"name": "n"}, {"name": 1, "model": "m"}, {"name": "n", "model": "m", "cpt": {"seq_len": "x"}}):
        with pytest.raises(ValueError):
            config.validated(config.Experiment, bad)
    with pytest.raises(NotImplementedError):
        config.stages(config.validated(config.Experiment, {"name": "n", "model": "m", "sources": {"rl": "r.jsonl"}}))
    assert config.run_directory("sft", datetime.datetime(2026, 1, 2, 3, 4)) == "20260102-0304-sft"


def test_quality_gates(spark):
    docs = spark.createDataFrame([(1, "x the item here"), (2, None), (3, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "the item"), (8, None), (9, "")], "item_id bigint, prompt string")
    hits = quality.contained_items(docs, "doc_id", "text", items, "item_id", "prompt")
    assert [tuple(r) for r in hits.collect()] == [(1, 7)]
    with pytest.raises(ValueError):
        quality.stop_if_contaminated(hits)
    code = spark.createDataFrame([(1, "import os, sys\nfrom json.decoder import x\nimport numpy as np"), (2, "f'{a:{b}}' % 1"), (3, "def ("), (4, "'{}'.format(1)\nt'{x}'")], "id int, code string")
    assert [r["module"] for r in quality.foreign_imports(code, "id", F.col("code")).collect()] == ["numpy"]
    got = {r["id"]: (r["parses"], r["old_forms"]) for r in quality.old_form_canary(code.where("id < 4"), "id", "code").collect()}
    assert got[3] == (False, []) and "fstring" in got[2][1]


def test_every_imported_name_is_seen(spark, tmp_path):
    from quernstone.plans import queries

    codes = [
        "import os, requests",
        "import json; import numpy",
        "import math\nfrom typing import Any",
        '"""\nimport fake\n"""\nfrom . import near\nif x: import a.b as c, d\nfrom e.f import (g,\n h)',
        't = t"{x}"\nimport os, \\\n  requests as r  # import no\nx = """\nimport fake\n"""; import numpy.linalg\nfrom .near import y\nlazy import w\nfrom math import(pi)',
        "say = t'import fake'",
        None,
    ]
    spark.createDataFrame(list(enumerate(codes)), "sft_id bigint, code string").write.parquet(str(tmp_path / "sft.parquet"))
    got = sorted((r["sft_id"], r["module"]) for r in queries.queries()["foreign_imports"](spark, str(tmp_path)).collect())
    assert got == [(0, "requests"), (1, "numpy"), (3, "a"), (3, "d"), (3, "e"), (4, "numpy"), (4, "requests"), (4, "w")]


def test_template_consumers_are_on_target(spark, tmp_path):
    from quernstone.plans import queries

    codes = {
        "from string.templatelib import Interpolation as I\nx = 1": True,
        "from string import templatelib": True,
        "def html(t: Template) -> str:\n    return ''.join(t.strings)": True,
        "match part:\n    case Interpolation(value):\n        pass": True,
        "say = t'{x}'": True,
        "from string import Template\nTemplate('$x').substitute(x=1)": False,
        "import string\nstring.Template('$x')": False,
        "from jinja2 import (Environment,\n  Template)\nTemplate('x')": False,
        "class Template:\n    pass\nTemplate()": False,
        "# Template of string.templatelib\nx = 'Template'": False,
        "TemplateView()": False,
    }
    spark.createDataFrame(list(enumerate(codes)), "sft_id bigint, code string").write.parquet(str(tmp_path / "sft.parquet"))
    got = {r["sft_id"]: r["on_target"] for r in queries.queries()["on_target"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(codes))] == list(codes.values())


def test_prepack_turns_trainer_packing_off(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "i j")], "id int, text string")
    for packing, prepack, want in ((True, True, False), (True, False, True), (False, True, False)):
        made = config.validated(config.Experiment, {"name": "n", "model": "m", "cpt": {"seq_len": 5, "packing": packing, "prepack": prepack}})
        rows, still = config.prepacked(made, "cpt", docs, "id", F.split("text", " "))
        assert still is want
        assert ("ordinal" in rows.columns) is (packing and prepack)
        assert rows.count() >= 2 and (rows is docs or max(len(r["tokens"]) for r in rows.collect()) < 5)


def test_written_tables_and_lineage(spark):
    from quernstone import session

    df = session.written(spark.range(5).withColumn("s", F.lit("x")), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    cut = session.cut_lineage(spark.range(3))
    assert cut.count() == 3
    few = session.spread(spark.range(10).coalesce(1))
    assert few.rdd.getNumPartitions() >= 4 and few.count() == 10
    assert session.drop_written(spark) >= 1 and session.drop_written(spark) == 0
