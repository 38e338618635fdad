"""Order of notes, exact best fit, near copies, both axes of contamination, evaluation, configuration layers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quernstone.operators import config, datasets, doctree, evaluation, generation, packing, quality


def test_sections_stand_in_the_order_of_their_first_notes(spark):
    text = "Title\n=====\n\n.. class:: Big\n\n   .. method:: go()\n\n      Goes.\n\n      .. versionchanged:: 3.15\n         Faster.\n\n   .. versionadded:: 3.15\n      New.\n"
    docs = spark.createDataFrame([("d", text)], "name string, text string")
    sections = doctree.changed_sections(docs, "3.15", "name", "text")
    noted = [r["section_id"] for r in sections.orderBy("note_id").collect()]
    assert len(noted) == 2 and noted[0] > noted[1]  # the method's note comes before its class's
    got = doctree.change_documents(sections).first()["text"].split("\n\n----\n\n")
    assert got[0].lstrip().startswith(".. method::") and got[1].startswith(".. class::")


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice((0, 1, 7, 33, 50, 51, 99, 100, 170, rng.randrange(200))) for _ in range(900)]
    rows = [(k % 400, n) for k, n in enumerate(sizes)] + [(1000, None)]
    got = packing.best_fit_decreasing(spark.createDataFrame(rows, "id int, n int"), "id", "n", 100, split=True).collect()
    parts = sorted(((min(100, max(0, (n or 0) - p * 100)), i, p) for i, n in rows for p in range(max(1, -(-(n or 0) // 100)))), key=lambda x: (-x[0], x[1], x[2]))
    want = packing.place_best_fit([n for n, _, _ in parts], 100)
    assert sorted((r["n"], r["id"], r["part"], r["bin"]) for r in got) == sorted((*x, b) for x, b in zip(parts, want))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(40)) for _ in range(6)]
    texts = []
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(40)] = "zz"
        texts.append((k, " ".join(words)))
    texts += [(100, None), (101, " "), (102, "two words"), (103, "Two  words")]
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumn("s", F.lit("clash"))

    def runs(t):
        w = t.lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: runs(t or "") for i, t in texts if runs(t or "")}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for most in (2000, 3):
        classes, links = quality.near_duplicates(df, "doc_id", F.col("text"), most=most)
        assert {(r["id"], r["rep"]) for r in classes.collect()} == set(rep.items())
        assert {(r["a"], r["b"]) for r in links.collect()} == want
    classes, links = quality.near_duplicates(df.limit(0), "doc_id", F.col("text"))
    assert classes.collect() == links.collect() == []


def test_contamination_on_either_axis(spark):
    rows = spark.createDataFrame([(1, "write a loop over all the words of it", "x = 1\ny = f(x)  # so"), (2, "other idea altogether here now", "for a in b:\n    print(a, end=',')"), (3, None, None)], "id int, idea string, code string")
    items = spark.createDataFrame([(7, "Write a loop over all the words of it!", "for a in b:   print(a, end=',')\n# done")], "item int, prompt string, answer string")
    got = {r["id"]: (r["text_similarity"], r["code_similarity"]) for r in quality.dual_axis(rows, "id", F.col("idea"), F.col("code"), items, "item", F.col("prompt"), F.col("answer")).collect()}
    assert got == {1: (1.0, None), 2: (None, 1.0)}


def test_blank_provenance_is_any_white_space(spark):
    df = spark.createDataFrame([("\t",), (" ",), ("\u00a0",), (None,), ("x",)], "filename string")
    assert quality.missing_provenance(df, ["filename"]).first()["missing"] == 4


def test_shuffle_and_text_column(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    one, two = ({r["k"]: r["place"] for r in datasets.shuffled(df, "k", s).collect()} for s in (1, 2))
    assert sorted(one.values()) == list(range(1, 201)) and one != two
    pair = spark.sql("select array(named_struct('role','user','content','a')) as prompt, array(named_struct('role','assistant','content','b')) as completion")
    assert pair.select(datasets.text_column(pair)).first()[0] == "a\nb"


def test_exact_split_with_null_ids(spark):
    df = spark.createDataFrame([(k if k % 3 else None,) for k in range(30)], "id int")
    assert datasets.exact_split(df, "id").count() == 30


def test_evaluation_loop(spark):
    class Replies:
        def complete(self, messages, effort="medium"):
            p = messages[0]["content"]
            return f"{p}\n```python\nx = t'{{1}}'\n```" if "one" in p else f"{p} no code"

    items = spark.createDataFrame([(1, "one", "x"), (2, "two", "x"), (3, None, "x")], "item int, prompt string, label string")
    result, rated = evaluation.evaluate(items, "item", "prompt", "label", Replies, quality.has_template_string)
    assert {r["item"]: r["passed"] for r in result.collect()} == {1: True, 2: False}
    assert rated.select("n", "n_passed").first() == (2, 1)


def test_prompts_carry_the_document(spark):
    seen = spark.sparkContext.accumulator(0)

    class Reader(generation.HashModel):
        def complete(self, messages, effort="medium"):
            seen.add("WHOLE TEXT" in messages[-1]["content"])
            return super().complete(messages, effort)

    ideas = spark.createDataFrame([("a", 0, "do it")], "filename string, idea_idx int, idea string")
    docs = spark.createDataFrame([("a", "WHOLE TEXT")], "filename string, text string")
    generation.rows_of(ideas, Reader, generation.EchoRunner, docs).collect()
    assert seen.value >= 1


def test_layers_and_dump(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "b": 1}))
    (tmp_path / "run.json").write_text(json.dumps({"defaults": ["base"], "a": {"y": 3}}))
    (tmp_path / "under.json").write_text(json.dumps({"defaults": ["_self_", "base"], "b": 5}))
    assert config.read_layers(str(tmp_path), "run") == {"a": {"x": 1, "y": 3}, "b": 1}
    assert config.read_layers(str(tmp_path), "under")["b"] == 1
    assert json.loads(config.dumped(config.Stage(seq_len=8)))["seq_len"] == 8
    (tmp_path / "loop.json").write_text(json.dumps({"defaults": ["loop"]}))
    with pytest.raises(ValueError, match="circle"):
        config.read_layers(str(tmp_path), "loop")
    assert re.match(r"\{\n", config.dumped({"b": 1}))


def test_limited_runner_and_tee(tmp_path, capsys):
    import sys
    import time

    from quernstone.streaming.logs import teed

    class Slow:
        def run(self, code):
            time.sleep(float(code))
            return "x" * 20

    assert generation.Limited(Slow(), 0.2).run("2") == "[did not terminate within 0.2 seconds]"
    assert generation.Limited(Slow(), 5, limit=4).run("0") == "xxxx... [truncated, 16 more characters]"
    with pytest.raises(ValueError):
        generation.Limited(Slow(), 5).run("no number")
    at = tmp_path / "log"
    with teed(str(at)):
        print("10%\r50%\rdone")
        print("\x1b[1mred\x1b[0m")
        print("bad", file=sys.stderr)
        print("no end", end="")
    print("outside")
    assert at.read_text() == "done\nbad\n" and "no end" in capsys.readouterr().out


def test_small_sources(spark, tmp_path):
    from quernstone.sources import files

    with pytest.raises(ValueError):
        files.require_file(str(tmp_path))
    (tmp_path / "conf.py").write_text("")
    files.require_file(str(tmp_path))
    rows = files.example_rows(spark, [("a", "x"), ("b", "y")])
    assert files.with_patterns(rows, ["p", "q", "r"]).count() == 6 and files.with_patterns(rows, []).count() == 0
    with pytest.raises(ValueError):
        files.with_patterns(rows, ["p"] * 3, most=2)


def test_order_of_steps():
    e = config.validated(config.Experiment, {"name": "n", "model": "m", "sources": {"cpt": "a", "sft": ["b"]}})
    assert config.steps(e) == ["eval before", "cpt", "eval after cpt", "sft", "eval after sft"] and config.steps(e, False) == ["cpt", "sft"]
