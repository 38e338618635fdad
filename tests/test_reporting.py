import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import reporting as R


def test_preview_order_and_unknown_keys():
    row = {"idea": "i", "filename": "f", "code": "x = 1", "more": 1, "none": 0, "trace": "t", "prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "tool", "content": "a"}]}
    assert R.preview(row) == "filename: f\nidea: i\n```python\nx = 1\n```\ntrace: t\nmore: 1\n[cyan] user: q\n[white] tool: a"


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 1.5), (2, None, 0.0)], "id int, t string, v double")
    assert sorted(r[0] for r in R.python_json(df).collect()) == sorted(json.dumps(r.asDict()) for r in df.collect())
    assert R.limited(df, 0).count() == 2 and R.limited(df, 1).count() == 1
    kept, failed = R.partition_by_check(df, F.col("t") == "é")
    assert kept.count() == failed.count() == 1
    assert R.seed_rows(df, "F", F.lit("d"), F.col("t")).first()[0] == "# F: d\né"
    assert [r[0] for r in df.select(R.share(F.col("v"), F.col("id") * F.col("v"))).collect()] == ["100.0000", None]
    seen, observation = R.observed(df)
    assert seen.count() == 2 and observation.get["n_rows"] == 2
    R.write_metrics(spark, {"rows": 2, "modules": ["a", "b"], "none": None}, str(tmp_path / "m"))
    assert {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(str(tmp_path / "m")).collect()} == {"rows": "2", "modules": "a,b", "none": None}
    assert len(R.previews(df)) == 2


def test_log_and_tag(tmp_path):
    R.log_run(str(tmp_path / "run")).info("hello")
    assert "hello" in (tmp_path / "run/run.log").read_text()
    assert R.image_tag("3.15", {"3.15-rc-slim"}) == "3.15-rc-slim" and R.image_tag("3.14", {"3.14-slim", "3.14-rc-slim"}) == "3.14-slim"
    with pytest.raises(ValueError):
        R.image_tag("3.16", set())


def test_self_verified(spark):
    class Run:
        def run(self, code):
            if code == "boom":
                raise OSError("x")
            return {"good": "1\n", "print()": "\n"}.get(code, "")

    rows = [(1, "good", " 1"), (2, "good", "2"), (3, "print()", ""), (4, "boom", "1"), (5, None, "1")]
    got = R.self_verified(spark.createDataFrame(rows, "id int, code string, expected_output string"), "id", Run)
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "ok", 2: "wrong", 3: "vacuous", 4: "failed", 5: "wrong"}
