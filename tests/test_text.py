import re
import textwrap

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as T


def column(spark, values, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in df.select("k", *exprs).orderBy("k").collect()]


SAMPLES = ["", " ", "a", " x　\n", "a\r\nb\rc\n", "a\x0bb\x85c d", "\n\n", "x" * 30, "😀" * 5, None]


def test_strip_and_lines_are_pythons(spark):
    got = column(spark, SAMPLES, T.strip("t"), T.splitlines("t"))
    assert got == [(None, None) if v is None else (v.strip(), v.splitlines()) for v in SAMPLES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x1c\x85  😀", max_size=12), min_size=30, max_size=60))
def test_lines_property(spark, values):
    assert column(spark, values, T.splitlines("t")) == [v.splitlines() for v in values]


def test_truncate_counts_code_points(spark):
    assert column(spark, ["😀😀😀", "ab", "", None], T.truncate("t", 2)) == ["😀😀... [truncated, 1 more characters]", "ab", "", None]


def test_version_mentions(spark):
    cases = {"in 3.15.": True, "3.15.1": True, "13.15": False, "3.150": False, "v3.15": False, "3x15": False, "é3.15": False, "(3.15)": True}
    assert column(spark, list(cases), T.mentions_version("t", "3.15")) == list(cases.values())


def test_fences(spark):
    one = "say\n```python\nx = 1\n```\n"
    two = "```python\nab\n```\nand\n```python\ncd\n```"
    longer = "```python\na\n```\n```python\nlonger\n```"
    assert column(spark, [one, two, longer, "none", "```js\nx\n```", None], T.extract_fence("t")) == ["x = 1", "ab", "longer", None, None, None]


def heuristic(text):
    """Brute force of the documented rule, line by line."""
    prose = lambda x: not any(c in x for c in "=:().\\") and len(x.split()) > 10
    marked = lambda x: x[:1] in tuple("#-*>`")
    lines = text.strip().split("\n")
    a = 0
    while a < len(lines) and (marked(lines[a]) or re.match("I'm|You|Here", lines[a]) or prose(lines[a])):
        a += 1
    b = len(lines)
    while b > a and (marked(lines[b - 1]) or "---" in lines[b - 1] or prose(lines[b - 1])):
        b -= 1
    return "\n".join(lines[a:b]).strip()


def test_heuristic_against_brute_force(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    values = ["# head\nx = 1\n---", f"{long}\nprint(1)\n{long}", "Here it is\n\nx", "- a\n- b", "", "\n\nx = 1\n\n# end", "You\nI'm\ny=2\nz ---\n", "> q\nfoo", "x\n" + long + "\n\n" + long]
    assert column(spark, values, T.extract_heuristic("t")) == [heuristic(v) for v in values]


def test_prompt_context_and_response(spark):
    df = spark.createDataFrame([("ab", "a", None), ("xb", "a", "j")], "c string, p string, j string")
    docs = F.array(F.struct(F.lit("t1").alias("title"), F.lit("d1").alias("document")))
    docs = T.put_document(docs, F.lit("t2"), F.lit("d2"))
    docs = T.put_document(docs, F.lit("t1"), F.lit("new"))
    got = df.select(T.strip_prompt("c", "p"), T.render_context(None, F.col("j"), docs, F.col("p")), T.response("c", "p")).collect()
    body = "--- t1 ---\nnew\n\n--- t2 ---\nd2"
    assert [tuple(r) for r in got] == [("b", f"{body}\n\na", "ab\n\n```python\na\n```"), ("xb", f"j\n\n{body}\n\na", "xb\n\n```python\na\n```")]


def test_small_helpers(spark):
    assert column(spark, ["a/b/c.md", "c.md"], T.base_name("t"), T.with_suffix("t", ".md", ".rst")) == [("c.md", "a/b/c.rst"), ("c.md", "c.rst")]
    code = "a\n\n  b\n \nc"
    assert column(spark, [code], T.indent("t")) == [textwrap.indent(code, "  ")]
    grid = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 8, 24)], "n int").select(*T.worker_grid("n")).collect()
    assert [tuple(r) for r in grid] == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 4), (4, 6)]
    paths = ["a.rst", "a-b.rst", "a/b.rst"]
    df = spark.createDataFrame([(p,) for p in paths], "t string").orderBy(T.path_key("t"))
    assert [r[0] for r in df.collect()] == ["a/b.rst", "a-b.rst", "a.rst"]
