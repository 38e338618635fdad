from pyspark.sql import functions as F

from quernstone.operators import doctree as D

PAGE = """Intro
=====

Words.

.. function:: foo(a)

   Does it.

   .. versionadded:: 3.15

More.

Next
----

.. versionchanged:: 3.15.1
   Gone.

.. versionchanged:: 3.15
   Twice.

Last
----

.. code-block:: python

   .. versionadded:: 3.15

Other
=====

.. deprecated:: 3.14
"""


def test_sections_and_ranges(spark):
    df = spark.createDataFrame([("p", PAGE), ("none", None), ("empty", "")], "name string, text string")
    got = {(r["is_entry"], r["start"], r["end"]): r["text"] for r in D.changed_sections(df, "3.15", "name", "text").collect()}
    lines = PAGE.splitlines()
    assert set(got) == {(True, 5, 11), (False, 13, 22)}
    assert got[True, 5, 11] == "\n".join(lines[5:11])
    assert got[False, 13, 22].startswith("Next\n----") and "Twice" in got[False, 13, 22]
    joined = D.change_documents(D.changed_sections(df, "3.15", "name", "text")).collect()
    assert len(joined) == 1 and "\n\n----\n\n" in joined[0]["text"]


def test_synthetic_and_lineless_siblings_are_passed_over(spark):
    rows = [
        ("d", 0, None, 0, "document", None, None, "", []),
        ("d", 1, 0, 0, "section", 2, None, "A", [(0, "document")]),
        ("d", 2, 0, 1, "index", None, None, "", [(0, "document")]),
        ("d", 3, 0, 2, "paragraph", 9, "<rst_epilog>", "", [(0, "document")]),
        ("d", 4, 0, 3, "section", 20, None, "B", [(0, "document")]),
    ]
    got = {r["node_id"]: (r["start"], r["end"]) for r in D.line_ranges(spark.createDataFrame(rows, D.NODE_SCHEMA)).collect()}
    assert got == {1: (0, 18), 4: (18, None)}


def test_note_outside_any_section_is_left_out(spark):
    df = spark.createDataFrame([("p", ".. versionadded:: 3.15\n")], "name string, text string")
    assert D.changed_sections(df, "3.15", "name", "text").collect() == []


def test_clamp(spark):
    df = spark.createDataFrame([(0, 500, 250, False), (0, 501, 250, False), (0, 900, 250, True), (10, 700, 20, False), (0, 800, 790, False)], "s int, e int, at int, entry boolean")
    a, b = D.clamp(F.col("s"), F.col("e"), F.col("at"), F.col("entry"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(0, 500), (150, 350), (0, 900), (10, 120), (690, 800)]
