from quernstone.operators.render import render_markdown, to_markdown

PAGE = """=====
Title
=====

Use :func:`~os.path.join` and ``x = 1`` or `docs <https://a.example/b>`_.

Part
----

.. code-block:: python
   :linenos:

   if a:
       b

Example::

    raw ``text``

* one
* two

.. versionadded:: 3.15
   New.

.. a comment

.. function:: foo(a)

   Body [#n]_.
"""


def test_to_markdown():
    assert to_markdown(PAGE) == (
        "# Title\n\nUse `os.path.join` and `x = 1` or [docs](https://a.example/b).\n\n## Part\n\n```python\nif a:\n    b\n```\n\n"
        "Example:\n\n```\nraw ``text``\n```\n\n- one\n- two\n\n*versionadded 3.15*\nNew.\n\n**function** `foo(a)`\n\nBody [^n].\n"
    )
    assert to_markdown("") == "" and to_markdown("\n \n") == ""


def test_render_frame(spark):
    df = spark.createDataFrame([("a/b.md", "T\n=="), ("c.rst", None), ("c.rst", None)], "path string, text string")
    assert sorted(map(tuple, render_markdown(df).collect()), key=str) == [("a/b.rst", "T\n==\n"), ("c.rst", None), ("c.rst", None)]
