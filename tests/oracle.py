"""Comparison of a query with its DuckDB oracle, as sets of rows with columns in name order."""

import math
import os
from collections import Counter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "cpt", "sft", "verdicts", "source_catalogue", "eval_prompts", "events")


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else tuple(value) if isinstance(value, list) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), Counter(tuple(_plain(v[k]) for k in order) for v in values)


def assert_equal(spark, query, sql):
    df = query(spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = connection().sql(sql)
    assert got == rows(relation.columns, relation.fetchall())
