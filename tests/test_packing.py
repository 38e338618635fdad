import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions.text import tokens
from quernstone.operators import packing as P


def plain_pack(docs, sequence_length, overlap=0.3):
    """The packing rule in plain Python, on lists."""
    size, out, left = sequence_length - 1, [], []
    most = int(overlap * size)
    for key, t in docs:
        if len(t) <= size:
            left.append((key, t))
            continue
        full = len(t) // size
        out += [t[k * size : (k + 1) * size] for k in range(full)]
        rest = len(t) % size
        if rest and size - rest <= most:
            out.append(t[-size:])
        elif rest:
            left.append((key, t[-(rest + most) :]))
    bins = []
    for _, t in sorted(left, key=lambda x: (-len(x[1]), x[0])):
        home = next((b for b in bins if len(b) + 1 + len(t) <= size), None)
        if home is None:
            bins.append(list(t))
        else:
            home += ["<eos>", *t]
    return out, bins


def test_pack_documents_against_plain(spark):
    sizes = [0, 1, 5, 30, 63, 64, 126, 127, 100, 106, 107, 108, 200, 2000, 63, 12, 12, 12]
    docs = [(k, [f"d{k}t{i}" for i in range(n)]) for k, n in enumerate(sizes)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "id int, text string")
    got = P.pack_documents(df, "id", tokens("text"), 64).collect()
    windows, bins = plain_pack(docs, 64)
    assert sorted(map(tuple, (r["tokens"] for r in got if r["part"] == 0))) == sorted(map(tuple, windows))
    assert sorted(map(tuple, (r["tokens"] for r in got if r["part"] == 1))) == sorted(map(tuple, bins))
    assert max(len(r["tokens"]) for r in got) == 63


def test_one_long_document_gives_more_rows(spark):
    df = spark.createDataFrame([(1, " ".join(f"token{k}" for k in range(2000)))], "id int, text string")
    got = P.pack_documents(df, "id", tokens("text"), 64).collect()
    assert len(got) > 1 and max(len(r["tokens"]) for r in got) == 63


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert P.pack_documents(df, "id", tokens("text"), 64).collect() == []


@given(st.lists(st.integers(0, 63), max_size=120), st.integers(0, 2))
def test_first_fit_plan_equals_the_sequential_rule(sizes, gap):
    plan = P.plan_first_fit({s: sizes.count(s) for s in set(sizes)}, 63, gap)
    held, seen = [], {}
    for size in sorted(sizes, reverse=True):
        want = next((k for k, (n, _) in enumerate(held) if n + gap + size <= 63), len(held))
        rank = seen.get(size, 0)
        seen[size] = rank + 1
        first, into, each, before = plan[size]
        k = int((first <= rank).sum()) - 1
        got = into[k] + (rank - first[k]) // each[k], before[k] + (rank - first[k]) % each[k]
        if want == len(held):
            held.append((size, 1))
            assert got == (want, 0)
        else:
            assert got == (want, held[want][1])
            held[want] = (held[want][0] + gap + size, held[want][1] + 1)


def test_first_fit_plan_does_not_grow_with_counts():
    small = P.plan_first_fit({s: 10 for s in range(256)}, 255)
    large = P.plan_first_fit({s: 10**9 for s in range(256)}, 255)
    assert sum(len(x[0]) for x in large.values()) < 20 * max(1, sum(len(x[0]) for x in small.values()))


def test_first_fit_refuses_what_cannot_fit(spark):
    with pytest.raises(ValueError):
        P.first_fit_decreasing(spark.createDataFrame([(1, 64)], "id int, n int"), "id", "n", 63)


@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    out = P.place_best_fit(sizes, 64)
    total = {}
    for size, b in zip(sizes, out):
        total[b] = total.get(b, 0) + min(size, 64)
    assert all(v <= 64 for v in total.values())
    assert len(total) <= max(1, math.ceil(2 * sum(min(s, 64) for s in sizes) / 64)) or not sizes


def test_best_fit_splits(spark):
    df = spark.createDataFrame([(1, 150), (2, 10), (3, 64)], "id int, n int")
    got = P.best_fit_decreasing(df, "id", "n", 64, split=True).groupBy("id").agg(F.sum("n").alias("n"), F.max("part").alias("p")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 150, 2), (2, 10, 0), (3, 64, 0)]
