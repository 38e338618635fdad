"""Operators over records: pair defects, splits, near copies."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import neardup, pairs, splits
from quernstone.llm.crf import Crf
from quernstone.llm.textnorm import file_key, idea_key

# ---- splits


def test_file_and_idea_keys():
    same = ["docs/a.rst", "docs\\A.RST", "./docs/a.rst", " docs/./a.rst ", "docs%2Fa.rst", "docs/../docs/a.rst", "​docs//a.rst", "ｄｏｃｓ/a.rst"]
    assert {file_key(x) for x in same} == {"docs/a.rst"}
    assert all(file_key(x) is None for x in (None, "", " ", "unknown.rst", "./Unknown.RST")) and file_key("x/unknown.rst")
    assert idea_key("Use  X, then “Y”!") == idea_key("use x then y") and idea_key("x y") != idea_key("y x")
    assert all(idea_key(x) is None for x in (None, "", " . ", "TODO", "n/a", "TBD"))


def graph(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for e in edges for v in e}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + ([(k, k + 1) for k in range(100, 140)] if seed == 0 else [(200, k) for k in range(201, 230)])
    df = spark.createDataFrame([(bytes([a]) if a < 256 else None, bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["v"][0]: r["root"][0] for r in splits.components(df).collect()}
    want = {v: r for v, r in graph(256, [e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_choose_is_closest():
    rng = random.Random(2)
    for _ in range(60):
        sizes = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        total = sum(s * n for s, n in sizes.items())
        target = round(total * 0.3)
        taken = splits.choose(sizes, {"a": 0.7, "b": 0.3})
        got = sum(s * t[0] for s, t in taken.items())
        reachable = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*(range(n + 1) for n in sizes.values()))}
        assert abs(got - target) == min(abs(x - target) for x in reachable)
        assert all(t[0] <= sizes[s] for s, t in taken.items())
    big = {s: 1000 for s in range(1, 50)}
    taken = splits.choose(big, {"a": 0.9, "b": 0.1}, most_bits=1000)
    assert abs(sum(s * t[0] for s, t in taken.items()) - round(0.1 * sum(s * n for s, n in big.items()))) <= 1


def test_choose_is_the_same_whatever_is_kept():
    rng = random.Random(4)
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    for _ in range(60):
        sizes = {s: rng.randrange(1, 9) for s in rng.sample([6, 10, 15, 21, 35, 77], 3)}
        assert splits.choose(sizes, shares, most_bits=1) == splits.choose(sizes, shares)


def sft(spark, rows):
    df = spark.createDataFrame(rows, "sft_id bigint, filename string, idea string")
    return df.selectExpr("*", "'x' as split", "'x' as component", "'x' as root", "'x' as name", "'x' as v")


def test_split_together(spark):
    rows = [(k, f"d/f{k % 40}.rst", f"idea {k % 7 if k % 40 < 7 else k}") for k in range(400)]
    rows += [(1000, None, "shared words"), (1001, "", "Shared, words"), (1002, "x/y.rst", "shared WORDS"), (1003, None, None), (1004, "unknown.rst", "TODO"), (1004, "unknown.rst", "TODO")]
    got = splits.split_together(sft(spark, rows), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert sorted(r["sft_id"] for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    component = {r["sft_id"]: r["component"] for r in got}
    assert component[1000] == component[1001] == component[1002] != component[1003] != component[1004]
    counts = {s: sum(r["split"] == s for r in got) for s in ("train", "validation", "test")}
    assert abs(counts["test"] - 41) <= 5 and abs(counts["validation"] - 41) <= 5
    assert splits.split_together(sft(spark, rows[:1]).limit(0)).collect() == []


def test_hot_component_stays_whole(spark):
    rows = [(k, "hot/file.rst" if k % 3 == 0 else f"d/{k}.rst", None) for k in range(300)]
    got = splits.split_together(sft(spark, rows)).collect()
    assert len({r["split"] for r in got if r["sft_id"] % 3 == 0}) == 1


def test_names_together(spark):
    rows = [(1, "a/x.rst", "one two"), (2, "A\\x.rst", None), (3, "b/y.rst", "One, two"), (4, "c/z.rst", "other"), (5, "unknown.rst", "one two"), (6, None, "other"), (7, "d/w.rst", "TBD"), (8, "e/v.rst", "TBD")]
    got = sorted(map(tuple, splits.names_together(sft(spark, rows)).collect()))
    assert got == [("A\\x.rst", "a/x.rst"), ("A\\x.rst", "b/y.rst"), ("a/x.rst", "b/y.rst")]


def test_hot_and_missing_keys_meet_their_rows(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"k{k % 40}") for k in range(3000)], "i int, key string")
    table = spark.createDataFrame([("hot", 1), *((f"k{k}", 2) for k in range(30))], "key string, value int")
    want = sorted(map(tuple, rows.join(table, "key", "left").select("i", "key", "value").collect()), key=str)
    for least in (10, 100_000):
        got = splits.looked_up(rows, "key", table, most=20, least=least)
        assert sorted(map(tuple, got.select("i", "key", "value").collect()), key=str) == want


def test_names_of_a_large_component_meet_in_blocks(spark):
    rows = [(k, f"d/f{k}.rst", "one idea") for k in range(50)]
    whole = splits.names_together(sft(spark, rows)).collect()
    assert len(whole) == 50 * 49 // 2 and sorted(whole) == sorted(splits.names_together(sft(spark, rows), block=7).collect())


# ---- near copies


def brute(rows, threshold):
    sets = {i: {w.lower() for w in re.findall(r"\w+", f"{a} {b}")} for i, a, b in rows if a and b and a.strip() and b.strip()}
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}


def near(spark, rows):
    df = spark.createDataFrame(rows, "sft_id bigint, idea string, code string")
    return df.selectExpr("*", "1 as id", "'x' as words", "2 as rep", "3 as links", "4 as similarity")


@pytest.mark.parametrize(("seed", "threshold", "most"), [(1, 0.75, 256), (2, 0.75, 2), (3, 0.5, 3), (4, 0.9, 1), (5, 1.0, 2)])
def test_near_pairs_against_brute_force(spark, seed, threshold, most):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice((3, 8, 20)))] for _ in range(25)]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rng.shuffle(words)
        rows.append((k, " ".join(words[:2]), " ".join(words[2:])))
    rows += [(200, None, "a"), (201, "a", None), (202, " ", "a"), (203, "", ""), (204, "Same Words", "x"), (205, "same words", "X"), (206, "...", "!!!"), (207, "...", "!!!")]
    got = neardup.near_pairs(near(spark, rows), threshold=threshold, most=most).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, threshold)


def test_crowded_regions_are_divided(spark):
    """Ten times the rows over the same few words: regions would hold ten times the sets, and compare a hundred times the
    pairs; divided, they stay small and the comparisons about in proportion."""
    rng = random.Random(6)
    compared = []
    for n in (600, 6000):
        rows = [(k, "a b", " ".join(rng.sample([f"w{j}" for j in range(90)], 12))) for k in range(n)]
        sets = neardup.written(neardup.word_sets(near(spark, rows).drop("id", "words"), "sft_id", ("idea", "code")).select("id", "words"), "test")
        small, whole, _ = neardup.regions(sets, 0.75, 0.2, 64, 1 << 10)
        sizes = [m.groupBy("key").count().agg(F.max("count"), F.sum(F.expr("count * count / 2"))).first() for m in small + whole]
        assert all((s[0] or 0) <= 64 for s in sizes[: len(small)]) and max(s[0] or 0 for s in sizes) < 256
        compared.append(sum(s[1] or 0 for s in sizes))
    assert len(small) > 1 and compared[1] < 30 * compared[0]
    rows = rows[:300] + [(6000 + k, "a b", rows[k][2].replace("w", "v", 1)) for k in range(60)]
    got = neardup.near_pairs(near(spark, rows), most=16, share=0.2).collect()
    assert {tuple(r) for r in got} == brute(rows, 0.75) and len(got) >= 60


def test_sets_that_share_all_they_have(spark):
    """Small sets alike by the pivots of a divided region alone, and alike sets in a region that no division makes cheaper."""
    rows = [(k, "common words", f"here stand w{k}") for k in range(40)] + [(50, "common words", "here stand")]
    rows += [(100 + k, "template", " ".join(f"t{j}" for j in range(30)) + f" u{k}") for k in range(40)]
    got = neardup.near_pairs(near(spark, rows), most=4, block=3).collect()
    assert {tuple(r) for r in got} == brute(rows, 0.75) and len(got) == 40 + 40 * 39 // 2


def test_near_groups_and_copies(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(k, "same idea", words) for k in range(60)] + [(100, "same idea", words + " more"), (101, "other thing", "entirely different text"), (102, None, "x")]
    got = {r["sft_id"]: (r["group"], r["links"]) for r in neardup.near_groups(near(spark, rows)).collect()}
    assert got[100] == (0, 1) and got[5] == (0, 1) and got[101] == (101, 0) and 102 not in got
    assert neardup.near_pairs(near(spark, rows)).count() == 61 * 60 // 2
    assert neardup.near_pairs(near(spark, rows[:1]).limit(0)).collect() == []
    assert neardup.near_pairs(near(spark, [(1, "a", "b"), (1, "a", "b")])).collect() == []
    with pytest.raises(ValueError):
        neardup.near_pairs(near(spark, rows), threshold=0)


# ---- pair defects


def test_crf_learns_context():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        y = [int(rng.integers(2))]
        for _ in range(4):
            y.append(y[-1] if rng.random() < 0.95 else 1 - y[-1])
        x = np.zeros((5, 3))
        x[:, 0] = 1
        for k, t in enumerate(y):
            if rng.random() < 0.6:
                x[k, 1 + t] = 1
        xs.append(x)
        ys.append(np.array(y))
    crf = Crf(("a", "b"), 3).fit(xs[:150], ys[:150], rounds=200)
    right = sum((a == b).sum() for a, b in zip(crf.decode(xs[150:]), ys[150:])) / 250
    assert right > 0.85
    assert [len(t) for t in crf.decode([np.zeros((0, 3)), xs[0]])] == [0, 5]


PROMPTS = [
    ("How do I use loader{0} with a local cache in Python?", "Call loader{0} first and hand the result to the cache. It keeps the last {0} entries open.\n\n```python\nx = {0}\n```"),
    ("Wie verwende ich lader{0} mit einer Datei in Python?", "Rufe zuerst lader{0} auf und gib das Ergebnis weiter. Die Datei bleibt dabei für alle offen."),
    ("Pourquoi chargeur{0} lève une erreur quand la sortie est vide ?", "Appelez d'abord chargeur{0} et passez le résultat. La sortie est créée une seule fois."),
    ("Почему загрузчик{0} сообщает об ошибке, когда строка пуста?", "Сначала вызовите загрузчик{0} и передайте результат. Строка создаётся один раз."),
]
BAD = [
    ("empty", lambda p, c: None), ("empty", lambda p, c: ""), ("empty", lambda p, c: " \u200b \n"), ("empty", lambda p, c: "..."), ("empty", lambda p, c: "```python\n\n```"),
    ("copied", lambda p, c: p), ("copied", lambda p, c: p.upper()), ("copied", lambda p, c: f"```\n{p}\n```"), ("copied", lambda p, c: f"“{p}”"), ("copied", lambda p, c: p.replace(" ", "\u00a0")),
    ("refusal", lambda p, c: "I'm sorry, but I can't help with that request."), ("refusal", lambda p, c: "As a language model I am not able to answer this."),
    ("truncated", lambda p, c: c.split("```")[0].rstrip()[:-8]), ("truncated", lambda p, c: c.split("```")[0] + "\n\n```python\nx = (1,"),
    (None, lambda p, c: c), (None, lambda p, c: "I can't recommend this form enough. " + c), (None, lambda p, c: f"> {p}\n\n{c}"), (None, lambda p, c: c + "\n\n- `a`\n- `b()`"),
]
MESSAGES = "array<struct<role:string,content:string>>"


def test_pair_defects(spark):
    rows = [(k, [("system", "Teach."), ("user", p.format(k))], [("assistant", c.format(k))]) for k in range(400) for p, c in [PROMPTS[k % 4]]]
    want = {}
    for p, c in PROMPTS:
        for kind, spoil in BAD:
            k = 1000 + len(want)
            prompt, answer = p.format(k), c.format(k)
            made = spoil(prompt, answer)
            want[k] = kind
            rows.append((k, [("user", prompt)], [("assistant", made)]))
    for a, b in ((0, 1), (1, 0), (2, 3), (3, 0)):
        k = 1000 + len(want)
        want[k] = "other_language"
        rows.append((k, [("user", PROMPTS[a][0].format(k))], [("assistant", PROMPTS[b][1].format(k))]))
    k = 1000 + len(want)
    want[k] = None
    rows.append((k, [("user", PROMPTS[0][0].format(k) + " Answer in German.")], [("assistant", PROMPTS[1][1].format(k))]))
    rows += [(5000, None, None), (5001, [], []), (5002, [("user", None)], [("assistant", None), None]), (5003, None, [("assistant", "A long answer stands here. " * 3000)])]
    df = spark.createDataFrame(rows, f"sft_id bigint, prompt {MESSAGES}, completion {MESSAGES}").selectExpr("*", "'x' as defect", "'x' as tags", "1 as p", "2 as c")
    got = {r["sft_id"]: r["defect"] for r in pairs.pair_defects(df).collect()}
    assert got[5000] == got[5001] == got[5002] == "empty" and got[5003] is None
    wrong = {k: (want[k], got[k]) for k in want if got[k] != want[k]}
    assert len(wrong) <= 0.06 * len(want), wrong
    assert sum(got[k] is not None for k in range(400)) <= 4
    assert pairs.pair_defects(df.limit(0)).collect() == []


#: refusals in wording that stands neither in the training material nor is put together from its frames
UNSEEN = (
    "I'll pass on this one.", "Das mache ich nicht.", "Prefiero no contestar.", "这个问题我不想谈。", "That's not something I'm willing to do.", "I have no intention of answering that.", "Not going to happen, sorry.", "I'd like to skip this question.", "Please don't ask me that; I won't tell you.",
    "My instructions prevent me from replying to this.", "Darauf gebe ich Ihnen keine Antwort.", "Hierzu möchte ich mich nicht äußern.", "Bei dieser Aufgabe helfe ich nicht.", "Je n'ai pas l'intention de répondre.", "Je ne traiterai pas cette demande.", "Cette question restera sans réponse de ma part.",
    "No pienso contestar a esa pregunta.", "Esa pregunta no la voy a responder.", "No me siento cómodo ayudando con esto.", "Не собираюсь отвечать на такой вопрос.", "Я вам с этим не помогу.", "Пожалуй, я откажусь.", "その質問には答えません。", "それについてはお話しできません。", "この依頼は引き受けられません。", "我不方便回答这样的问题。", "这样的代码我不会写。", "对此我不能提供任何帮助。",
)
STATED = ("You cannot write to a frozen dataclass; make a copy and change that.", "Call reader{0} twice. It cannot answer before the lock is free.", "Rufe leser{0} zweimal auf. Die Datei kann nicht geändert werden.", "Sorry for the wait. Use reader{0} with the lock and close it at the end.")


def material(n=300):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        p, c = PROMPTS[k % 4]
        sentences = c.split("\n\n")[0].split(". ")
        rng.shuffle(sentences)
        rows.append((p.format(k), (". ".join(x.rstrip(".") for x in sentences) + "." + ("\n\n```python\nx = f(1)\n```" if rng.random() < 0.5 else "")).format(k)))
    return rows


def test_the_tagger_decides_what_no_list_knows():
    rows = material()
    tagger = pairs.train(rows)
    seen = " ".join(str(x) for x in pairs.POLITE + tuple(y for f in pairs_frames() for y in f))
    assert not any(u in seen for u in UNSEEN)

    def judge(prompt, text):
        parts = pairs.clauses(text)
        return pairs.defect(parts, tagger.tag([parts], [prompt])[0])

    found = [judge(rows[k][0], u) for k, u in enumerate(UNSEEN)]
    assert found.count("refusal") >= 0.9 * len(UNSEEN), [u for u, f in zip(UNSEEN, found) if f != "refusal"]
    assert [judge(rows[k][0], x.format(k)) for k, x in enumerate(STATED)].count("refusal") <= 1
    # without the wording scores, short answers and refusals are no longer told apart
    blind = pairs.Tagger(pairs.Wording(), tagger.crf)
    texts = [(u, True) for u in UNSEEN] + [(x.format(k).split(". ")[0] + ".", False) for k, x in enumerate(STATED * 7)]

    def wrong(t):
        parts = [pairs.clauses(x) for x, _ in texts]
        tags = t.tag(parts, [p for p, _ in rows[: len(texts)]])
        return sum((pairs.defect(c, g) == "refusal") != r for c, g, (_, r) in zip(parts, tags, texts))

    assert wrong(tagger) < wrong(blind), (wrong(tagger), wrong(blind))


def pairs_frames():
    from quernstone.llm.refusals import FRAMES

    return [part for language in FRAMES.values() for part in language]
