"""Operators that work on one text at a time: markup, segmentation, sentences, encoding, token budget, leaks, packing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe_automaton, budget, encode, leak, markup, pack, segment, sentences
from quernstone.llm.fm_index import FMIndex
from quernstone.llm.language import language
from quernstone.llm.textnorm import match_words

LONG = "Some words here. " * 4000
CASES = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "same text"), (6, "same text"), (7, "a\x00b​c 😀 é"), (7, "a\x00b​c 😀 é")]


def frame(spark, rows=CASES, id_col="cpt_id"):
    """Rows with extra columns whose names clash with those of results."""
    df = spark.createDataFrame(rows, f"{id_col} bigint, text string")
    return df.selectExpr("*", "'x' as ids", "'x' as markup", "1 as piece", "'x' as cut", "2 as container", "3 as n_tokens", "4 as part", "'y' as sentence", "'z' as root")


# ---- markup


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("A <b>bold</b> word &mdash; here", ["html"]),
        ("x<y and y>z, a < b and c > d, R&D, Q&A, dict[str, int] | None, {name!r}, f(x, *args, **kwargs), \\d+", []),
        ("[[1, 2], [3, 4]] costs $5 now and $9 later; 2 * 3 * 4", []),
        ("# Title\n\ntext", ["markdown"]),
        ("Title\n=====\n\ntext", ["markdown"]),
        ("an *em* and **strong** and ~~gone~~ and `code`", ["markdown"]),
        ("[text](https://a.example/b) ![i](img/x.png) note[^1]\n\n[^1]: so", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("- [ ] open\n- [x] done", ["markdown"]),
        ("> quoted", ["markdown"]),
        (">>> prompt of Python", []),
        ("- plain\n- items\n1. one\nhttps://bare.example/x", []),
        ("== Head ==\n[[Link|text]] '''bold''' {{tpl|x}} __TOC__", ["wiki"]),
        ('{| class="wikitable"\n! H\n|-\n| a || b\n|}', ["wiki"]),
        ("\\section{A} \\textbf{b} \\cite{c} $x_i = 1$", ["latex"]),
        ("\\begin{equation}\nE = mc^2\n\\end{equation}", ["latex"]),
        ("```python\n# not a heading\nx = '<b>' + \"'''x''' {{y}}\" + r'\\section{x}'\n```", ["markdown"]),
        ("<pre>\n# no **md** \\section{x}\n</pre>", ["html"]),
        ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", ["latex"]),
        ("~~~\nunclosed <b>", ["markdown"]),
        ("__init__ and __name__ stay", []),
    ],
)
def test_markup_families(text, families):
    assert markup.families(markup.events(text)) == families


def test_clean_keeps_structure():
    text = "<h1>Head</h1>\n<ul>\n<li>one &amp; two</li>\n</ul>\n\n```python\nif a < b:\n    **x**\n```\n\nThe $a^2$ and \\textbf{bold}.\n\n<p>Last *word*.</p>"
    got, families, _, kept = markup.clean(text)
    assert families == ["html", "markdown", "latex"]
    assert got.splitlines()[0] == "Head" and "- one & two" in got and "if a < b:\n    **x**" in got
    assert "a^2 and bold." in got and got.endswith("Last word.") and "<" not in got.replace("a < b", "")


def test_clean_drops_page_chrome():
    nav = '<div><a href="/a">Home</a> | <a href="/b">Docs</a> | <a href="/c">About</a></div>'
    body = "\n".join(f"<p>Sentence number {k} says something of substance about the topic at hand.</p>" for k in range(12))
    got, _, dropped, _ = markup.clean(f"{nav}\n{body}\n{nav}")
    assert dropped == 2 and "Home" not in got and "number 11" in got


NAV = '<ul>\n<li><a href="/a">Home of the project</a></li>\n<li><a href="/b">All documents</a></li>\n</ul>'


def test_the_threshold_selects_content_regions(monkeypatch):
    body = "\n".join(f"<p>Sentence number {k} says <b>something</b> of substance about the topic at hand.</p>" for k in range(12))
    text = f"{NAV}\n{body}\n<p>See <a href='/c'>this page</a>.</p>\n{body}"
    got = markup.clean(text)
    assert "Home of" not in got.text and "See this page." in got.text and got.text.count("number") == 24
    monkeypatch.setattr(markup, "threshold", lambda values: -1.0)
    assert "Home of" in markup.clean(text).text


def test_structure_of_the_clean_text():
    text = "# Top\n\n<h3>Part</h3>\n\n- [x] done\n\n```py\nx = 1  \n# no heading\n```\n\n\n\nThe $a^2$ and \\section{Last one}\n== Wiki ==\n\nLine\n----\nend"
    got = markup.clean(text)
    kept = [(k, n, got.text[a:b]) for k, n, a, b in got.structure]
    assert kept == [("heading", 1, "Top"), ("heading", 3, "Part"), ("item", 0, "- done"), ("code", 0, "x = 1\n# no heading"), ("formula", 0, "a^2"), ("heading", 2, "Last one"), ("heading", 2, "Wiki"), ("heading", 2, "Line")]


@pytest.mark.parametrize(("text", "want"), [("a <script>\nvar\n<b>bold</b> more &amp; x", "a \nvar\nbold more & x"), ("\\textbf{a \\emph{b \\underline{c \\texttt{d}}}} e", "a b c d e"), ("\\footnote{see \\emph{x}} y", " y")])
def test_open_and_nested_marks(text, want):
    got = markup.clean(text)
    assert got.text.strip() == want.strip().replace("a \nvar", "a\nvar") and not markup.families(markup.events(got.text))


@pytest.mark.parametrize("unit", ["**a** b ", "日本**语**文字 ", "{{a|b}}  ", "a_b *c* ", "**a ", "*a* **b ", "<a ", "\\textbf{a \\emph{b}} ", "\\[ a ", "<pre>x ", "Title\n---\n\n", "\\textbf{"])
def test_markup_takes_linear_time(unit):
    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        markup.clean(unit * (n // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 0.5 + 25 * took[0], took


def test_markup_frame(spark):
    got = {r["cpt_id"]: r for r in markup.clean_markup(frame(spark)).collect()}
    assert got[1]["clean_text"] is None and got[2]["clean_text"] == "" and got[1]["markup"] == []
    assert markup.clean_markup(frame(spark, [])).collect() == []
    assert markup.markup_found(frame(spark, [(1, "<b>x</b> **y**"), (1, "<b>x</b>")])).count() == 3


# ---- segmentation


def random_text(rng, blocks):
    out = []
    for _ in range(blocks):
        n = rng.choice((3, 20, 60, 150))
        line = " ".join(rng.choice(("alpha", "beta", "gamma", "delta.", "日本語。", "x" * 30)) for _ in range(n))
        out.append(rng.choice((line, line.replace(" ", "\n", 3), f"```\n{line}\n\n{line}\n```")))
    return rng.choice(("\n\n", "\r\n\r\n", "\n \n\n")).join(out)


def test_pieces_cover_and_respect_limits():
    rng = random.Random(5)
    for _ in range(150):
        text, limit, overlap = random_text(rng, rng.randrange(1, 12)), rng.choice((80, 300, 1000)), rng.choice((0, 20, 40))
        got = segment.pieces(text, limit, overlap)
        assert "".join(text[s:e] for s, e, _, _ in got) == text
        assert all(e - s + o <= limit and s >= o for s, e, o, _ in got)
        inside = any(c == "inside" for *_, c in got)
        assert inside == (len(text) > limit and any(b - a > limit for a, b in segment.blocks(text)))
        assert len(got) == 1 or len(text) > limit


def test_fence_is_one_block():
    text = "a\n\n````md\nx\n\n```\ny\n```\n````\n\nb\n\n~~~\nopen\n\nend"
    assert [text[a:b] for a, b in segment.blocks(text)] == ["a", "````md\nx\n\n```\ny\n```\n````", "b", "~~~\nopen\n\nend"]


def test_cut_goes_to_the_topic_change():
    one, two = "cats purr and cats sleep on mats", "stocks fell while bonds rose on markets"
    text = "\n\n".join([f"{one} {k}" for k in range(8)] + [f"{two} {k}" for k in range(8)])
    cuts = [s for s, _, _, c in segment.pieces(text, 400, 0) if c == "between"]
    assert text.index(two) in cuts


def test_segment_frame(spark):
    got = segment.cut_oversized(frame(spark), limit=6000).groupBy("cpt_id").count().collect()
    assert {r["cpt_id"] for r in got} == {3, 4, 5, 6, 7}
    assert [tuple(r) for r in segment.oversized(frame(spark)).collect()] == [(4, "inside")]
    assert segment.cut_oversized(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        segment.cut_oversized(frame(spark), limit=10, overlap=9)


# ---- encoding

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k"


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH + ".json")
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "ab's  \n\t.'(_)0129é日本ßжक्षไทย😀­​ <|endoftext|>'ll've"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)] + [LONG, "a" * 500, "don't  you're\n\n ok ", "  x", "x  ", "\n \n y", "日" * 300]
    a = bpe_automaton.Automaton(encode.compiled(PATH + ".tiktoken"))
    for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert a.encode(x) == want.ids, x
        assert a.decode(a.encode(x)).decode() == x


def test_small_cache_gives_the_same(spark):
    tables = encode.compiled(PATH + ".tiktoken")
    a, b = bpe_automaton.Automaton(tables), bpe_automaton.Automaton(tables, most_cached=3)
    assert a.encode(LONG[:500] + "many other words") == b.encode(LONG[:500] + "many other words")


def test_other_vocabulary():
    import tiktoken

    ranks = {t: k for k, t in enumerate(bpe_automaton.read_ranks(f"{encode.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))}
    a = bpe_automaton.Automaton(bpe_automaton.compile_gadgets(list(ranks)))
    import public_tokenizers

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in (LONG[:300], "Привет, мир! Größe 12", "日本語のテキスト", "नमस्ते दुनिया"):
        assert a.encode(x) == e.encode_ordinary(x)


def test_encode_frame(spark):
    got = encode.encode_corpus(frame(spark, id_col="doc_id").drop("ids").withColumn("ids", F.lit("clash")))
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert by[1] == [] and by[2] == [] and by[5] == by[6] and got.count() == len(CASES)
    assert encode.encode_corpus(frame(spark, [], "doc_id")).collect() == []
    back = {r["doc_id"]: r["text"] for r in encode.decode_ids(got).collect()}
    assert all(back[i] == (t or "") for i, t in CASES)


# ---- token budget


def test_safe_chunks_count_like_the_whole():
    a = bpe_automaton.Automaton(encode.compiled(PATH + ".tiktoken"))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abst'  \n\t.1½é日\x1c") for _ in range(200))
        parts = budget.safe_chunks(text, rng.choice((5, 20, 50)))
        assert "".join(parts) == text and sum(map(a.count, parts)) == a.count(text)


def test_versions():
    cases = {"3.15": "3.15", " 3.14\n": "3.14", "py315": "3.15", "cp313": "3.13", "３.１４": "3.14", "CPython 3.15.2": "3.15", "3.14.0b2": "3.14", "v3.13": "3.13", "3.1": "3.1", "3": None, "main": None, "": None, None: None, "13.15": None, "2.7": "2.7", "py27": "2.7", "4.0": "4.0", "python 2.7.18": "2.7"}
    assert {k: budget.version_of(k) for k in cases} == cases


def test_languages():
    cases = {
        "The scope is created for each of the loaders.": "en", "Die Vorlage wird nur einmal erzeugt.": "de", "La fonction est créée une seule fois.": "fr",
        "La función se crea una sola vez.": "es", "Почему строка не закрыта?": "ru", "なぜ行列は閉じられないのですか？": "ja", "为什么模板没有关闭？": "zh",
        "```\n# die der das und ist nicht ein kommentar\n```\nThe loader is closed.": "en", None: None, " ": None, "xyz": "en",
    }
    assert {k: language(k, budget.LANGUAGES) for k in cases} == cases


#: sentences that share no sentence, and few words, with the samples the letter sequences are learned from
HELD_OUT = {
    "en": ("Object oriented design simplifies maintenance.", "Cats chase mice.", "Send flowers tomorrow.", "Heavy trucks damaged several bridges.", "Doctors recommend fresh vegetables.", "Please restart your computer.", "Most planets orbit stars.", "Cheap tickets sold quickly.", "Musicians played softly.", "Remove unused imports."),
    "de": ("Objektorientierte Programmierung vereinfacht Wartung.", "Katzen jagen Mäuse.", "Schicke morgen Blumen.", "Schwere Lastwagen beschädigten mehrere Brücken.", "Ärzte empfehlen frisches Gemüse.", "Bitte starten Sie Ihren Rechner neu.", "Viele Planeten umkreisen Sterne.", "Günstige Karten waren schnell verkauft.", "Musiker spielten leise.", "Entferne unbenutzte Importe."),
    "fr": ("La conception orientée objet simplifie la maintenance.", "Les chats chassent les souris.", "Envoyez des fleurs demain.", "De lourds camions ont endommagé plusieurs ponts.", "Les médecins recommandent des légumes frais.", "Redémarrez votre ordinateur.", "Beaucoup de planètes tournent autour d'étoiles.", "Billets bon marché vendus rapidement.", "Musiciens jouant doucement.", "Supprimez les importations inutilisées."),
    "es": ("Cierra archivos abiertos.", "Los gatos cazan ratones.", "Envía flores mañana.", "Camiones pesados dañaron varios puentes.", "Médicos recomiendan verduras frescas.", "Reinicie su ordenador.", "Muchos planetas orbitan estrellas.", "Entradas baratas vendidas rápidamente.", "Músicos tocaban suavemente.", "Elimina importaciones inútiles."),
    "ru": ("Кошки ловят мышей.", "Закройте открытые файлы.", "Врачи советуют свежие овощи.", "Музыканты играли тихо."),
    "ja": ("猫はねずみを追いかけます。", "開いたファイルを閉じてください。", "医者は新鮮な野菜を勧めます。", "音楽家は静かに演奏した。"),
    "zh": ("猫追老鼠。", "请关闭打开的文件。", "医生推荐新鲜蔬菜。", "音乐家轻轻地演奏。"),
}


def test_language_of_held_out_sentences():
    got = [(k, language(x, budget.LANGUAGES), x) for k, texts in HELD_OUT.items() for x in texts]
    assert sum(a == b for a, b, _ in got) >= 0.95 * len(got), [x for x in got if x[0] != x[1]]


@pytest.mark.parametrize("unit", ["これは長い文章です。次の文もあります、", "这是一个很长的句子，没有空格。", "a=b;", "x.y_z(1)+"])
def test_long_texts_without_blanks_are_cut(unit):
    a = bpe_automaton.Automaton(encode.compiled(PATH + ".tiktoken"))
    text = unit * (180_000 // len(unit))
    parts = budget.safe_chunks(text, 16_384)
    assert len(parts) >= 10 and "".join(parts) == text and sum(map(a.count, parts)) == a.count(text)


def test_budget(spark):
    text = "The loader is closed for each of the readers. "
    cpt = spark.createDataFrame([(1, "docs\\A.RST", text), (2, "./docs/a.rst", None), (3, None, text * 900), (4, "unknown.rst", " "), (5, "x/b.rst", "日本語です。なぜですか。")], "cpt_id bigint, filename string, text string")
    message = "array<struct<role:string,content:string>>"
    sft = spark.createDataFrame([(1, [("user", "a b")], None, "py315"), (2, None, [("assistant", None)], None), (3, [("user", "a")], [("assistant", "b")], "3.15")], f"sft_id bigint, prompt {message}, completion {message}, python_version string")
    entries = spark.createDataFrame([("3.15", "docs", "a", "u")], "target_version string, category string, name string, url string")
    rows = {(r["tab"], r["row_id"], r["slice_kind"], r["slice_value"]): r["n_tokens"] for r in budget.row_slices(cpt.withColumn("lang", F.lit("clash")), sft, entries).collect()}
    a = bpe_automaton.Automaton(encode.compiled(PATH + ".tiktoken"))
    assert rows == {
        ("cpt", 1, "lang", "en"): a.count(text), ("cpt", 1, "source", "a"): a.count(text), ("cpt", 1, "domain", "docs"): a.count(text), ("cpt", 2, "source", "a"): 0, ("cpt", 2, "domain", "docs"): 0,
        ("cpt", 3, "lang", "en"): a.count(text * 900), ("cpt", 5, "lang", "ja"): a.count("日本語です。なぜですか。"), ("sft", 1, "version", "3.15"): a.count("a b"), ("sft", 3, "version", "3.15"): a.count("a\nb"),
    }
    total = {(r["slice_kind"], r["slice_value"]): (r["n_rows"], r["n_tokens"]) for r in budget.token_budget(cpt, sft, entries).collect()}
    assert total["version", "3.15"] == (2, a.count("a b") + a.count("a\nb")) and total["domain", "docs"][0] == 2
    assert budget.row_slices(cpt.limit(0), sft.limit(0), entries.limit(0)).collect() == []


# ---- leaks


def test_fm_index_against_scan():
    import numpy as np

    rng = np.random.default_rng(1)
    for size, symbols in ((1, 2), (50, 3), (400, 9), (300, 1)):
        seq = rng.integers(1, symbols + 1, size)
        index = FMIndex(seq, symbols)
        patterns = rng.integers(1, symbols + 1, (40, 3))
        low, high = index.search(patterns)
        row, at = index.locate(low, high)
        got = sorted(zip(row.tolist(), at.tolist()))
        want = sorted((p, k) for p in range(40) for k in range(size - 2) if (seq[k : k + 3] == patterns[p]).all())
        assert got == want


ITEM = "Imagine raha as a clerk filing 142 slips a day; model nufi_x with TelrelGri and report each lost slip today."


@pytest.mark.parametrize(
    "text",
    [
        ITEM, ITEM.upper(), ITEM.replace(" ", "\n> "), ITEM.replace("a", "а"), ITEM.replace(" ", "&nbsp; "), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in ITEM),
        ITEM.replace("clerk", "**clerk**").replace("slips", "<b>slips</b>"), ITEM.replace("filing", "fil​ing"), ITEM.replace("day", "[day](http://x.example/y)"), "before " + " ".join(ITEM.split()[3:14]) + " after",
    ],
)
def test_leak_forms(spark, text):
    docs = spark.createDataFrame([(1, "noise. " + text + " noise")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM, "The answer has words.")], "item_id bigint, prompt string, answer string")
    assert [tuple(r) for r in leak.leaked(docs, items).collect()] == [(1, 9)]


def test_leak_frame(spark):
    rows = [*CASES, (8, " ".join(ITEM.split()[:9])), (9, ITEM), (9, ITEM), (10, ITEM + " x y z " + ITEM), (11, "report each lost slip today the answer has words")]
    items = spark.createDataFrame([(1, ITEM, "The answer has words."), (2, ITEM, "Another end."), (3, None, None), (4, "too short", None), (1, ITEM, "The answer has words.")], "item_id bigint, prompt string, answer string")
    got = leak.leaked(frame(spark, rows, "doc_id"), items)
    assert sorted(map(tuple, got.collect())) == [(9, 1), (9, 2), (10, 1), (10, 2)]
    spans = [tuple(r) for r in leak.leaked_spans(frame(spark, [(10, ITEM + " x y z " + ITEM)], "doc_id"), items).where("item_id = 2").orderBy("first_word").collect()]
    n = len(match_words(ITEM))
    assert spans == [(10, 2, 0, n), (10, 2, n + 3, 2 * n + 3)]
    assert leak.leaked(frame(spark, [], "doc_id"), items).collect() == [] and leak.leaked(frame(spark, rows, "doc_id"), items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        leak.leaked(frame(spark, rows, "doc_id"), items, most_items=2)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to [mailto:a@b.org Name] first.", "Write to Name first."),
        ("Load [ftp://host/x label] first.", "Load label first."),
        ("See [HTTP://host/x label] first.", "See label first."),
        ("#redirect Other page", "Other page"),
    ],
)
def test_wiki_markup_without_other_marks(text, want):
    got, found, _, _ = markup.clean(text)
    assert (got.strip(), found) == (want, ["wiki"])


@pytest.mark.parametrize("gap", ["word " * 600, "one.\n\ntwo "])
def test_latex_commands_anywhere_in_an_argument(gap):
    got = markup.clean(f"Here \\textbf{{{gap}\\emph{{inner}} part}} and $\\frac{{1}}{{2}}$ end.")[0]
    assert "inner part and" in got and "emph" not in got and "textbf" not in got and "{inner" not in got


# ---- sentences

A, N, O = sentences.ABBREVIATION, sentences.NEVER_FINAL, sentences.ORDINARY
EVIDENCE = dict.fromkeys("approx fig i.e z.b т.е др z т".split(), A | N) | dict.fromkeys("the since we dann they".split(), O)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Fox and Prof. Hen came at 4 p.m. on Friday. They left.", ["Mr. Fox and Prof. Hen came at 4 p.m. on Friday.", "They left."]),
        ("It fell from 39.8 to 1.0 in v3.13. Since then it rose.", ["It fell from 39.8 to 1.0 in v3.13.", "Since then it rose."]),
        ('He said: "Is it done?" They agreed.', ['He said: "Is it done?"', "They agreed."]),
        ('He answered "No!" and left. We stayed.', ['He answered "No!" and left.', "We stayed."]),
        ('"It broke in 3.14. We pinned it," wrote Fox. The end.', ['"It broke in 3.14. We pinned it," wrote Fox.', "The end."]),
        ("(See fig. 3 for numbers.) The rest follows.", ["(See fig. 3 for numbers.)", "The rest follows."]),
        ("Old code used a.b_c, d.e_f, etc. The new does not.", ["Old code used a.b_c, d.e_f, etc.", "The new does not."]),
        ("Use it. run_all() returns nothing. Well... it was never so.", ["Use it.", "run_all() returns nothing.", "Well... it was never so."]),
        ("J. Q. Fox filed it, i.e. the report. Is it?! Yes.", ["J. Q. Fox filed it, i.e. the report.", "Is it?!", "Yes."]),
        ("Am 3. Mai kam z. B. Herr Dr. Fuchs. Dann ging er.", ["Am 3. Mai kam z. B. Herr Dr. Fuchs.", "Dann ging er."]),
        ("Это др. части, т. е. классы.Новая строка есть.", ["Это др. части, т. е. классы.", "Новая строка есть."]),
        ("「不要です。使います」と説明されています。次の文です！", ["「不要です。使います」と説明されています。", "次の文です！"]),
        ("“坏了。请改用”，作者写道。为什么？", ["“坏了。请改用”，作者写道。", "为什么？"]),
        ("क्या यह खुला है? यह बदल गया। अंत", ["क्या यह खुला है?", "यह बदल गया।", "अंत"]),
        ("لماذا تبقى؟ تغير السلوك.", ["لماذا تبقى؟", "تغير السلوك."]),
        ("โมดูลเปลี่ยนไป คลาสไม่รองรับ", ["โมดูลเปลี่ยนไป", "คลาสไม่รองรับ"]),
        ("Heading\n\nText one. Text\ntwo.\n\n- item. One item\n- b\n1. c\n# Title", ["Heading", "Text one.", "Text\ntwo.", "- item. One item", "- b", "1. c", "# Title"]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.ends(text, EVIDENCE)] == want


def test_document_evidence_finds_an_abbreviation():
    text = "The abt. 5 rule. An abt. 7 rule. The abt. Fox rule stands."
    assert len(sentences.ends(text, {})) == 3


def test_many_unclosed_openers_hide_no_sentence_end():
    text = "A ( " * 60 + "start. One ended. It is (so) here. Two ended."
    assert len(sentences.ends(text, {})) == 4


def test_sentences_frame(spark):
    df = frame(spark, id_col="doc_id")
    got = sentences.split_sentences(df).groupBy("doc_id").count().collect()
    by = {r["doc_id"]: r["count"] for r in got}
    assert by[4] == 4000 and by[5] == by[6] == 1 and not {1, 2, 3} & set(by)
    assert sentences.split_sentences(frame(spark, [], "doc_id")).collect() == []
    texts = spark.createDataFrame([(k, "It is approx. 5 long, see approx. values here.") for k in range(5)], "doc_id bigint, text string")
    assert {r["word"]: r["about"] for r in sentences.corpus_evidence(texts).collect()}["approx"] & sentences.ABBREVIATION


def test_long_words_are_evidence_of_a_sentence_end(spark):
    rows = [(k, "They met afterwards, and therefore left.") for k in range(5)]
    texts = spark.createDataFrame([*rows, (9, "We chose option B. Afterwards it ran. It was bought by I.B.M. Therefore it grew.")], "doc_id bigint, text string")
    evidence = sentences.corpus_evidence(texts)
    about = {r["word"]: r["about"] for r in evidence.collect()}
    assert about["afterwards"] == about["therefore"] == sentences.ORDINARY
    got = sentences.split_sentences(texts.where("doc_id = 9"), evidence=evidence).orderBy("sentence").collect()
    assert [r["sentence_text"] for r in got] == ["We chose option B.", "Afterwards it ran.", "It was bought by I.B.M.", "Therefore it grew."]


#: words no list can know: an abbreviation before numbers, a title, one before small words, a spaced pair, one that may end
INVENTED = ["It holds qvz. {0} rows.", "Then brl. Kastor came.", "We saw mnt. rows and left.", "It is v. k. Kastor who came.", "They sell tea, oil, prk. The rest is gone."]


def invented(n=60):
    """Paragraphs with their sentences, told apart by a separator that is not in the text."""
    rng = random.Random(12)
    plain = ["The rows are gone.", "We left early.", "Rows came back.", "It holds the tea.", "Nobody came to the rest.", "They sell oil to nobody."]
    made = []
    for k in range(n):
        parts = [rng.choice(INVENTED).format(k) if rng.random() < 0.5 else rng.choice(plain) for _ in range(8)]
        made.append([q for x in parts for q in x.replace("prk. The", "prk.|The").split("|")] + rng.choice(([], ["They sell prk."])))
    return [(k, "\n\n".join((" ".join(x[:4]), " ".join(x[4:])))) for k, x in enumerate(made)], made


def test_the_corpus_tells_words_that_no_list_has(spark):
    rows, made = invented()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def right(evidence):
        found = {}
        for r in sentences.split_sentences(df, evidence=evidence).collect():
            found.setdefault(r["doc_id"], []).append(r["sentence_text"])
        want = sum(map(len, made))
        good = sum(len(set(enumerate(found[k])) & set(enumerate(m))) if len(found[k]) == len(m) else 0 for k, m in enumerate(made))
        return good / want

    evidence = sentences.corpus_evidence(df)
    assert right(evidence) > 0.99
    assert right(evidence.limit(0)) < 0.3
    broadcast = sentences.split_sentences(df, evidence=evidence)
    joined = sentences.split_sentences(df, evidence=evidence, most=7)
    assert sorted(map(tuple, broadcast.collect())) == sorted(map(tuple, joined.collect()))


def test_a_name_in_the_document_starts_no_sentence():
    known = {"prk": sentences.ABBREVIATION, "rest": sentences.ORDINARY}
    assert len(sentences.ends("They sell prk. Rest is gone.", known)) == 2
    assert len(sentences.ends("They sell prk. Rest is gone. Later the firm Rest came.", known)) == 2


def test_long_documents_take_linear_time():
    unit = "The abt. 5 rule holds (so they say) for qrs. Fox and a.b.c. too, etc. "
    took = []
    for n in (3000, 15000):
        began = time.process_time()
        sentences.ends(unit * n, {})
        took.append(time.process_time() - began)
    assert took[1] < 4 + 8 * took[0], took


# ---- packing


def test_pack_frame(spark):
    got = pack.pack_texts(frame(spark), capacity=1000).collect()
    total = {}
    for r in got:
        total.setdefault(r["container"], []).append((r["offset"], r["n_tokens"]))
    for spans in total.values():
        spans.sort()
        assert sum(n for _, n in spans) <= 1000 and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    long = sorted((r["part"], r["n_tokens"], r["from_token"]) for r in got if r["cpt_id"] == 4)
    assert [n for _, n, _ in long[:-1]] == [1000] * (len(long) - 1) and long[-1][2] == 1000 * (len(long) - 1)
    assert sorted(r["cpt_id"] for r in got if r["cpt_id"] != 4) == [1, 2, 3, 5, 6, 7, 7]
    assert pack.pack_texts(frame(spark, [])).collect() == []


def test_pack_fills_containers(spark):
    rng = random.Random(8)
    sizes = [(k, rng.randrange(1, 900)) for k in range(3000)]
    df = spark.createDataFrame(sizes, "id int, n bigint")
    got = pack.pack_items(df, "id", "n", capacity=1000, shard_items=1000).groupBy("container").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r["n"] for r in got) <= 1000 and sum(n for _, n in sizes) / (1000 * len(got)) > 0.95
