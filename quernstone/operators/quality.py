"""Quality gates: contamination, memorization, imports, targets, provenance, diversity."""

from __future__ import annotations

import ast
import keyword
import re
import string
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import is_blank, tokens
from quernstone.session import written


def normal_prompt(c: Column) -> Column:
    """Words in lower case, parted by one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def contained_items(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, most_items: int = 100_000) -> DataFrame:
    """(`doc_id`, `item_id`): documents that hold an item's text verbatim.

    The benchmark's texts go to the driver, after a check of their number, and into one automaton that scans each
    document once; empty and null items match nothing.
    """
    spark = docs.sparkSession
    rows = items.select(item_id, item_text).where(F.length(item_text) > 0).limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items")
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()

    def scan(batches):
        import ahocorasick

        automaton, by_text = ahocorasick.Automaton(), {}
        for i, t in shared.value:
            by_text.setdefault(t, []).append(i)
        for t, ids in by_text.items():
            automaton.add_word(t, ids)
        if by_text:
            automaton.make_automaton()
        for b in batches:
            hits = [
                (d, i)
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                if t and by_text
                for i in {i for _, ids in automaton.iter(t) for i in ids}
            ]
            docs_hit, items_hit = zip(*hits) if hits else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(docs_hit, b.column(0).type), pa.array(items_hit, pa.int64() if kinds[1] == "bigint" else None)], [doc_id, item_id])

    return docs.select(doc_id, text_col).mapInArrow(scan, f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}")


def shingles(c: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` words, lower-cased; a shorter text is one run."""

    def of(w: Column) -> Column:
        n = F.size(w) - width + 1
        many = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(n > 1, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    # the outer transform binds the words once; they would else be split anew for every run
    return F.array_distinct(F.flatten(F.transform(F.array(tokens(F.lower(c))), of)))


def hashed(runs: Column) -> Column:
    """64-bit hashes in place of the strings of an array."""
    return F.transform(runs, lambda x: F.xxhash64(x))


def shingle_contamination(rows: DataFrame, row_id: str, text: Column, items: DataFrame, item_id: str, item_text: Column, threshold: float, width: int = 5) -> DataFrame:
    """(`row_id`, `item_id`, ``similarity``): pairs whose shingle sets have at least this Jaccard similarity.

    An equi-join on 64-bit hashes of the shingles; those of the benchmark, the small side, are broadcast if Spark finds them
    small enough, and then only the rows' shingles that matter are moved.
    """
    a = rows.select(F.col(row_id), hashed(shingles(text, width)).alias("s")).withColumn("n", F.size("s"))
    b = items.select(F.col(item_id), hashed(shingles(item_text, width)).alias("t")).withColumn("m", F.size("t"))
    left, right = a.select(row_id, "n", F.explode("s").alias("x")), b.select(item_id, "m", F.explode("t").alias("x"))
    both = left.join(right, "x").groupBy(row_id, item_id, "n", "m").agg(F.count("*").alias("k"))
    similarity = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return both.select(row_id, item_id, similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def normal_code(c: Column) -> Column:
    """Code without comments and blank lines, every run of white space one blank, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?m)#[^\n]*$", ""), r"\s+", " "))


def dual_axis(rows: DataFrame, row_id: str, text: Column, code: Column, items: DataFrame, item_id: str, item_text: Column, item_code: Column, text_threshold: float = 0.5, code_threshold: float = 0.5, width: int = 5) -> DataFrame:
    """(`row_id`, `item_id`, ``text_similarity``, ``code_similarity``): pairs near each other on either axis, each with a
    threshold of its own; the similarity is null on an axis that stays below its threshold."""
    on_text = shingle_contamination(rows, row_id, normal_prompt(text), items, item_id, normal_prompt(item_text), text_threshold, width).withColumnRenamed("similarity", "text_similarity")
    on_code = shingle_contamination(rows, row_id, normal_code(code), items, item_id, normal_code(item_code), code_threshold, width).withColumnRenamed("similarity", "code_similarity")
    return on_text.join(on_code, [row_id, item_id], "full").select(row_id, item_id, "text_similarity", "code_similarity")


def near_duplicates(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8, width: int = 5, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(classes: ``rep``, ``id``; links: ``a``, ``b``, ``similarity``): rows whose shingle sets are equal, and the pairs of class
    representatives whose Jaccard similarity is at least the threshold. Exact.

    Two sets that similar share one of the rarest ``n - ceil(threshold * n) + 1`` shingles of either, so only those are
    joined; rarity is counted over the classes. A shingle that more than ``most`` classes have in front is met in salted
    blocks. Null and wordless texts are in no class.
    """
    shingled = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(hashed(shingles(text, width)))).alias("s")).where(F.size("s") > 0)
    keyed = written(shingled.withColumn("k", F.md5(F.array_join("s", ","))), "shingles")
    reps = written(keyed.groupBy("k").agg(F.min("id").alias("rep"), F.min_by("s", "id").alias("s")), "reps")
    classes = keyed.select("id", "k").join(reps.select("k", "rep"), "k").select("rep", "id").distinct()
    held = reps.select("rep", F.explode("s").alias("x"))
    counts = held.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    # a shingle that one class alone has links nothing, but takes its place in front
    ranked = held.join(counts, "x").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("shared"))
    sized = reps.join(ranked, "rep").withColumn("n", F.size("s"))
    front = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("shared"))
    prefix = written(sized.where(front > 0).select("rep", "n", F.explode(F.slice("shared", 1, front)).alias("x")).select("rep", "n", "x.x"), "prefix")
    salts = F.ceil(F.col("c") / most).cast("int")
    crowd = prefix.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    met = prefix.join(crowd, "x")
    a = met.select("x", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"), F.col("rep").alias("a"), F.col("n").alias("na"))
    b = met.select("x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    pairs = a.join(b, ["x", "salt"]).where(near).select("a", "b").distinct()
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    return classes, links


def stop_if_contaminated(hits: DataFrame) -> None:
    """Raises if there is any hit: contamination must stop a run, not warn."""
    first = hits.head(1)
    if first:
        raise ValueError(f"contaminated: {first[0].asDict()}")


def memorization(items: DataFrame, item_text: Column, rows: DataFrame, text: Column) -> DataFrame:
    """(``n_items``, ``n_found``, ``rate``): the share of items whose normalised text is a normalised text of the rows."""
    wanted = items.select(normal_prompt(item_text).alias("k")).where("k <> ''")
    wanted = wanted.select(F.md5("k").alias("k"))
    # the rows are first reduced to what is wanted, by hash, so that no text is moved
    known = rows.select(F.md5(normal_prompt(text)).alias("k")).join(wanted.distinct(), "k", "left_semi").distinct().withColumn("hit", F.lit(1))
    joined = wanted.join(known, "k", "left")
    return joined.agg(F.count("*").alias("n_items"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("rate"))


def decontaminated(rows: DataFrame, text: Column, items: DataFrame, item_text: Column) -> DataFrame:
    """The rows whose normalised text is no item's."""
    keys = items.select(normal_prompt(item_text).alias("__k")).distinct()
    return rows.withColumn("__k", F.coalesce(normal_prompt(text), F.lit(""))).join(keys, "__k", "left_anti").drop("__k")


#: string literals and comments, also those of code that does not parse
_MASKED = re.compile(r'''("""|\'\'\')(?:\\[\s\S]|[^\\])*?\1|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'|#[^\n]*''')
_IMPORT = re.compile(r"(?:^|[;:])[ \t\f]*(?:lazy[ \t]+)?(?:import\b[ \t]*([^;\n]+)|from[ \t]+([^\W\d]\w*)[\w. \t]*?[ \t]import\b)", re.M)
_NAME = re.compile(r"\s*([^\W\d]\w*)")


def _masked(code: str) -> str:
    """Code without comments, contents of strings and joined lines."""
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    return _MASKED.sub(lambda m: "" if m.group()[0] == "#" else "''", code).replace("\\\n", " ")


def _parsed(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def imported_modules(code: str | None) -> list[str]:
    """Top-level modules a snippet imports, each once: every name of every statement, relative imports aside.

    Read from the syntax tree, or from the text of the statements where a snippet does not parse (as with literals newer
    than this Python).
    """
    found: list[str] = []
    tree = _parsed(code or "")
    if tree is not None:
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                found += [x.name.partition(".")[0] for x in node.names]
            elif isinstance(node, ast.ImportFrom) and not node.level:
                found.append(node.module.partition(".")[0])
    else:
        for names, source in _IMPORT.findall(_masked(code)):
            firsts = [source] if source else [m[1] for m in map(_NAME.match, names.split(",")) if m]
            found += [x for x in firsts if not keyword.iskeyword(x)]
    return list(dict.fromkeys(found))


def foreign_imports(df: DataFrame, id_col: str, code: Column, allowed: list[str] | None = None) -> DataFrame:
    """(`id_col`, ``module``): imports outside the standard library."""
    known = frozenset(allowed if allowed is not None else sys.stdlib_module_names)

    def run(batches):
        for b in batches:
            rows = [(i, m) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in imported_modules(c) if m not in known]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], b.column(0).type), pa.array([m for _, m in rows], pa.string())], [id_col, "module"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, code.alias("__code")).where(F.contains("__code", F.lit("import"))).mapInArrow(run, f"`{id_col}` {kind}, module string")


def has_template_string(code: Column) -> Column:
    """Whether a snippet holds a t-string literal."""
    return code.rlike(r"(?:^|[^A-Za-z0-9_'\"])[tT][rR]?['\"]|(?:^|[^A-Za-z0-9_'\"])[rR][tT]['\"]")


_FROM = re.compile(r"\bfrom[ \t]+([\w.]+)[ \t]+import\b[ \t]*(\([^)]*\)|[^;\n]*)")


def consumes_templates(code: str | None) -> bool:
    """Whether a snippet, outside strings and comments, imports or uses ``string.templatelib``, or uses a ``Template`` or
    ``Interpolation`` that it neither defines nor takes from another module."""
    text = _masked(code or "")
    if re.search(r"\btemplatelib\b", text):
        return True
    other = [names.strip("()") for module, names in _FROM.findall(text)]
    star = any(module == "string" and "*" in names for module, names in _FROM.findall(text))
    return any(
        re.search(rf"(?<![\w.]){name}\b", text)
        and not re.search(rf"\b(?:class|def)[ \t]+{name}\b|(?m:^[ \t]*{name}[ \t]*=(?!=))|\bas[ \t]+{name}\b", text)
        and not any(re.search(rf"\b{name}\b", names) for names in other)
        and not (star and name == "Template")
        for name in ("Template", "Interpolation")
    )


def on_target(df: DataFrame, id_col: str, code: Column) -> DataFrame:
    """(`id_col`, ``on_target``): whether a snippet has the feature, a t-string literal or a consumer of templates."""

    def run(batches):
        for b in batches:
            got = [c is not None and consumes_templates(c) or known for known, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.bool_())], [id_col, "on_target"])

    named = F.contains(code, F.lit("Template")) | F.contains(code, F.lit("Interpolation")) | F.contains(code, F.lit("templatelib"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, has_template_string(code).alias("__literal"), F.when(named, code).alias("__code"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, on_target boolean")


def _old_forms(code: str | None) -> list[str] | None:
    """Old string formatting in a snippet; None where it does not parse. Format specifications inside slots are exempt."""
    if code is None:
        return None
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found, inside = set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FormattedValue) and node.format_spec is not None:
            inside.update(id(x) for x in ast.walk(node.format_spec))
    for node in ast.walk(tree):
        if id(node) in inside:
            continue
        if isinstance(node, ast.JoinedStr):
            found.add("fstring")
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str):
            found.add("percent")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
            target = node.func.value
            if isinstance(target, ast.Constant) and isinstance(target.value, str):
                try:
                    list(string.Formatter().parse(target.value))
                except ValueError:
                    continue
                found.add("format")
    return sorted(found)


def old_form_canary(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """(`id_col`, ``parses``, ``old_forms``): by the syntax tree of each snippet; nothing is executed."""

    def run(batches):
        for b in batches:
            got = [_old_forms(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g is not None for g in got]), pa.array([g or [] for g in got], pa.list_(pa.string()))], [id_col, "parses", "old_forms"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, code_col).mapInArrow(run, f"`{id_col}` {kind}, parses boolean, old_forms array<string>")


def missing_provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(``column``, ``missing``): rows whose provenance columns are null or blank."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull() | is_blank(c), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def diversity(df: DataFrame, by: str, text: Column, width: int = 5) -> DataFrame:
    """(`by`, ``n_rows``, ``n_shingles``, ``n_distinct``): how much of a slice is not repetition."""
    rows = df.select(F.col(by), hashed(shingles(text, width)).alias("s"))
    per = rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.sum(F.size("s")).alias("n_shingles"))
    distinct = rows.select(by, F.explode("s").alias("x")).distinct().groupBy(by).agg(F.count("*").alias("n_distinct"))
    return per.join(distinct, by, "left").select(by, "n_rows", "n_shingles", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def pass_rate(df: DataFrame, by: str, passed: Column) -> DataFrame:
    """(`by`, ``n``, ``n_passed``, ``rate``, ``upper_bound``): nulls count as failed; with no pass at all the bound of a
    95 % interval is three over the count."""
    ok = F.sum(F.coalesce(passed, F.lit(False)).cast("bigint"))
    rated = df.groupBy(by).agg(F.count("*").alias("n"), ok.alias("n_passed"))
    return rated.withColumn("rate", F.col("n_passed") / F.col("n")).withColumn("upper_bound", F.when(F.col("n_passed") == 0, F.least(F.lit(1.0), F.lit(3.0) / F.col("n"))))
