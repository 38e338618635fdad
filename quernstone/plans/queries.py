"""Queries of the reference's own operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import datasets as D
from quernstone.operators import doctree, evaluation, generation, packing, quality, render, reporting
from quernstone.session import keep_until_dropped, shared_dir, spread, table
from quernstone.sources import files
from quernstone.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: tokens of a packed sequence, with the one left for the end token
SEQUENCE = 256


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def _text(column: str, role: str | None = None):
    """Message contents of ``column`` joined by line feeds."""
    messages = F.coalesce(F.col(column), F.array())
    kept = F.filter(messages, lambda m: m["role"] == role) if role else messages
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


@query
def cpt_rows(s, d):
    docs = table(s, d, "documents").where("text is not null")
    path = F.concat_ws("/", "kind", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return D.cpt_rows(docs.select(path.alias("path"), "text"), "path", "text")


@query
def rendered_rows(s, d):
    """All documents rendered as Markdown rows."""
    docs = table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return render.render_markdown(docs)


@query
def path_order(s, d):
    """Component-wise order of file names: the position of each distinct name among all."""
    names = table(s, d, "cpt").where("filename is not null").select("filename").distinct().withColumn("parts", T.path_key("filename"))
    return D.ranked(names, ["parts"]).select("filename", "place")


@query
def jsonl_roundtrip(s, d):
    """Prose and other documents written as two JSONL parts and read again strictly, in argument order."""
    import uuid

    docs = table(s, d, "documents").select("doc_id", "text", "kind")
    root = f"{shared_dir(s)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(docs.where("kind = 'prose'").drop("kind"), f"{root}/a.jsonl", "overwrite")
    files.write_jsonl(docs.where("kind is distinct from 'prose'").drop("kind"), f"{root}/b.jsonl", "overwrite")
    keep_until_dropped(root)
    return files.read_jsonl(s, [f"{root}/a.jsonl", f"{root}/b.jsonl"], "doc_id bigint, text string")


@query
def blank_line_skip(s, d):
    lines = F.filter(T.splitlines("text"), lambda x: T.strip(x) != "")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"))


@query
def version_mentions(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", *[T.mentions_version("text", v).alias(f"names_{v.replace('.', '_')}") for v in ("3.14", "3.15")])


@query
def section_extract(s, d):
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return doctree.changed_sections(docs, "3.15", "doc_id", "text")


@query
def change_documents(s, d):
    return doctree.change_documents(section_extract(s, d))


@query
def line_window_clamp(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.size(T.splitlines("text")).alias("n"))
    start, end = doctree.clamp(F.lit(0), F.col("n"), F.floor(F.col("n") / 2).cast("int"), F.lit(False), longest=50, half=10)
    return docs.select("doc_id", start.cast("bigint").alias("line_from"), end.cast("bigint").alias("line_to"))


@query
def sft_pairs(s, d):
    turns = table(s, d, "sft").select("sft_id", F.posexplode(F.concat(F.coalesce("prompt", F.array()), F.coalesce("completion", F.array()))).alias("turn", "m"))
    pairs = D.turn_pairs(turns.select("sft_id", "turn", "m.role", "m.content"), "sft_id", "turn")
    return pairs.select("sft_id", F.col("turn").cast("bigint").alias("turn"), "prompt", "response")


@query
def response_assembly(s, d):
    return table(s, d, "sft").select("sft_id", T.response("idea", "code").alias("response"))


@query
def context_render(s, d):
    documents = F.array(F.struct(F.coalesce("filename", F.lit("untitled")).alias("title"), F.coalesce("code", F.lit("")).alias("document")))
    return table(s, d, "sft").select("sft_id", T.render_context(F.lit("Reply as JSON."), F.col("trace"), documents, F.coalesce("idea", F.lit(""))).alias("context"))


@query
def verify_outputs(s, d):
    padded = F.concat(F.lit("\u00a0\n"), F.col("expected_output"), F.lit(" \t"))
    actual = F.when(F.col("trace").isNull(), F.col("code")).otherwise(padded)
    return table(s, d, "sft").select("sft_id", D.verified(actual, F.col("expected_output")).alias("verified"))


@query
def truncate_output(s, d):
    return table(s, d, "documents").select("doc_id", T.truncate("text").alias("text"))


@query
def extract_fence(s, d):
    return table(s, d, "sft").select("sft_id", T.extract_fence(_text("completion")).alias("code"))


@query
def extract_code(s, d):
    return table(s, d, "sft").select("sft_id", T.extract_code(_text("completion")).alias("code"))


@query
def strip_prompt(s, d):
    sft = table(s, d, "sft").select("sft_id", _text("prompt", "user").alias("p"), _text("completion").alias("c"))
    return sft.select("sft_id", T.strip_prompt("c", "p").alias("text"))


@query
def token_counts(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens("text")).cast("bigint").alias("n_tokens"))


def _documents(s, d):
    return spread(table(s, d, "documents")).where("text is not null")


@query
def token_windows(s, d):
    w = packing.token_windows(_documents(s, d), "doc_id", T.tokens("text"), SEQUENCE - 1)
    return w.select("doc_id", F.col("window").cast("bigint").alias("window"), F.array_join("tokens", " ").alias("tokens"))


@query
def tail_windows(s, d):
    w = packing.tails(_documents(s, d), "doc_id", T.tokens("text"), SEQUENCE - 1)
    return w.select("doc_id", "kind", F.array_join("tokens", " ").alias("tokens"))


@query
def truncate_seq(s, d):
    return _documents(s, d).select("doc_id", F.array_join(F.slice(T.tokens("text"), 1, SEQUENCE), " ").alias("tokens"))


@query
def ffd_pack(s, d):
    left = packing.tails(_documents(s, d), "doc_id", T.tokens("text"), SEQUENCE - 1).where("kind <> 'window'")
    placed = packing.first_fit_decreasing(left.select("doc_id", F.size("tokens").alias("n")), "doc_id", "n", SEQUENCE - 1)
    return placed.select("doc_id", "n", "bin")


@query
def packed_sequences(s, d):
    packed = packing.pack_documents(_documents(s, d), "doc_id", T.tokens("text"), SEQUENCE)
    return packed.select(F.col("part").cast("bigint").alias("part"), "document", F.when(F.col("document").isNull() | (F.col("ordinal") < 2**62), F.col("ordinal")).alias("ordinal"), F.array_join("tokens", " ").alias("tokens"))


@query
def best_fit_pack(s, d):
    sizes = _documents(s, d).select("doc_id", F.size(T.tokens("text")).alias("n"))
    return packing.best_fit_decreasing(sizes, "doc_id", "n", SEQUENCE, split=True).withColumn("part", F.col("part").cast("bigint"))


@query
def train_eval_split(s, d):
    return D.exact_split(table(s, d, "documents").select("doc_id"), "doc_id")


@query
def step_plan(s, d):
    return D.step_plan(table(s, d, "documents").withColumn("kind", F.coalesce("kind", F.lit("none"))), "kind", 4, 8, 3)


@query
def dataset_manifest(s, d):
    return D.manifest({t: table(s, d, t) for t in ("documents", "cpt", "sft", "verdicts", "source_catalogue", "eval_prompts")})


@query
def log_normalise(s, d):
    """The lines a log would keep of each document, with a redrawn and a coloured line put in front."""
    text = F.concat(F.lit("10%\r50%\rdone\n\x1b[1mred\x1b[0m\n"), F.col("text"))
    return _documents(s, d).select("doc_id", F.array_join(T.log_lines(text), "\n").alias("log"))


@query
def log_chunks(s, d):
    """Documents as chunks of one log per source: lines run on from chunk to chunk."""
    chunks = _documents(s, d).select(F.coalesce("source", F.lit("none")).alias("stream"), F.col("doc_id").alias("seq"), F.col("text").alias("chunk"))
    return logs.log_batch(chunks).select("stream", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query
def schema_gate(s, d):
    """Strict typing of JSON properties: ``k`` must be there and an integer; two malformed forms of each row must not pass."""
    events = table(s, d, "events").select("event_id", "props")
    forms = F.array(F.col("props"), F.regexp_replace("props", r": (\d+)", ': "$1"'), F.regexp_replace("props", r"\}", ""))
    rows = events.select("event_id", F.posexplode(forms).alias("form", "props"))
    value = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(value, "$.k", "variant"))
    return rows.select("event_id", F.col("form").cast("bigint").alias("form"), F.coalesce(kind == "BIGINT", F.lit(False)).alias("fits"))


@query
def exact_dups(s, d):
    """Texts that several documents have."""
    groups = _documents(s, d).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return groups.where("n > 1")


@query
def first_by_key(s, d):
    """The first delivery of every verdict."""
    return D.first_by(table(s, d, "verdicts").select("sft_id", "attempt", "verdict_id", "judgement", "passed"), ["sft_id", "attempt"], ["verdict_id", "judgement", "passed"]).select("sft_id", "attempt", "verdict_id")


@query
def contamination_exact(s, d):
    return quality.contained_items(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_prompts"), "item_id", "prompt")


@query
def contamination_shingle(s, d):
    """Pairs of documents and held-out items by the five-word shingles they share."""
    hits = quality.shingle_contamination(_documents(s, d), "doc_id", F.col("text"), table(s, d, "eval_prompts"), "item_id", F.col("prompt"), 0.02)
    return hits.withColumn("similarity", F.round("similarity", 9))


@query
def memorization_rate(s, d):
    return quality.memorization(table(s, d, "eval_prompts"), F.col("prompt"), table(s, d, "documents"), F.col("text"))


@query
def decontaminated(s, d):
    return quality.decontaminated(table(s, d, "sft").select("sft_id", "idea"), F.col("idea"), table(s, d, "eval_prompts"), F.col("prompt"))


@query
def eval_pass_rate(s, d):
    rated = quality.pass_rate(table(s, d, "verdicts").dropDuplicates(["verdict_id"]), "attempt", F.col("passed"))
    return rated.select("attempt", "n", "n_passed", F.round("rate", 9).alias("rate"), F.round("upper_bound", 9).alias("upper_bound"))


@query
def judge_quarantine(s, d):
    """Rows with what their last verdict makes of them: kept with their expected output, or quarantined; a verified row needs
    no verdict."""
    last = table(s, d, "verdicts").groupBy("sft_id").agg(F.max_by("passed", F.struct("attempt", "verdict_id", F.coalesce("passed", F.lit(False)))).alias("passed"))
    rows = table(s, d, "sft").select("sft_id", "expected_output", "trace").join(last, "sft_id", "left")
    same = D.verified(F.col("trace"), F.col("expected_output"))
    kept, output = D.settle(same, F.col("passed"), F.col("expected_output"), F.col("trace"))
    return rows.select("sft_id", kept.alias("kept"), output.alias("output"))


@query
def worker_grid(s, d):
    n = s.range(1, 201).withColumnRenamed("id", "workers")
    rows, columns = T.worker_grid("workers")
    return n.select("workers", rows.alias("n_rows"), columns.alias("n_columns"))


@query
def source_catalogue(s, d):
    out = None
    entries = table(s, d, "source_catalogue")
    for v in sorted(r["target_version"] for r in entries.select("target_version").where("target_version is not null").distinct().collect()):  # a small fixed catalogue
        one = files.of_version(entries, v).select("target_version", "destination", "url")
        out = one if out is None else out.unionByName(one)
    return out


@query
def foreign_imports(s, d):
    return quality.foreign_imports(table(s, d, "sft").where("code is not null"), "sft_id", F.col("code"))


@query
def on_target(s, d):
    return quality.on_target(table(s, d, "sft").where("code is not null"), "sft_id", F.col("code"))


@query
def old_form_canary(s, d):
    return quality.old_form_canary(table(s, d, "sft").where("code is not null"), "sft_id", "code")


@query
def missing_provenance(s, d):
    return quality.missing_provenance(table(s, d, "sft"), ["filename", "python_version", "idea"])


@query
def diversity(s, d):
    return quality.diversity(_documents(s, d).withColumn("kind", F.coalesce("kind", F.lit("none"))), "kind", F.col("text"))


@query
def file_names(s, d):
    names = table(s, d, "cpt").where("filename is not null").select("filename").distinct()
    return names.select("filename", T.base_name("filename").alias("base_name"), T.with_suffix("filename", ".rst", ".md").alias("as_markdown"))


@query
def indent_display(s, d):
    return table(s, d, "sft").where("code is not null").select("sft_id", T.indent("code").alias("shown"))


@query
def generated_rows(s, d):
    """Rows made from catalogue entries by the offline model and runner, with their status."""
    docs = table(s, d, "source_catalogue").select(F.col("name").alias("filename"), F.col("url").alias("text"))
    ideas = generation.ideas_of(docs, generation.HashModel)
    return generation.rows_of(ideas, generation.HashModel, generation.EchoRunner, docs)


@query
def near_dups(s, d):
    """Pairs of documents, one for each class of equal shingle sets, that share at least 0.8 of their five-word shingles."""
    _, links = quality.near_duplicates(_documents(s, d), "doc_id", F.col("text"))
    return links.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query
def near_dup_classes(s, d):
    """The class of equal shingle sets of every document."""
    classes, _ = quality.near_duplicates(_documents(s, d), "doc_id", F.col("text"))
    return classes.select(F.col("id").alias("doc_id"), "rep")


@query
def contamination_dual(s, d):
    """Rows near a held-out item by their idea or by their code."""
    hits = quality.dual_axis(spread(table(s, d, "sft")), "sft_id", F.col("idea"), F.col("code"), table(s, d, "eval_prompts"), "item_id", F.col("prompt"), F.col("answer"), 0.02, 0.02)
    return hits.withColumn("text_similarity", F.round("text_similarity", 9)).withColumn("code_similarity", F.round("code_similarity", 9))


@query
def shuffled_order(s, d):
    return D.shuffled(table(s, d, "documents").select("doc_id"), "doc_id")


@query
def trainer_text(s, d):
    """What a trainer reads of pairs and of texts."""
    sft, cpt = table(s, d, "sft"), table(s, d, "cpt")
    return sft.select(F.lit("sft").alias("tab"), F.col("sft_id").alias("row_id"), D.text_column(sft).alias("text")).unionByName(cpt.select(F.lit("cpt").alias("tab"), F.col("cpt_id").alias("row_id"), D.text_column(cpt).alias("text")))


@query
def sft_projection(s, d):
    """The columns of fine-tuning rows, messages laid open."""
    made = table(s, d, "sft").select("sft_id", F.col("idea").alias("prompt"), F.col("trace").alias("explanation"), "filename", "python_version", "idea", "code", "trace", "expected_output")
    rows = D.sft_rows(made)
    return rows.select("filename", "python_version", "idea", "code", "trace", "expected_output", *(F.element_at(c, 1)[f].alias(f"{c}_{f}") for c in ("prompt", "completion") for f in ("role", "content")))


@query
def seed_texts(s, d):
    rows = table(s, d, "sft").where("idea is not null and code is not null")
    return reporting.seed_rows(rows, "t-strings", F.col("idea"), F.col("code"))


@query
def check_partition(s, d):
    """Verdicts that passed and those that did not, an unknown result among the latter."""
    kept, failed = reporting.partition_by_check(table(s, d, "verdicts"), F.col("passed"))
    return kept.select("verdict_id", "sft_id", F.lit(True).alias("kept")).unionByName(failed.select("verdict_id", "sft_id", F.lit(False).alias("kept")))


@query
def passed_share(s, d):
    """The percentage of verdicts that passed, by attempt, as text."""
    per = table(s, d, "verdicts").groupBy("attempt").agg(F.count("*").alias("n"), F.count_if("passed").alias("k"))
    return per.select("attempt", reporting.share(F.col("k"), F.col("n")).alias("share"))


@query
def check_counts(s, d):
    """Verdicts in all, passed and not."""
    return reporting.check_totals(table(s, d, "verdicts"), F.col("passed"))


@query
def message_pairs(s, d):
    """Idea and code as a pair of messages, laid open."""
    made = reporting.pair_json(table(s, d, "sft").select("sft_id", "idea", "code"), "sft_id", "idea", "code")
    told = [F.get_json_object("json", f"$[{k}].content").alias(n) for k, n in enumerate(("asked", "replied"))]
    return made.select("sft_id", F.element_at("messages", 1)["role"].alias("first_role"), F.element_at("messages", 2)["role"].alias("second_role"), *told)


@query
def seed_patterns(s, d):
    """Every catalogue entry with every pattern."""
    return files.with_patterns(table(s, d, "source_catalogue").select("name", "category"), ["explain", "rewrite", "test"])


@query
def first_rows(s, d):
    """The first 25 documents by id, and a limit of 0, which means all, of the catalogue."""
    first = reporting.limited(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id").orderBy("doc_id").select("name"), 25)
    return first.unionByName(reporting.limited(table(s, d, "source_catalogue").select("name").orderBy("name"), 0))


@query
def eval_loop(s, d):
    """Held-out items completed by the offline model, their code taken out and checked, and the pass rate by label."""
    _, rated = evaluation.evaluate(table(s, d, "eval_prompts"), "item_id", "prompt", "label", generation.HashModel, quality.has_template_string)
    return rated
