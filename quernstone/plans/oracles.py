"""DuckDB oracles of the queries, one statement each, written independently of the Spark plans."""

from __future__ import annotations

import sys

from quernstone.functions.text import LINE_BREAK, WS

_WS = "||".join(f"chr({ord(c)})" for c in WS)
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
assert LINE_BREAK
_LINES = f"(case when regexp_matches(text, '({_BREAK})$') or text = '' then list_slice(l, 1, len(l) - 1) else l end)"
_SPLIT = f"(select doc_id, text, regexp_split_to_array(text, '{_BREAK}') as l from documents where text is not null)"
_TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')"
_DOCS = f"select doc_id, {_TOKENS} as t from documents where text is not null"
_CONTENT = "coalesce(array_to_string(list_transform(list_filter({0}, lambda m: m.content is not null{1}), lambda m: m.content), chr(10)), '')"
_COMPLETION = _CONTENT.format("completion", "")
_PROMPT = _CONTENT.format("prompt", " and m.role = 'user'")
_NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_SHINGLES = (
    "list_distinct(case when len({0}) > 5 then list_transform(range(1, len({0}) - 3), lambda i: array_to_string(list_slice({0}, i, i + 4), ' ')) "
    "when len({0}) > 0 then [array_to_string({0}, ' ')] else [] end)"
)
_LOWER_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\v\f\r]+'), lambda x: x <> '')"
_TAILS = f"""
tails as (select doc_id, case
    when len(t) <= 255 then {{'kind': 'whole', 'x': t}}
    when len(t) % 255 > 0 and 255 - len(t) % 255 <= 76 then {{'kind': 'window', 'x': list_slice(t, len(t) - 254, len(t))}}
    when len(t) % 255 > 0 then {{'kind': 'fragment', 'x': list_slice(t, len(t) - (len(t) % 255 + 76) + 1, len(t))}} end as m
  from ({_DOCS}))"""
_WINDOWS = f"select doc_id, w as \"window\", list_slice(t, w * 255 + 1, w * 255 + 255) as x from (select doc_id, t, unnest(range(0, len(t) // 255)) as w from ({_DOCS}) where len(t) > 255)"
_FFD = f"""with recursive {_TAILS},
frags as (select doc_id, len(m.x) as n, row_number() over (order by len(m.x) desc, doc_id) as k from tails where m.kind <> 'window'),
fill as (
  select 0::bigint as k, []::bigint[] as b, 0::bigint as bin
  union all
  select k, case when fit is null then list_append(b, n) else list_concat(list_slice(b, 1, fit - 1), [b[fit] + 1 + n], list_slice(b, fit + 1, len(b))) end,
         coalesce(fit - 1, len(b))
  from (select f.k, p.b, f.n, list_position(list_transform(p.b, lambda v: v + 1 + f.n <= 255), true) as fit from fill p join frags f on f.k = p.k + 1))"""

_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WS)
_PROSE = f"(not regexp_matches(x, '[=:().\\\\]') and len(list_filter(regexp_split_to_array(x, '[{_CLASS}]+'), lambda w: w <> '')) > 10)"
_FENCES = f"regexp_extract_all({_COMPLETION}, '(?s)```python\\s*\\n(.*?)```', 1)"

_ORACLES = {
    "cpt_rows": "select kind || '/' || source || '/' || doc_id || '.rst' as filename, text from documents where text is not null",
    "path_order": "select filename, row_number() over (order by string_split(filename, '/')) as place from (select distinct filename from cpt where filename is not null)",
    "jsonl_roundtrip": "select doc_id, text, case when kind = 'prose' then 0 else 1 end as path_ordinal from documents",
    "blank_line_skip": f"select doc_id, len(list_filter({_LINES}, lambda x: trim(x, {_WS}) <> '')) as n_lines from {_SPLIT}",
    "version_mentions": "select doc_id, "
    + ", ".join(f"regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])3\\.{v}(?:[^\\p{{L}}\\p{{N}}_]|$)') as names_3_{v}" for v in (14, 15))
    + " from documents where text is not null",
    "line_window_clamp": f"select doc_id, case when n > 50 then greatest(0, n // 2 - 10) else 0 end as line_from, case when n > 50 then least(n, n // 2 + 10) else n end as line_to from (select doc_id, len({_LINES}) as n from {_SPLIT})",
    "sft_pairs": "select sft_id, turn, prompt, response from (select sft_id, turn, m.role as role, m.content as prompt, lead(m.role) over w as r, lead(m.content) over w as response from "
    "(select sft_id, unnest(range(0, len(a))) as turn, unnest(a) as m from (select sft_id, list_concat(coalesce(prompt, []), coalesce(completion, [])) as a from sft)) window w as (partition by sft_id order by turn)) where role = 'user' and r = 'assistant'",
    "response_assembly": "select sft_id, idea || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' as response from sft",
    "context_render": "select sft_id, concat_ws(chr(10) || chr(10), 'Reply as JSON.', trace, '--- ' || coalesce(filename, 'untitled') || ' ---' || chr(10) || coalesce(code, ''), coalesce(idea, '')) as context from sft",
    "verify_outputs": f"select sft_id, coalesce(trim(case when trace is null then code else chr(160) || chr(10) || expected_output || ' ' || chr(9) end, {_WS}) = trim(expected_output, {_WS}), false) as verified from sft",
    "truncate_output": "select doc_id, case when length(text) <= 12000 then text else left(text, 12000) || '... [truncated, ' || (length(text) - 12000) || ' more characters]' end as text from documents",
    "extract_fence": f"select sft_id, case when len(f) > 0 then trim(list_reduce(f, lambda x, y: case when length(y) > length(x) then y else x end), {_WS}) end as code from (select sft_id, regexp_extract_all({_COMPLETION}, '(?s)```python\\s*\\n(.*?)```', 1) as f from sft)",
    "extract_code": f"""with l as (select sft_id, {_FENCES} as f, string_split(trim({_COMPLETION}, {_WS}), chr(10)) as lines from sft),
a as (select *, list_position(list_transform(lines, lambda x: regexp_matches(x, '^[#\\-*>`]') or regexp_matches(x, '^(?:I''m|You|Here)') or {_PROSE}), false) as a from l),
b as (select *, list_slice(lines, a, len(lines)) as rest from a),
c as (select *, list_position(list_reverse(list_transform(rest, lambda x: regexp_matches(x, '^[#\\-*>`]') or contains(x, '---') or {_PROSE})), false) as p from b)
select sft_id, case when len(f) > 0 then trim(list_reduce(f, lambda x, y: case when length(y) > length(x) then y else x end), {_WS})
  when a is null or p is null then '' else trim(array_to_string(list_slice(rest, 1, len(rest) - p + 1), chr(10)), {_WS}) end as code from c""",
    "strip_prompt": f"select sft_id, case when starts_with(c, p) then substr(c, length(p) + 1) else c end as text from (select sft_id, {_COMPLETION} as c, {_PROMPT} as p from sft)",
    "best_fit_pack": f"""with recursive items as (select doc_id, part, least(256, n - part * 256) as n from
  (select doc_id, len(t)::bigint as n, unnest(range(0, greatest(1, (len(t) + 255) // 256)))::bigint as part from ({_DOCS}))),
ranked as (select *, row_number() over (order by n desc, doc_id, part) as k from items),
fill as (
  select 0::bigint as k, []::bigint[] as b, 0::bigint as bin
  union all
  select k, case when fit is null then list_append(b, n) else list_concat(list_slice(b, 1, fit - 1), [b[fit] + n], list_slice(b, fit + 1, len(b))) end, coalesce(fit - 1, len(b))
  from (select r.k, p.b, r.n, list_position(p.b, list_max(list_filter(p.b, lambda v: v + r.n <= 256))) as fit from fill p join ranked r on r.k = p.k + 1))
select doc_id, part, n, f.bin from fill f join ranked using (k)""",
    "near_dups": f"""with a as (select min(doc_id) as doc_id, s from (select doc_id, list_sort({_SHINGLES.format("t")}) as s from (select doc_id, {_LOWER_TOKENS.format("text")} as t from documents where text is not null)) where len(s) > 0 group by s),
x as (select doc_id, len(s) as n, unnest(s) as x from a)
select a, b, round(k / (n + m - k), 9) as similarity from (select l.doc_id as a, r.doc_id as b, l.n as n, r.n as m, count(*) as k from x l join x r on l.x = r.x and l.doc_id < r.doc_id group by all) where k / (n + m - k) >= 0.8 - 1e-9""",
    "near_dup_classes": f"select doc_id, min(doc_id) over (partition by s) as rep from (select doc_id, list_sort({_SHINGLES.format('t')}) as s from (select doc_id, {_LOWER_TOKENS.format('text')} as t from documents where text is not null)) where len(s) > 0",
    "contamination_dual": "with " + ", ".join(
        f"""{n}a as (select sft_id, {_SHINGLES.format("t")} as s from (select sft_id, {_LOWER_TOKENS.format(form.format(own))} as t from sft where {own} is not null)),
{n}b as (select item_id, {_SHINGLES.format("t")} as s from (select item_id, {_LOWER_TOKENS.format(form.format(held))} as t from eval_prompts where {held} is not null)),
{n} as (select sft_id, item_id, round(k / (n + m - k), 9) as s from (select sft_id, item_id, n, m, count(*) as k from (select sft_id, len(s) as n, unnest(s) as x from {n}a) join (select item_id, len(s) as m, unnest(s) as x from {n}b) using (x) group by all) where k / (n + m - k) >= 0.02)"""
        for n, own, held, form in (("p", "idea", "prompt", _NORMAL), ("c", "code", "answer", "trim(regexp_replace(regexp_replace(lower({0}), '#[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))"))
    ) + " select coalesce(p.sft_id, c.sft_id) as sft_id, coalesce(p.item_id, c.item_id) as item_id, p.s as text_similarity, c.s as code_similarity from p full join c on p.sft_id = c.sft_id and p.item_id = c.item_id",
    "shuffled_order": "select doc_id, row_number() over (order by md5('42/' || doc_id), doc_id) as place from documents",
    "trainer_text": "select 'sft' as tab, sft_id as row_id, " + _CONTENT.format("list_concat(coalesce(prompt, []), coalesce(completion, []))", "") + " as text from sft union all select 'cpt', cpt_id, text from cpt",
    "sft_projection": "select filename, python_version, idea, code, trace, expected_output, 'user' as prompt_role, idea as prompt_content, 'assistant' as completion_role, trace || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```' as completion_content from sft",
    "seed_texts": "select '# t-strings: ' || idea || chr(10) || code as text from sft where idea is not null and code is not null",
    "check_partition": "select verdict_id, sft_id, coalesce(passed, false) as kept from verdicts",
    "passed_share": "select attempt, printf('%.4f', 100.0::double * count(*) filter (passed) / count(*)) as share from verdicts group by attempt",
    "check_counts": "select count(*) as total, count(*) filter (passed) as kept, count(*) - count(*) filter (passed) as failed from verdicts",
    "message_pairs": "select sft_id, 'user' as first_role, 'assistant' as second_role, idea as asked, code as replied from sft",
    "seed_patterns": "select name, category, p.k::int as pattern_no, p.pattern as pattern from source_catalogue cross join (values (0, 'explain'), (1, 'rewrite'), (2, 'test')) p(k, pattern)",
    "first_rows": "(select doc_id::varchar as name from documents order by doc_id limit 25) union all select name from source_catalogue",
    "token_counts": f"select doc_id, len(t) as n_tokens from ({_DOCS})",
    "token_windows": f"select doc_id, \"window\", array_to_string(x, ' ') as tokens from ({_WINDOWS})",
    "tail_windows": f"with {_TAILS} select doc_id, m.kind as kind, array_to_string(m.x, ' ') as tokens from tails where m is not null",
    "truncate_seq": f"select doc_id, array_to_string(list_slice(t, 1, 256), ' ') as tokens from ({_DOCS})",
    "ffd_pack": f"{_FFD} select f.doc_id, f.n, p.bin from fill p join frags f using (k)",
    "packed_sequences": f"""{_FFD},
bins as (select p.bin, array_to_string(list(case when f.rank = 1 then array_to_string(f.x, ' ') else '<eos> ' || array_to_string(f.x, ' ') end order by f.k), ' ') as tokens
  from fill p join (select g.k, t.m.x as x, row_number() over (partition by q.bin order by g.k) as rank from frags g join tails t using (doc_id) join fill q using (k)) f using (k) group by p.bin)
select 0::bigint as part, doc_id as document, "window"::bigint as ordinal, array_to_string(x, ' ') as tokens from ({_WINDOWS})
union all select 0, doc_id, null, array_to_string(m.x, ' ') from tails where m.kind = 'window'
union all select 1, null, bin, regexp_replace(regexp_replace(tokens, ' +', ' ', 'g'), ' $', '') from bins""",
    "train_eval_split": "select doc_id, case when row_number() over (order by md5('42' || doc_id), doc_id) <= ceil(0.1::double * count(*) over ()) then 'eval' else 'train' end as split from documents",
    "step_plan": "select coalesce(kind, 'none') as kind, count(*) as n_rows, (ceil(count(*) / 32) * 3)::bigint as steps from documents group by 1",
    "dataset_manifest": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("documents", "cpt", "sft", "verdicts", "source_catalogue", "eval_prompts")),
    "log_normalise": f"select doc_id, array_to_string(list_filter(list_transform(list_slice(l, 1, len(l) - 1), lambda x: string_split(x, chr(13))[-1]), lambda x: not contains(x, chr(27)) and trim(x, {_WS}) <> ''), chr(10)) as log "
    "from (select doc_id, string_split('10%' || chr(13) || '50%' || chr(13) || 'done' || chr(10) || chr(27) || '[1mred' || chr(27) || '[0m' || chr(10) || text, chr(10)) as l from documents where text is not null)",
    "log_chunks": f"select stream, unnest(range(0, len(k))) as line_no, unnest(k) as line from (select stream, list_filter(list_transform(list_slice(l, 1, len(l) - 1), lambda x: string_split(x, chr(13))[-1]), lambda x: not contains(x, chr(27)) and trim(x, {_WS}) <> '') as k "
    "from (select source as stream, string_split(string_agg(text, '' order by doc_id), chr(10)) as l from (select doc_id, text, coalesce(source, 'none') as source from documents where text is not null) group by source))",
    "schema_gate": "select event_id, form, coalesce(case when json_valid(p) then json_type(p::json, '$.k') in ('UBIGINT', 'BIGINT') end, false) as fits from (select event_id, unnest([0, 1, 2])::bigint as form, unnest([props, regexp_replace(props, ': (\\d+)', ': \"\\1\"'), replace(props, '}', '')]) as p from events)",
    "exact_dups": "select md5(text) as text_md5, count(*) as n, min(doc_id) as first_id from documents where text is not null group by text having count(*) > 1",
    "first_by_key": "select sft_id, attempt, min(verdict_id) as verdict_id from verdicts group by sft_id, attempt",
    "contamination_exact": "select doc_id, item_id from documents join eval_prompts on contains(text, prompt) where length(prompt) > 0",
    "contamination_shingle": f"""with a as (select doc_id, {_SHINGLES.format("t")} as s from (select doc_id, {_LOWER_TOKENS.format("text")} as t from documents where text is not null)),
b as (select item_id, {_SHINGLES.format("t")} as s from (select item_id, {_LOWER_TOKENS.format("prompt")} as t from eval_prompts))
select doc_id, item_id, round(k / (n + m - k), 9) as similarity from (select doc_id, item_id, n, m, count(*) as k from
  (select doc_id, len(s) as n, unnest(s) as x from a) join (select item_id, len(s) as m, unnest(s) as x from b) using (x) group by all) where k / (n + m - k) >= 0.02""",
    "memorization_rate": f"with w as (select {_NORMAL.format('prompt')} as k from eval_prompts), d as (select distinct {_NORMAL.format('text')} as k from documents) select count(*) as n_items, count(d.k) as n_found, count(d.k) / count(*) as rate from w left join d on w.k = d.k where w.k <> ''",
    "decontaminated": f"select sft_id, idea from sft where coalesce({_NORMAL.format('idea')}, '') not in (select {_NORMAL.format('prompt')} from eval_prompts where prompt is not null)",
    "eval_pass_rate": "select attempt, n, p as n_passed, round(p / n, 9) as rate, case when p = 0 then round(least(1.0, 3.0 / n), 9) end as upper_bound from (select attempt, count(*) as n, sum(coalesce(passed, false)::bigint)::bigint as p from (select distinct on (verdict_id) * from verdicts) group by attempt)",
    "judge_quarantine": f"""with last as (select sft_id, arg_max({{'p': passed}}, {{'a': attempt, 'v': verdict_id, 'p': coalesce(passed, false)}}).p as passed from verdicts group by sft_id)
select sft_id, same or coalesce(passed, false) as kept, case when same then expected_output when coalesce(passed, false) then trace end as output
from (select s.sft_id, coalesce(trim(trace, {_WS}) = trim(expected_output, {_WS}), false) as same, passed, expected_output, trace from sft s left join last using (sft_id))""",
    "worker_grid": "select n as workers, floor(sqrt(n))::bigint as n_rows, n // floor(sqrt(n))::bigint as n_columns from range(1, 201) t(n)",
    "source_catalogue": "select target_version, 'input/' || category || '/' || name || '.rst' as destination, url from source_catalogue where target_version is not null",
    "foreign_imports": "with lines as (select sft_id, unnest(string_split_regex(code, '[;\\n]')) as line from sft where code is not null), "
    "named as (select sft_id, unnest(string_split(regexp_extract(line, '^[ \\t]*import[ \\t]+(.+)$', 1), ',')) as name from lines union all select sft_id, regexp_extract(line, '^[ \\t]*from[ \\t]+([A-Za-z_][A-Za-z0-9_.]*)[ \\t]+import', 1) from lines), "
    "tops as (select distinct sft_id, regexp_extract(trim(name), '^[A-Za-z_][A-Za-z0-9_]*') as module from named) "
    f"select sft_id, module from tops where module <> '' and module not in ({', '.join(repr(m) for m in sorted(sys.stdlib_module_names))})",
    "on_target": "select sft_id, regexp_matches(code, '(?:^|[^A-Za-z0-9_''\"])[tT][rR]?[''\"]|(?:^|[^A-Za-z0-9_''\"])[rR][tT][''\"]') as on_target from sft where code is not null",
    "missing_provenance": " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null or trim({c}, {_WS}) = '') as missing from sft" for c in ("filename", "python_version", "idea")),
    "diversity": f"""with r as (select coalesce(kind, 'none') as kind, {_SHINGLES.format("t")} as s from (select kind, {_LOWER_TOKENS.format("text")} as t from documents where text is not null))
select kind, count(*) as n_rows, sum(len(s))::bigint as n_shingles, (select count(distinct x) from (select unnest(q.s) as x from r q where q.kind = r.kind)) as n_distinct from r group by kind""",
    "file_names": "select distinct filename, string_split(filename, '/')[-1] as base_name, regexp_replace(filename, '\\.rst$', '.md') as as_markdown from cpt where filename is not null",
    "indent_display": "select sft_id, array_to_string(list_transform(string_split(code, chr(10)), lambda x: case when trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' then '  ' || x else x end), chr(10)) as shown from sft where code is not null",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
