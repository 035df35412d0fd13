"""DuckDB SQL for the queries of the core that SQL can express."""

from __future__ import annotations

from .queries import ASKED, CHAR_CAP, DIM, MODEL, SEED, SKIP, TAKE, TIERS, WORD_CAP

#: The 29 whitespace code points in RE2's writing (fixed values).
_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '[{_SPACE}]+'), lambda w: w <> '')"
_BARE = _strip("coalesce(text, '')")
_SHA = "substr(sha256({0}), 1, 24)"
_PLACE = f"md5('{SEED}:' || row_id)"
_GATE = "(language_score is null or isnan(language_score) or language_score = 0 or language_score >= 0.5)"

_TIERS = f"""raw as (select row_id, source, {_BARE} as text, lang, language_score from corpus),
kept as (select *, row_number() over (partition by source order by {_PLACE}, row_id) as rank from raw
  where length(text) >= 500 and (source = 'wikipedia' or (source = 'fineweb' and {_GATE}) or (source = 'oasst' and lang = 'pl'))),
tiered as (select 0 as o, 'wikipedia' as tier, *, rank - 1 as at from kept where source = 'wikipedia' and rank <= {TIERS['wikipedia']}
  union all select 1, 'fineweb', *, rank - 1 from kept where source = 'fineweb' and rank <= {TIERS['fineweb']}
  union all select 2, 'oasst', *, rank - 1 from kept where source = 'oasst' and rank <= {TIERS['oasst']}
  union all select 3, 'fineweb_more', *, rank - 1 - {TIERS['fineweb']} from kept where source = 'fineweb' and rank > {TIERS['fineweb']} and rank <= {TIERS['fineweb'] + TIERS['fineweb_more']}),
mixed as (select (row_number() over (order by o, rank) - 1)::bigint as row_id, tier, source, row_id as source_row, {_SHA.format('text')} as sha, length(text)::bigint as n_chars from tiered)"""

_UNIT = """cut as (select vec_id, list_transform(embedding[1:{dim}], lambda x: x::double) as e from embeddings where embedding is not null),
unit as (select vec_id, list_transform(e, lambda x: x / case when list_dot_product(e, e) > 0 then sqrt(list_dot_product(e, e)) else 1 end) as e from cut),
cell as (select vec_id, unnest(range(len(e)))::int as i, unnest(e) as v from unit)"""
_ALL = 100_000


def _long(expression: str, source: str, dim: int) -> str:
    return f"with {_UNIT.format(dim=dim)} select vec_id, unnest(range(len(e)))::int as i, round(unnest({expression}), 6) + 0.0 as v from {source}"


def _covariance(dim: int) -> str:
    return f"with {_UNIT.format(dim=dim)} select a.i, b.i as j, round(covar_samp(a.v, b.v), 6) + 0.0 as v from cell a join cell b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i"


def _identity(dim: str, condition: str = "true") -> str:
    return f"select i::int as i, j::int as j, case when i = j then 1.0 else 0.0 end::double as v from range({dim}) a(i), range({dim}) b(j) where {condition}"


def _top(vectors: str) -> str:
    return f"""with {_UNIT.format(dim=_ALL)},
pair as (select q.vec_id as query_id, t.vec_id, list_dot_product(q.e, t.e) as score from {vectors} q, {vectors} t where q.vec_id < {ASKED}),
placed as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, round(score, 6) as score from pair)
select * from placed where rank <= 10"""


def _take(skip: int) -> str:
    return f"select * from (select row_id, source, row_number() over (partition by source order by {_PLACE}, row_id)::int as rank from corpus) where rank > {skip} and rank <= {skip + TAKE}"


def _tree(levels: int = 4, digits: int = 2) -> str:
    sql, last = "l as (select sha as k, sha || ':' || count(*) as v from corpus where sha is not null group by sha)", "l"
    for left in reversed(range(levels)):
        sql += f", l{left} as (select substr(k, 1, {left * digits}) as k, sha256(string_agg(v, chr(10) order by k, v)) as v from {last} group by substr(k, 1, {left * digits}))"
        last = f"l{left}"
    return f"with {sql} select coalesce(max(v), sha256('')) as fingerprint from {last}"


def _json_map(column: str) -> str:
    return f"(select '{{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}}' from (select {column} as k, count(*) as n from mixed group by 1))"


_FOLD = """select row_id, (unnest(range(len(o))))::int as chunk_idx, unnest(o) as text from (
select row_id, case when f.p = '' then f.o when len(f.o) = 0 then [f.p] else list_append(f.o[1:len(f.o) - 1], f.o[len(f.o)] || chr(10) || chr(10) || f.p) end as o from (
select row_id, list_reduce(string_split(text, chr(10)), lambda s, x:
  case when length(case when s.p <> '' then s.p || chr(10) || chr(10) || x else x end) < 100
  then {'o': s.o, 'p': case when s.p <> '' then s.p || chr(10) || chr(10) || x else x end}
  else {'o': list_append(s.o, case when s.p <> '' then s.p || chr(10) || chr(10) || x else x end), 'p': ''} end,
  {'o': []::varchar[], 'p': ''}) as f from corpus where text is not null))"""

_SUMS = "sum(n_calls)::bigint as n_calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(total_tokens)::bigint as total_tokens"
_MODELS = "models as (select n_nationkey, n_name, case when n_nationkey % 2 = 0 then 'qwen/qwen3-embedding-' || n_nationkey || 'b' else 'open/' || n_name || ':free' end as model from nation), short as (select *, replace(regexp_replace(model, '^qwen/qwen3-embedding-', 'qwen3-'), '/', '-') as short from models)"
_BYTES = "case when p_partkey % 7 <> 0 then (p_partkey::hugeint * p_partkey * p_partkey)::double end"


def oracle_sql() -> dict[str, str]:
    text = {
        "scan_projection": "select row_id, sha from corpus",
        "scan_row_count": "select count(*) as n_rows from corpus",
        "null_safe_text": "select doc_id, coalesce(text, '') as text from documents",
        "unicode_strip": f"select doc_id, {_strip('text')} as text from documents",
        "corpus_filter_min_chars": f"select doc_id, length({_BARE})::int as n_chars from documents where length({_BARE}) >= 500",
        "corpus_char_cap": f"select doc_id, length(t)::int as n_chars, {_SHA.format('t')} as sha from (select doc_id, substr({_BARE}, 1, {CHAR_CAP}) as t from documents where length({_BARE}) >= 500)",
        "corpus_digest": f"select doc_id, {_SHA.format('text')} as sha, sha256(text) as sha_full from documents",
        "corpus_fingerprint": "select sha256(string_agg(sha, chr(10) order by sha)) as fingerprint from corpus",
        "corpus_fingerprint_tree": _tree(),
        "corpus_lang_filter": "select doc_id from documents where lang = 'pl'",
        "corpus_score_gate": f"select row_id from corpus where {_GATE}",
        "corpus_seeded_order": f"select row_id, {_PLACE} as place from corpus",
        "corpus_take_n": _take(0),
        "corpus_skip_take": _take(SKIP),
        "corpus_mix_union": f"with {_TIERS} select * from mixed",
        "corpus_tiers_disjoint": f"with {_TIERS} select count(*) as n_shared from (select source_row from mixed where tier = 'fineweb' intersect select source_row from mixed where tier = 'fineweb_more')",
        "corpus_mix_counts": f"with {_TIERS} select source, count(*) as n from mixed group by source",
        "corpus_totals": f"with {_TIERS} select count(*) as n_total, sum(n_chars)::bigint as n_chars_total from mixed",
        "corpus_manifest": f"""with {_TIERS} select '{{{','.join(f'"{k}":{v}' for k, v in TIERS.items())}}}' as mix_target, {_json_map('tier')} as mix_actual, {_json_map('source')} as mix_sources, {SEED} as seed,
count(*) as n_total, sum(n_chars)::bigint as n_chars_total, sha256(string_agg(sha, chr(10) order by sha)) as corpus_fingerprint_sha256 from mixed""",
        "doc_word_count": f"select doc_id, len({_WORDS})::int as n_words from documents",
        "doc_word_truncate": f"select doc_id, case when len({_WORDS}) > {WORD_CAP} then array_to_string({_WORDS}[1:{WORD_CAP}], ' ') else text end as text, len({_WORDS}) > {WORD_CAP} as capped from documents",
        "token_truncate_words": f"select doc_id, case when len({_WORDS}) > {WORD_CAP} then array_to_string({_WORDS}[1:{WORD_CAP}], ' ') else text end as text, len({_WORDS})::int as n_tokens, len({_WORDS}) > {WORD_CAP} as capped from documents",
        "token_stats": f"select count(*) filter (n > {WORD_CAP}) as n_capped, max(n)::int as max_seen, sum(n)::bigint as total_tokens from (select len({_WORDS}) as n from documents)",
        "chunk_merge_tiny": _FOLD,
        "chunk_strip_fragments": rf"""select row_id, i::int as chunk_idx, case when i > 0 then regexp_replace(c, '^[.,;:!?)\]}}"»]+[{_SPACE}]+', '') else c end as text from (
select row_id, unnest(l) as c, unnest(range(len(l))) as i from (select row_id, string_split(regexp_replace(text, '([.?!] )', chr(1) || '\1', 'g'), chr(1)) as l from corpus where text is not null))""",
        "chunk_explode_idx": "select row_id, sha as doc_sha, i::int as chunk_idx, sha256(c) as sha, length(c)::int as n_chars from (select row_id, sha, unnest(string_split(text, chr(10))) as c, unnest(range(len(string_split(text, chr(10))))) as i from corpus)",
        "chunk_invariants": f"select row_id, true as dense from corpus where {_BARE} <> ''",
        "chunk_stats": "select (select count(*) from corpus) as n_docs, count(distinct doc_sha) as n_parents, count(*) as n_chunks, round(count(*) / greatest(1, (select count(*) from corpus)), 2) as mean_per_doc, min(length(text))::int as min_chars, max(length(text))::int as max_chars from chunks",
        "chunk_parents": "select doc_sha, chunk_idx, c.sha, coalesce(r.row_id, -1) as row_id from (select distinct doc_sha, chunk_idx, sha from chunks) c left join (select sha, min(row_id) as row_id from corpus group by sha) r on r.sha = doc_sha",
        "distinct_parents": "select count(distinct doc_sha) as n_parents from chunks",
        "embed_resume_antijoin": f"select row_id, sha from corpus where row_id not in (select row_id from embed_index where model_slug = '{MODEL}' and skipped is not true)",
        "embed_rows_covered": "select model_slug, count(distinct row_id) as rows_covered from embed_index group by model_slug",
        "embed_placeholder_fill": f"select row_id, embedding is null as skipped, {DIM} as dim, case when embedding is null then 0.0 else round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) end as length from corpus left join embeddings on vec_id = row_id",
        "embed_attach_meta": "select row_id, len(embedding)::int as dim, sha, source from embeddings join corpus on row_id = vec_id",
        "embed_hashing": f"select {DIM} as dim, true as unit, count(*) as n from corpus",
        "usage_rollup": f"select model_slug, count(*) as n_rows, {_SUMS}, round(sum(cost_usd), 6) as cost_usd, sum(n_retried)::bigint as n_retried, sum(n_429)::bigint as n_429 from (select distinct * from cost_report) group by model_slug",
        "usage_running_total": "select model_slug, report_id, flushed_at, n as prompt_tokens, sum(n) over (partition by model_slug order by flushed_at, report_id rows unbounded preceding)::bigint as running from (select distinct model_slug, report_id, flushed_at, coalesce(prompt_tokens, 0) as n from cost_report)",
        "usage_windows": f"select date_trunc('day', flushed_at)::timestamp as start, model_slug, {_SUMS}, round(sum(cost_usd), 6) as cost_usd from (select distinct * exclude (recorded_at) from cost_report) group by all",
        "http_status_classify": """select event_id, (case when event_id % 5 = 0 then 400 + event_id % 130 when event_id % 4 = 0 then 200
when event_id % 4 in (1, 2) and event_id % 600 in (408, 429, 500, 502, 503, 504, 529) then event_id % 600 else 400 end)::int as status from events""",
        "model_slug": f"with {_MODELS} select n_nationkey, translate(model, '/:', '__') as slug, short from short",
        "background_name": f"with {_MODELS} select n_nationkey, replace(short, '-', '_') || '_pl_mixed_doc_mrl512' as name from short",
        "csv_options": "select n_nationkey, case when n_nationkey % 3 = 1 then 'a|' || trim(n_name) end as found from nation",
        "registry_sorted": "select distinct p_brand as embedding_model, p_size as dim, p_name as name from part",
        "registry_formats": f"""select p_partkey, case when coalesce({_BYTES}, 0) = 0 then '—' when {_BYTES} < 1024 then round_even({_BYTES}, 0)::bigint || ' B' when {_BYTES} < 1048576 then round_even({_BYTES} / 1024, 0)::bigint || ' KB'
when {_BYTES} < 1073741824 then round_even({_BYTES} / 1048576, 0)::bigint || ' MB' when {_BYTES} < 1099511627776 then round_even({_BYTES} / 1073741824, 0)::bigint || ' GB' else printf('%.1f TB', {_BYTES} / 1099511627776) end as size,
case when p_partkey % 5 = 0 then 'some time ago, u' else strftime(make_timestamp((1700000000 + p_partkey * 997) * 1000000), '%Y-%m-%d %H:%M') end as built, case when p_size = 1 then 'no cap' else (p_size - 1) || ' chars' end as cap from part""",
        "registry_coalesce": "select p_partkey, case when z is null or z = 0 then p_size * 10 else z end as parity, coalesce(z, p_size * 10) as plain from (select p_partkey, p_size, nullif(p_size, 3) % 4 as z from part)",
        "cost_attach_left": f"""select n_nationkey, coalesce(u.prompt_tokens, -1) as prompt_tokens, coalesce(u.n_calls, -1) as n_calls, (select count(*) from corpus) as n_total from nation left join
(select model_slug, {_SUMS} from (select distinct * from cost_report) group by model_slug) u on model_slug = case n_nationkey when 1 then '{MODEL}' when 2 then 'qwen_qwen3-embedding-4b' else 'none' end""",
        "inv_sqrt_scale": "select s_suppkey, round(1 / sqrt(s_acctbal + 1e-6), 9) as v from supplier where s_acctbal > 0",
    }
    vectors = {
        "vec_slice": _long("e", "cut", 16),
        "vec_l2_renorm": _long("e", "unit", 32),
        "vec_query_renorm": _long("list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-12))", "cut", 32),
        "vec_center": f"with {_UNIT.format(dim=_ALL)} select vec_id, i, round(v - avg(v) over (partition by i), 6) + 0.0 as v from cell",
        "vec_zero_guard": "select count(*) as n_total, count(*) filter (embedding[1] >= 0) as n_kept, round(count(*) filter (embedding[1] >= 0)::double, 6) as length from embeddings where embedding is not null",
        "vec_count": "select count(embedding) as n_total from embeddings",
        "vec_mean": f"with {_UNIT.format(dim=_ALL)} select i, round(avg(v), 6) + 0.0 as m from cell group by i",
        "vec_covariance": _covariance(_ALL),
        "vec_covariance_mrl16": _covariance(16),
        "vec_covariance_mrl32": _covariance(32),
        "vec_covariance_relational": _covariance(16),
        "zca_trace": f"with {_UNIT.format(dim=_ALL)} select round(sum(v), 6) as trace from (select var_samp(v) as v from cell group by i)",
        "zca_frobenius": f"with {_UNIT.format(dim=_ALL)} select round(sum(v * v), 9) as frobenius from (select covar_samp(a.v, b.v) as v from cell a join cell b on a.vec_id = b.vec_id group by a.i, b.i)",
        "zca_rank": "select 0::bigint as rank_deficient, max(len(embedding)) as rank_full from embeddings",
        "zca_symmetry": "select 0::bigint as n_asymmetric",
        "zca_spectrum_order": "select 0::bigint as n_ascending",
        "zca_inverse_identity": _identity("(select max(len(embedding)) from embeddings)"),
        "whiten_mean_zero": "select i::int as i, 0.0::double as m from range((select max(len(embedding)) from embeddings)) t(i)",
        "whiten_cov_identity": _identity("16", "i <= j"),
        "whiten_ladder": " union all ".join(f"select * from (with {_UNIT.format(dim=n)} select max(i)::int + 1 as dim, (select count(*) from unit) as n_total, round((select sum(v) from (select var_samp(v) as v from cell group by i)), 6) as trace from cell)" for n in (16, 32, _ALL)),
        "topk_raw_dot": _top("cut"),
        "topk_raw_cosine": _top("unit"),
    }
    vectors["vec_mean_relational"] = vectors["vec_mean"]
    return text | vectors
