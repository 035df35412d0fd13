"""DuckDB SQL for the queries of this subpackage that SQL can express.

Token ids, compression ratios, line rules and sentence models have no SQL; their queries are tested
against brute force, round trips and generated cases.
"""

from __future__ import annotations

#: The 29 whitespace code points in RE2's writing (fixed values).
_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"[\p{L}\p{N}]"

_SHARES = r"""letters as (select row_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}]', '', 'g') as s from corpus),
windows as (select row_id, i, substr(s, i, 30) as w from (select row_id, s, unnest(range(1, length(s) - 28)) as i from letters where length(s) >= 30)),
again as (select row_id, i from (select row_id, i, row_number() over (partition by row_id, w order by i) as k from windows) where k > 1),
covered as (select row_id, sum(least(30, coalesce(later - i, 30))) as n from (select row_id, i, lead(i) over (partition by row_id order by i) as later from again) group by row_id),
shares as (select row_id, length(s)::bigint as n_letters, coalesce(n, 0) / greatest(length(s), 1) as share from letters left join covered using (row_id))"""

_PIECES = rf"""piece as (select distinct doc_sha, chunk_idx, text from chunks where doc_sha is not null and chunk_idx is not null and text is not null),
doc as (select sha, min(text) as row from corpus where sha is not null and text is not null group by sha),
joined as (select p.*, d.row, e.text as before from piece p join doc d on d.sha = p.doc_sha left join piece e on e.doc_sha = p.doc_sha and e.chunk_idx = p.chunk_idx - 1),
fits as (select *, len(list_filter(range(60, 161), lambda n: n <= length(text) and n <= length(before) and substr(text, 1, n) = right(before, n))) > 0 as laps,
  regexp_matches(substr(before, greatest(1, length(before) - 159), greatest(0, least(100, length(before) - 60))), '[{_SPACE}]') as roomy from joined),
told as (select doc_sha, chunk_idx, text, any_value(row) as row, count(before) as n_before, bool_or(coalesce(laps, false)) as laps, bool_or(coalesce(roomy, false)) as roomy from fits group by doc_sha, chunk_idx, text)"""

_PAIRS = rf"""word as (select row_id, text, regexp_extract_all(lower(text), '{_WORD}+') as w from corpus where text is not null),
gram as (select row_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from word where len(w) > 2),
size as (select row_id, count(*) as n from gram group by row_id),
met as (select a.row_id as a, b.row_id as b, count(*) as c from gram a join gram b on a.g = b.g and a.row_id < b.row_id group by all),
pair as (select a as row_id_a, b as row_id_b from met join size x on x.row_id = a join size y on y.row_id = b where 10 * c >= 6 * (x.n + y.n - c)
  union select a.row_id, b.row_id from word a join word b on a.text = b.text and a.row_id < b.row_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_SHARES} select row_id from shares where share >= 0.3",
        "p1_shares": f"with {_SHARES} select row_id, n_letters, round(share, 9) as repeated_share from shares",
        "p2_found": rf"""with {_PIECES} select distinct doc_sha, chunk_idx::int as chunk_idx from told where length(text) > 900 or text = '' or strpos(row, text) = 0
or (chunk_idx > 0 and (n_before = 0 or not laps))
or (regexp_matches(text, '{_WORD}$') and regexp_matches(substr(text, 161), '[{_SPACE}]') and not regexp_matches(row, regexp_escape(text) || '([^\p{{L}}\p{{N}}]|$)'))
or (chunk_idx > 0 and roomy and regexp_matches(text, '^{_WORD}') and not regexp_matches(row, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(text)))""",
        "p3_words": rf"""with told as (select row_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}+') as v from corpus),
n as (select row_id, length(t)::bigint as n_chars_true, len(w)::bigint as word_count, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as inside, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) as solid,
  len(list_filter(v, lambda x: list_contains(known_words, x))) as known from told, (select list(lower(word)) as known_words from common_words where word is not null))
select row_id, n_chars_true, word_count, round(inside / greatest(word_count, 1), 6) as mean_word_length, round((solid - inside) / greatest(solid, 1), 6) as symbol_ratio, round(known / greatest(word_count, 1), 6) as common_word_share from n""",
        "p4_found": f"with {_PAIRS} select row_id_a, row_id_b from pair",
        "p4_groups": f"""with recursive {_PAIRS}, edge as (select row_id_a as a, row_id_b as b from pair union all select row_id_b, row_id_a from pair),
reach as (select row_id as a, row_id as b from word union select r.a, edge.b from reach r join edge on edge.a = r.b)
select w.row_id, (select min(o.row_id) from word o where o.text = w.text) as class_id, (select min(b) from reach where reach.a = w.row_id) as group_id, (select count(*) from edge where edge.a = w.row_id) as n_links from word w""",
    }
