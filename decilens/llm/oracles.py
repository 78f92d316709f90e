"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_NEAR = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) end s from words),
grams as (select doc_id, len(s) n, unnest(s) g from sets),
links as (
  select a.doc_id x, b.doc_id y from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach(node, top) as (
  select doc_id, doc_id from documents
  union
  select e.y, r.top from reach r join both_ways e on e.x = r.node where r.top < e.y),
least as (select node, min(top) component_id from reach group by node)
select s.doc_id, len(s.s)::bigint n_shingles, l.component_id, s.doc_id = l.component_id kept from sets s join least l on l.node = s.doc_id
"""

_CHAT = """
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) p from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(r := role, x := text) order by p) l from t group by conv_id),
kept as (
  select conv_id, len(l) n from c a where not exists (
    select 1 from c b where (len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l) or (b.l = a.l and b.conv_id < a.conv_id)))
select conv_id, p as "position", n::bigint n_turns, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || trim(coalesce(text, '')) || chr(10) || '<|end|>' || chr(10) segment
from t join kept using (conv_id)
"""

_QUALITY = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l from documents),
grams as (
  select doc_id, i, array_to_string(w[i:i+4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)),
again as (select doc_id, g from grams group by all having count(*) > 1),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from grams join again using (doc_id, g)) group by doc_id),
base as (
  select w.doc_id, lang, source, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
    coalesce(c.n, 0)::bigint n_repeat_words, len(l)::bigint n_lines
  from w left join covered c using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base),
each_ as (
  select doc_id, lang, source, base_failed,
    unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'word_chars', 'n_lines', 'n_words']) metric,
    unnest([case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end, case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end,
            case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end, case when n_words > 0 then word_chars * 100 // n_words else 0 end,
            word_chars, n_lines, n_words]) v from judged),
bucketed as (select *, (v >> greatest(length(bin(v)) - 6, 0)::bigint) << greatest(length(bin(v)) - 6, 0)::bigint b from each_),
passing as (select lang, source, metric, b from bucketed where not base_failed),
own as (select lang, source, metric, count(*) n, quantile_disc(b, [0.25, 0.5, 0.75]) q from passing group by all),
by_lang as (select lang, metric, count(*) n, quantile_disc(b, [0.25, 0.5, 0.75]) q from passing group by all),
by_all as (select metric, quantile_disc(b, [0.25, 0.5, 0.75]) q from passing group by all),
picked as (
  select o.lang, o.source, o.metric, case when o.n >= 100 then o.q when l.n >= 100 then l.q else a.q end q
  from own o join by_lang l on l.metric = o.metric and l.lang is not distinct from o.lang join by_all a on a.metric = o.metric),
one_event as (
  select p.lang, p.source, e.metric, e.adds / greatest(p.q[2], 1)::double step from picked p
  join (values ('symbols', 'word_chars', 1000::double), ('dup_lines', 'n_lines', 1000::double), ('repeats', 'n_words', 10000::double), ('word_length', 'n_words', 100::double)) e(metric, size, adds) on e.size = p.metric),
room as (
  select p.lang, p.source, p.metric, p.q[1] q1, p.q[3] q3, 3::double * greatest((p.q[3] - p.q[1])::double, e.step, (1::bigint << greatest(length(bin(p.q[3])) - 6, 0)::bigint)::double) room
  from picked p join one_event e on e.metric = p.metric and e.lang is not distinct from p.lang and e.source is not distinct from p.source),
verdict as (
  select e.doc_id, bool_and(coalesce(e.b between case when e.metric = 'word_length' then r.q1 - r.room else 0 end and r.q3 + r.room, false)) ok from (select * from bucketed where metric not in ('word_chars', 'n_lines', 'n_words')) e
  left join room r on r.metric = e.metric and r.lang is not distinct from e.lang and r.source is not distinct from e.source group by e.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok kept from judged join verdict using (doc_id)
"""

ORACLES = {"op1_minhash_dedup": _NEAR, "op3_adaptive_quality": _QUALITY, "op5_snapshot_collapse": _CHAT}
