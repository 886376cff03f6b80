"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP4 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from words where len(w) > 0)),
size as (select doc_id, count(*) n from sh group by all),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select x, y from links union select y, x from links),
reach(x, y) as (select distinct x, x from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
root as (select x doc_id, min(y) component_id from reach group by all)
select d.doc_id, coalesce(s.n, 0) n_shingles, coalesce(r.component_id, d.doc_id) component_id
from documents d left join size s using (doc_id) left join root r using (doc_id)
"""


OP7 = r"""
with convs as (
  select conv_id, list({turn: cast(turn as bigint), role: role, text: text} order by turn, role, text) turns
  from conversations where conv_id is not null group by conv_id),
ends as (select *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) k from convs),
other as (select xor(conv_id, 1) conv_id, turns[k].text other, true found from ends where k > 0),
sides as (
  select conv_id, turns c,
    case when k = 0 then turns
         when found then list_concat(turns[1 : k - 1], [{turn: turns[k].turn, role: 'assistant', text: other}])
         else turns[1 : k - 1] end r
  from ends left join other using (conv_id)),
lcp as (
  select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1),
      lambda i: c[i].role is distinct from r[i].role or c[i].text is distinct from r[i].text)) - 1, least(len(c), len(r))) n
  from sides),
parts as (select conv_id, n, c[1 : n] p, c[n + 1 :] c, r[n + 1 :] r from lcp),
said as (
  select conv_id, n, part, i,
    '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) head, coalesce(t.text, '') || '<|end|>' || chr(10) body, coalesce(t.role, '') = 'assistant' a
  from (select conv_id, n, 'p' part, unnest(p) t, unnest(range(1, len(p) + 1)) i from parts
        union all select conv_id, n, 'c', unnest(c), unnest(range(1, len(c) + 1)) from parts
        union all select conv_id, n, 'r', unnest(r), unnest(range(1, len(r) + 1)) from parts)),
placed as (select *, sum(length(head) + length(body)) over (partition by conv_id, part order by i) - length(head) - length(body) pos from said),
text as (
  select conv_id, part, string_agg(head || body, '' order by i) txt,
    string_agg(cast(pos as varchar) || '-' || cast(pos + length(head) as varchar) || ':0,' || cast(pos + length(head) as varchar) || '-'
      || cast(pos + length(head) + length(body) as varchar) || case when a then ':1' else ':0' end, ',' order by i) mask
  from placed group by conv_id, part)
select conv_id, cast(n as bigint) n_prompt, coalesce(p.txt, '') prompt, coalesce(c.txt, '') chosen, coalesce(r.txt, '') rejected,
  coalesce(c.mask, '') chosen_mask, coalesce(r.mask, '') rejected_mask
from parts left join (select * from text where part = 'p') p using (conv_id)
  left join (select * from text where part = 'c') c using (conv_id) left join (select * from text where part = 'r') r using (conv_id)
"""

OP8 = r"""
with docs as (
  select doc_id, coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n_tokens, regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) num
  from documents),
named as (select doc_id, case when num = '' then 'unknown' else 'd' || cast(cast(num as int) % 4 as varchar) end as "domain", lang, source, n_tokens from docs where n_tokens > 0),
leaf as (select "domain", lang, source, cast(sum(n_tokens) as bigint) tokens, cast(sum(n_tokens) * 2 as bigint) cap from named group by all),
d0 as (select "domain", cast(sum(cap) as bigint) cap, (select cast(floor(sum(tokens) * 0.8::double) as bigint) from leaf) budget,
  case "domain" when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 when 'd3' then 1 else 1 end w from leaf group by all),
d1 as (select *, coalesce(sum(cap) over (order by cap / w, "domain" rows between unbounded preceding and 1 preceding), 0) before,
  sum(w) over (order by cap / w, "domain" rows between current row and unbounded following) rest from d0),
d2 as (select *, cap * rest <= (budget - before) * w as filled from d1),
d3 as (select "domain", case when filled then cap else ((budget - sum(case when filled then cap else 0 end) over ()) * w)
  // greatest(sum(case when filled then 0 else w end) over (), 1) end budget from d2),
l0 as (select "domain", lang, cast(sum(cap) as bigint) cap, case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 1 else 1 end w from leaf group by all),
l1 as (select *, coalesce(sum(cap) over (partition by "domain" order by cap / w, lang rows between unbounded preceding and 1 preceding), 0) before,
  sum(w) over (partition by "domain" order by cap / w, lang rows between current row and unbounded following) rest from l0 join d3 using ("domain")),
l2 as (select *, cap * rest <= (budget - before) * w as filled from l1),
l3 as (select "domain", lang, case when filled then cap else ((budget - sum(case when filled then cap else 0 end) over (partition by "domain")) * w)
  // greatest(sum(case when filled then 0 else w end) over (partition by "domain"), 1) end budget from l2),
s1 as (select *, 1 w, coalesce(sum(cap) over (partition by "domain", lang order by cap, source rows between unbounded preceding and 1 preceding), 0) before,
  count(*) over (partition by "domain", lang order by cap, source rows between current row and unbounded following) rest from leaf join l3 using ("domain", lang)),
s2 as (select *, cap * rest <= (budget - before) as filled from s1),
s3 as (select "domain", lang, source, tokens, cast(case when filled then cap else (budget - sum(case when filled then cap else 0 end) over (partition by "domain", lang))
  // greatest(sum(case when filled then 0 else 1 end) over (partition by "domain", lang), 1) end as bigint) budget from s2),
keyed as (select n.*, budget // tokens epochs, budget % tokens remain, md5('17|' || cast(budget // tokens as varchar) || '|' || cast(doc_id as varchar)) k
  from named n join s3 using ("domain", lang, source)),
cum as (select *, sum(n_tokens) over (partition by "domain", lang, source order by k) upto from keyed),
times as (select *, epochs + case when upto <= remain then 1 else 0 end t from cum)
select doc_id, "domain", lang, source, cast(n_tokens as bigint) n_tokens, cast(unnest(range(0, t)) as bigint) epoch from times where t > 0
"""

OP11 = r"""
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id anchor_id, b.vec_id id, a.l = b.l same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) score
  from sound a join sound b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, id positive_id, score positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank, id negative_id, positive_score, score negative_score
from pos join scored using (anchor_id) where not same and 100 * score between 30 * positive_score and 90 * positive_score qualify rank <= 10
"""

OP13 = r"""
with units as (
  select doc_id, coalesce(text, '') txt, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
hashed as (
  select doc_id, txt, u, cast(len(u) as bigint) n, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2, cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when txt = '' or contains(txt, '<P>') or contains(txt, '<S>') or contains(txt, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from hashed),
parts as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:n], '') suf from cut)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end middle_chars,
  sha256(case form when 'plain' then txt when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(txt) restored_sha256
from parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4, "op7_preference_format": OP7, "op8_hierarchical_mix": OP8, "op11_hard_negatives": OP11, "op13_fill_in_middle": OP13}
