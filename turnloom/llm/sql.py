"""SQL (DuckDB dialect) that states in plain form what some of the operators return."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), e as (
  select doc_id, len(s) as n, unnest(s) as g from s
), shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as sizes, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared where 100 * c >= 75 * (sizes - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select distinct a, a as b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a
), least_of as (
  select a as doc_id, min(b) as component from reach group by 1
)
select doc_id, len(s)::bigint as n_shingles, coalesce(component, doc_id) as component_id, doc_id = coalesce(component, doc_id) as kept from s left join least_of using (doc_id)
"""

REPEATS = """
with t as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents
), p as (
  select doc_id, unnest(range(0, n - 99)) as p, h from t where n >= 100
), k as (
  select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as k from p
), again as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from k) where r > 1
), marked as (
  select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as new from again
), islands as (
  select doc_id, min(p) as s, max(p) + 100 as e from (select doc_id, p, sum(new) over (partition by doc_id order by p) as i from marked) group by doc_id, i
), pieces as (
  select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from islands
), cut as (
  select doc_id, sum(e - s) as gone, count(*) as spans, max(e) as last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s) as head
  from pieces join t using (doc_id) group by doc_id
)
select doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from t left join cut using (doc_id)
"""

DECONTAMINATION = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iw as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as g
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from i where len(w) > 0)
), dw as (
  select r, n, p, array_to_string(w[p:p + n - 1], ' ') as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)
), hits as (
  select r, p, n, item_id from dw join iw using (n, g)
), hit_words as (
  select r, count(distinct x) as n_hit from (select r, unnest(range(p, p + n)) as x from (select distinct r, p, n from hits)) group by r
), hit_items as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct r, item_id from hits) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
"""
