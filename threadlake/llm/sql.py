"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def _round(k: int) -> str:
    """One assignment to the centroids c<k>, and the centroids c<k+1> after it."""
    return f"""
d{k} as (
  select x.rid, c.c, sum((x.x - c.x) * (x.x - c.x)) as d
  from comp x join c{k} c on x.i = c.i group by all),
a{k} as (select rid, d, c from d{k} qualify row_number() over (partition by rid order by d, c) = 1),
s{k} as (select a.c, x.i, sum(x.x)::bigint as s, count(*) as n from a{k} a join comp x using (rid) group by all),
c{k + 1} as (
  select c.c, c.i, case when s.n is null then c.x else (s.s - (((s.s % s.n) + s.n) % s.n)) // s.n end as x
  from c{k} c left join s{k} s on s.c = c.c and s.i = c.i)"""


CENTROIDS = f"""
with kept as (
  select row_number() over () as rid, vec_id,
    list_transform(embedding, lambda x: case when isfinite(x) then floor(64 * x::double)::bigint end) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
comp as (select rid, unnest(range(1, 65)) as i, unnest(v) as x from kept),
first as (
  select rid, row_number() over (order by sha256('1:' || vec_id::varchar), v) - 1 as c
  from kept qualify c < 16),
c0 as (select f.c, x.i, x.x from first f join comp x using (rid)),
{_round(0)},
{_round(1)},
{_round(2)},
{_round(3)},
digest as (select c, sha256(string_agg(x::varchar, ',' order by i)) as h from c3 group by c),
own as (select c, sum(d)::bigint as s from a3 group by c)
select k.vec_id, a.c::integer as cluster, a.d::bigint as distance, own.s as cluster_inertia,
  (select sum(s)::bigint from own) as inertia, digest.h as centroid_sha256
from a3 a join kept k using (rid) join own on own.c = a.c join digest on digest.c = a.c
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from lists, (values (1), (2), (3)) as ks(k)),
c as (select lang, k, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from c where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from c where k > 1 and f >= 10),
around as (
  select lang, phrase, max(f) as f from (
    select lang, ws[1] || ' ' || ws[2] as phrase, a as f from cand where k = 3
    union all select lang, ws[2] || ' ' || ws[3], a from cand where k = 3) group by all),
cuts as (
  select d.*, j, array_to_string(ws[1:j], ' ') as lp, array_to_string(ws[j + 1:], ' ') as rp
  from cand d, (values (1), (2)) as js(j) where j < d.k),
scored as (
  select u.lang, u.phrase, u.a, u.j, x.f as l, y.f as r,
    (1000000::hugeint * u.a * u.a) // (x.f::hugeint * y.f) as score
  from cuts u join c x on x.lang = u.lang and x.phrase = u.lp join c y on y.lang = u.lang and y.phrase = u.rp),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank, s.phrase, a, l, r, score
  from least s left join around m on m.lang = s.lang and m.phrase = s.phrase
  where m.f is null or 100 * m.f < 50 * a)
select lang, rank, phrase, a, l, r, n.n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base 32 of a SHA-1: five hexadecimal digits are four characters.
_BASE32 = "list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::integer, 1))"

REVISITS = f"""
with p as (select page_id, url, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
r as (select *, max(page_id) over (partition by h, n) as lead from p)
select page_id, n::bigint as payload_bytes, array_to_string({_BASE32}, '') as payload_digest,
  case when page_id = lead then 'response' else 'revisit' end as record_type,
  case when page_id <> lead then lead end as refers_to, url
from r
"""

CONTAMINATION = rf"""
with b as (
  select item_id::varchar as item, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
wins as (
  select distinct item, least(13, len(ws)) as k,
    unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) as win
  from b where len(ws) > 0),
d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
places as (
  select rid, k, unnest(range(1, len(ws) - k + 2)) as i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as win
  from d, (select distinct k from wins) as ks),
met as (select p.rid, p.i, p.k, w.item from places p join wins w on w.k = p.k and w.win = p.win),
hit as (select rid, count(distinct j) as n from (select rid, unnest(range(i, i + k)) as j from met) m group by rid),
items as (select rid, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct rid, item from met) m group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(ws) as contaminated
from d left join hit using (rid) left join items using (rid)
"""

#: Documents with equal sets are one class; links between classes, and whatever they reach.
NEAR_GROUPS = rf"""
with recursive d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (
  select rid, doc_id, case when len(ws) >= 5 then list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s
  from d),
signed as (select rid, doc_id, len(s) as n, s, sha256(array_to_string(s, chr(1))) as sig from sets),
classes as (select sig, min(rid) as c, any_value(n) as n, any_value(s) as s, min(doc_id) as least from signed where n > 0 group by sig),
grams as (select c, n, unnest(s) as g from classes),
pairs as (select a.c as a, b.c as b, a.n as na, b.n as nb, count(*) as common from grams a join grams b on a.g = b.g and a.c < b.c and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all),
links as (select a, b from pairs where 100 * common >= 75 * (na + nb - common)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select c as a, c as b from classes union select r.a, e.b from reach r join both_ways e on e.a = r.b),
comp as (select r.a as c, min(k.least) as least from reach r join classes k on k.c = r.b group by r.a)
select s.doc_id, s.n::bigint as n_shingles, case when s.n = 0 then s.doc_id else comp.least end as component_id, case when s.n = 0 then s.doc_id else k.least end as class_id
from signed s left join classes k on k.sig = s.sig and s.n > 0 left join comp on comp.c = k.c
"""
