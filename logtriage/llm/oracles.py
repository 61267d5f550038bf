"""DuckDB SQL for the operators that have one."""

TOPK_SQL = '''
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
'''

WARC_SQL = '''
with p as (select page_id, url, coalesce(html, '') as body from pages),
r as (select page_id, strlen(body) as n, sha256(body) as h, strlen(body) >= 100 and
        row_number() over (partition by body order by page_id nulls last, url) > 1 as again, min(page_id) over (partition by body) as first from p)
select page_id, n::bigint as payload_bytes, h as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  case when again then first end as refers_to, cast(null as varchar) as problem from r
'''

#: CRC-32 by bytes: the table of the reflected polynomial.
CRC = '''crc_table as (select list_transform(range(256), lambda i: list_reduce(range(8),
    lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i)) as t)'''

SPELLING_SQL = f'''
with recursive {CRC},
runs as (select doc_id, run, count(*) as c from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by doc_id, run),
hashed as (select run, c, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
      lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)),
    lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8), 4294967295), 4294967295) as h from runs, crc_table),
words as (select word, sum(c)::bigint as n from (
    select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from hashed)
  where length(word) >= 7 group by word having sum(c) >= 2),
cuts as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select distinct c.word as a, w.word as b from cuts c join words w on w.word = c.rest
  union select distinct w.word, c.word from cuts c join words w on w.word = c.rest
  union select distinct x.word, y.word from cuts x join cuts y on x.rest = y.rest and x.i = y.i and x.word <> y.word),
ranked as (select a, b, n, row_number() over (partition by a order by n desc, b) as k, count(*) over (partition by a) as n_near from near join words on word = b),
formed as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.n >= 10 * w.n then r.b end as form, case when r.n >= 10 * w.n then r.n end as form_n
  from words w left join ranked r on r.a = w.word and r.k = 1),
path as (select word, word as at, form from formed
  union all select p.word, p.form, f.form from path p join formed f on f.word = p.form)
select f.word, f.form, p.at as root, f.n, f.n_near, f.form_n from formed f join path p on p.word = f.word and p.form is null
'''


def _encoded(*columns: str) -> str:
    return ' || '.join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in columns)


MERKLE_SQL = f'''
with recursive {CRC},
d as (select doc_id, lang, sha256({_encoded('doc_id', 'source', 'lang', 'n_chars', 'text')}) as leaf,
    sha256({_encoded('doc_id', 'source', 'lang', '(n_chars::hugeint + 1)', 'text')}) as bad,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
        lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8), 4294967295), 4294967295) % 7 = 0 as tampered from documents, crc_table),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
node as (
  select lang, 0 as lvl, pos, leaf as h, count(*) over (partition by lang) as n from leaves
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from node where n > 1 group by lang, lvl, pos // 2),
sub as (select lang, h, lvl, row_number() over (order by lang nulls first) - 1 as r from node where n = 1),
top as (
  select 0 as lvl, r as pos, h, count(*) over () as n from sub
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from top where n > 1 group by lvl, pos // 2),
walk as (
  select l.lang, l.pos as leaf_pos, l.pos, 0 as lvl, case when l.tampered then l.bad else l.leaf end as h, '' as proof from leaves l
  union all
  select w.lang, w.leaf_pos, w.pos // 2, w.lvl + 1,
    sha256(case when s.h is null then w.h when w.pos % 2 = 0 then w.h || s.h else s.h || w.h end), w.proof || coalesce(s.h, '')
  from walk w join sub on sub.lang is not distinct from w.lang and w.lvl < sub.lvl
  left join node s on s.lang is not distinct from w.lang and s.lvl = w.lvl and s.pos = xor(w.pos, 1)),
reached as (select w.lang, w.leaf_pos, sub.r, sub.h as subroot, w.h, w.proof from walk w join sub on sub.lang is not distinct from w.lang and sub.lvl = w.lvl),
climb as (
  select lang, leaf_pos, subroot, r as pos, 0 as lvl, h, proof from reached
  union all
  select c.lang, c.leaf_pos, c.subroot, c.pos // 2, c.lvl + 1,
    sha256(case when s.h is null then c.h when c.pos % 2 = 0 then c.h || s.h else s.h || c.h end), c.proof || coalesce(s.h, '')
  from climb c left join top s on s.lvl = c.lvl and s.pos = xor(c.pos, 1) where c.lvl < (select max(lvl) from top)),
ends as (select * from climb where lvl = (select max(lvl) from top))
select l.doc_id, l.leaf, e.subroot, (select h from top where n = 1) as root, sha256(e.proof) as proof_sha256,
  e.h as folded_root, e.h = (select h from top where n = 1) as verified,
  ((select s.lvl from sub s where s.lang is not distinct from l.lang) + (select max(lvl) from top))::int as path_length
from leaves l join ends e on e.lang is not distinct from l.lang and e.leaf_pos = l.pos
'''
