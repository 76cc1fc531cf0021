"""DuckDB SQL of the queries that SQL can express."""

from .licenses import BASE, NEAR, SHARE, TEMPLATES

OP9 = r"""
with p as (
  select page_id, case when url is not null and strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), q as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), r(verdict, host, path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), u as (select distinct host, path from q), best as (
  select u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from u join r on (u.host = r.host or suffix(u.host, '.' || r.host)) and starts_with(u.path, r.path)
  group by u.host, u.path
)
select q.page_id, q.host, q.path, best.rule, coalesce(best.verdict, 'allow') as verdict from q left join best using (host, path)
"""

OP1 = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from v union select reach.a, link.b from reach join link on link.a = reach.b
), comp as (select a as vec_id, min(b) as component_id from reach group by a),
deg as (select a as vec_id, count(*) as n from link group by a)
select v.vec_id, coalesce(deg.n, 0)::bigint as n_links, comp.component_id, v.vec_id = comp.component_id as kept
from v left join deg using (vec_id) join comp using (vec_id)
"""

_WORDS = r"""
w as (
  select doc_id, coalesce(list_filter(regexp_split_to_array(%s, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as ws from documents
)
"""

OP2 = f"""
with recursive {_WORDS % "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}, s as (
  select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) as g
  from w where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 75 * (x.n + y.n - i)
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, link.b from reach join link on link.a = reach.b
), comp as (select a as doc_id, min(b) as component_id from reach group by a)
select comp.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, comp.doc_id = component_id as kept from comp left join n using (doc_id)
"""

OP3 = f"""
with {_WORDS % "text"}, win as (
  select doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w where len(ws) >= 13)
), f as (
  select g, min(doc_id) as m from win group by g
), cov as (
  select distinct doc_id, p + d as q from win join f using (g), range(13) r(d) where doc_id > m
), t as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as q from w
), k as (
  select t.doc_id, string_agg(word, ' ' order by t.q) as kept from t anti join cov on cov.doc_id = t.doc_id and cov.q = t.q group by t.doc_id
), gone as (select doc_id, count(*) as n from cov group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id) left join gone using (doc_id)
"""

_PHRASES = ", ".join(f"({n}, '{phrase}', '{label}')" for n, (phrase, label) in enumerate(BASE))
_TEMPLATES = ", ".join(f"({n}, '{phrase}', '{needed}', '{label}')" for n, (phrase, needed, label) in enumerate(TEMPLATES))

# Base phrases by comparing slices of words; copies by paths over the text's and template's equal word pairs: a copy is
# a set of pairs linked by diagonals, and its share the length of its longest ascending path.
OP7 = rf"""
with recursive w as (
  select doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) as ws from documents
), b(n, p, label) as (values {_PHRASES}),
place as (
  select doc_id, label, i from (select doc_id, ws, unnest(range(len(ws))) as i from w), b
  where ws[i + 1] = string_split(p, ' ')[1] and ws[i + 1 : i + len(string_split(p, ' '))] = string_split(p, ' ')
), t(n, p, core, label) as (values {_TEMPLATES}),
g as (
  select n, label, len(string_split(p, ' ')) - 1 as grams, len(string_split(p[:strpos(p, core) - 1], ' ')) - 1 as c, len(string_split(core, ' ')) - 1 as m, o,
    string_split(p, ' ')[o + 1] || ' ' || string_split(p, ' ')[o + 2] as gram
  from (select *, unnest(range(len(string_split(p, ' ')) - 1)) as o from t)
), pair as (
  select doc_id, n, label, grams, c, m, i, o, i - o as d
  from (select doc_id, i, ws[i + 1] || ' ' || ws[i + 2] as gram from (select doc_id, ws, unnest(range(len(ws) - 1)) as i from w where len(ws) > 1)) join g using (gram)
), gap as (
  select *, d - max(d) over (partition by doc_id, n order by d range between unbounded preceding and 1 preceding) as far from pair
), part as (
  select *, count(*) filter (far > {NEAR}) over (partition by doc_id, n order by d, i) as copy0 from gap
), copy as (
  select * exclude (copy0), max(copy0) over (partition by doc_id, n, d) as copy from part
), core as (
  select distinct doc_id, n, copy from copy where o >= c and o < c + m group by doc_id, n, copy, d, m having count(*) = m
), kept as (
  select copy.* from copy join core using (doc_id, n, copy)
), path(doc_id, n, copy, i, o, size) as (
  select doc_id, n, copy, i, o, 1 from kept
  union select path.doc_id, path.n, path.copy, k.i, k.o, path.size + 1 from path join kept k using (doc_id, n, copy) where k.i > path.i and k.o > path.o
), found as (
  select doc_id, t.label, max(size) / (len(string_split(p, ' ')) - 1) as share from path join t using (n) group by doc_id, n, copy, t.label, p having share >= {SHARE}
), every as (
  select doc_id, label, share, null::bigint as i from found union all select doc_id, label, 1.0, i from place
), out as (
  select doc_id, count(i) as n_base, min(i) as first_word, max(i) as last_word, array_to_string(list_sort(list(distinct label) filter (i is not null)), ',') as base_labels,
    array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
  from every group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from w left join out using (doc_id)
"""

ORACLE = {
    "op1_embedding_dedup": OP1,
    "op2_minhash_dedup": OP2,
    "op3_substring_dedup": OP3,
    "op7_licenses": OP7,
    "op9_url_filter": OP9,
}
