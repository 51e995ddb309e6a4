"""DuckDB SQL of the queries that SQL can express. It says what the result is, not how an operator finds it."""

_CONTROL = r"[<\[]\\*(?:\|(?:turn|says|end|image:[0-9]+|audio:[0-9]+|document:[0-9]+|other:[0-9]+)\|>|/?s>|/?INST\])"

CHAT = rf"""with t as (
    select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
    union all select * from (values (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), c as (
    select *, length('<|turn|>') + length('<|says|>') + length('<|end|>') + 1 + length(role) + length(text)
        + len(regexp_extract_all(text, '{_CONTROL}')) + len(regexp_extract_all(role, '{_CONTROL}')) n from t
)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role) filter (role = 'assistant'), '')) loss_sha256, sum(n)::bigint formatted_chars, 0::bigint n_attachments, 0::bigint expanded_tokens
from c group by conv_id"""

_COMPONENTS = """reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join links l on l.a = r.other),
    comp as (select id, min(other) component_id from reach group by id)"""

VECTORS = f"""with recursive good as (
    select vec_id id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (select a.id a, b.id b from good a join good b on a.id <> b.id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
nodes as (select vec_id id from embeddings), {_COMPONENTS}
select c.id vec_id, (select count(*) from links where a = c.id) n_links, component_id, c.id = component_id kept from comp c"""

NEAR = f"""with recursive w as (
    select doc_id id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents
), s as (select id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from w),
u as (select id, hash(unnest(s)) x from s),
-- documents of one set are linked without their pairs being counted
sets as (select id, len(s) n, sha256(array_to_string(list_sort(s), chr(0))) k from s where len(s) > 0),
firsts as (select k, min(id) id, any_value(n) n from sets group by k),
common as (select a.id a, b.id b, count(*) c from u a join firsts fa on fa.id = a.id join u b on a.x = b.x and a.id < b.id join firsts fb on fb.id = b.id group by all),
near as (select a, b from common join firsts fa on fa.id = a join firsts fb on fb.id = b where 100 * c >= 80 * (fa.n + fb.n - c)),
links as (select a, b from near union all select b, a from near union all select f.id, s.id from sets s join firsts f using (k) where s.id <> f.id union all select s.id, f.id from sets s join firsts f using (k) where s.id <> f.id),
nodes as (select distinct doc_id id from documents), {_COMPONENTS}
select s.id doc_id, len(s) n_shingles, component_id, s.id = component_id kept from s join comp on comp.id = s.id"""

_CRC = """entries as (select list(list_reduce(range(8), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) order by b) t from range(256) r(b))"""
_CODE = "xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: ord(x)::bigint), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295)) % 17"

MERGED = f"""with d as (select doc_id, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
line as (select doc_id, unnest(range(len(x))) k, unnest(x) base from (select doc_id, string_split(text, chr(10)) x from d)),
names as (select doc_id, k::varchar name from line union all select doc_id, unnest(['row', 'lang', 'source']) from d), {_CRC},
codes as (select doc_id, name, {_CODE.format("'L:' || doc_id || ':' || name")} l, {_CODE.format("'R:' || doc_id || ':' || name")} r from names, entries),
whole as (select d.*, l, r from d join codes c on c.doc_id = d.doc_id and name = 'row'),
units as (
    select d.doc_id, name kind, 0 k, 0 behind, x base, case l when 0 then '' when 1 then x || '!' when 2 then x || '?' else x end a, case r when 0 then '' when 1 then x || '!' when 2 then x || '?' else x end b
    from (select doc_id, 'lang' name, lang x from d union all select doc_id, 'source', source from d) d join codes c using (doc_id, name)
    union all select doc_id, 'line', k, 0, base, case l when 0 then null when 1 then base || '!' when 2 then base || '?' else base end, case r when 0 then null when 1 then base || '!' when 2 then base || '?' else base end
    from line join codes using (doc_id) where name = k::varchar
    union all select doc_id, 'gap', k, 1, null, case l when 3 then '!' when 4 then '?' end, case r when 3 then '!' when 4 then '?' end from line join codes using (doc_id) where name = k::varchar
), seen as (select doc_id, kind, k, behind, base, if(w.l = 0, base, a) a, if(w.r = 0, base, b) b from units join whole w using (doc_id)),
judged as (select *, if(a is distinct from base, a, b) state, a is distinct from base and b is distinct from base and a is distinct from b clash, a is distinct from base or b is distinct from base new from seen),
merged as (
    select doc_id, max(state) filter (kind = 'lang') lang, max(state) filter (kind = 'source') source,
        coalesce(string_agg(state, chr(10) order by k, behind) filter (kind in ('line', 'gap') and state is not null), '') text, count(*) filter (new and not clash) clean,
        count(*) filter (clash and (kind in ('lang', 'source') or (kind = 'line' and a is not null and b is not null))) torn,
        count(*) filter (clash and kind = 'line' and (a is null or b is null)) cut, count(*) filter (clash and kind = 'gap') met from judged group by doc_id
), kept as (select m.*, l, r, (l = 0) <> (r = 0) and clean > 0 lost, l <> 0 and (r <> 0 or clean > 0) there from merged m join whole using (doc_id)),
added as (
    select -1 - doc_id doc_id, {{'lang': lang, 'source': source, 'text': if(l = 3, '!', '?')}} a, null b from whole where l in (3, 4)
    union all select -5 - doc_id, null, {{'lang': lang, 'source': source, 'text': if(r = 3, '!', '?')}} from whole where r in (3, 4)
), new as (select doc_id, max(a) a, max(b) b from added group by doc_id)
select doc_id, if(there, lang, null) lang, if(there, source, null) source, if(there, sha256(text), null) text_sha256,
    case when l <> 0 and r <> 0 then clean else (not lost)::bigint end n_clean, if(l <> 0 and r <> 0, torn, 0)::bigint n_edit_edit,
    case when l <> 0 and r <> 0 then cut else lost::bigint end n_edit_delete, if(l <> 0 and r <> 0, met, 0)::bigint n_insert_insert from kept
union all select doc_id, coalesce(a, b).lang, coalesce(a, b).source, sha256(coalesce(a, b).text), (a is null or b is null or a = b)::bigint, 0, 0, (a is not null and b is not null and a <> b)::bigint from new"""


def _assigned(book: str) -> str:
    """Each part's nearest entry of a codebook and its squared distance."""
    gap = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in (1, 2, 3, 4))
    return f"(select id, part, any_value(x) x, min({{'d': {gap}, 'e': entry}}) near from p join {book} using (part) group by id, part)"


def _renewed(book: str) -> str:
    means = ", ".join(f"floor(sum(x[{i}]) / count(*))::bigint" for i in (1, 2, 3, 4))
    return f"(select part, entry, coalesce(m, c) c from {book} left join (select part, near.e entry, [{means}] m from {_assigned(book)} group by part, near.e) using (part, entry))"


CODES = f"""with good as (
    select vec_id id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), p as (select id, part, v[part * 4 + 1 : part * 4 + 4] x from good, range(16) r(part)),
c0 as (select part, entry, x c from (select id, row_number() over (order by id) - 1 entry from good order by id limit 64) join p using (id)),
c1 as materialized {_renewed("c0")}, c2 as materialized {_renewed("c1")}, done as {_assigned("c2")},
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) h from c2),
coded as (select id, string_agg(printf('%02x', near.e), '' order by part) code, sum(near.d)::bigint error from done group by id)
select id vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from coded join good using (id), digest"""

REPEATS = """with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
windows as (select doc_id, i, hash(x) a, md5(x) b from (select doc_id, i, array_to_string(w[i : i + 19], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w where len(w) >= 20))),
marked as (select doc_id, i, row_number() over (partition by a, b order by doc_id, i) > 1 again from windows),
words as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) word from w),
kept as (select doc_id, i, word, coalesce(max(again::int) over (partition by doc_id order by i rows between 19 preceding and current row), 0) gone from words left join marked using (doc_id, i)),
found as (select doc_id, count(*) n, sum(gone) removed, string_agg(word, ' ' order by i) filter (gone = 0) kept from kept group by doc_id)
select d.doc_id, coalesce(n, 0) n_words, coalesce(removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join found using (doc_id)"""
