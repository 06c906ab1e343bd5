"""DuckDB SQL for those queries that SQL can express."""

from .secret_scan import BASE, KINDS, MAX_OWNERS, MAX_REPOSITORIES

CRC_TABLE = []
for _k in range(256):
    for _ in range(8):
        _k = _k >> 1 ^ (0xEDB88320 if _k & 1 else 0)
    CRC_TABLE.append(_k)

OP6 = f"""
with docs as (
  select doc_id, source, coalesce(text, '') as t, coalesce('s' || source, 'n') as s,
         md5('17:' || coalesce(doc_id::varchar, 'null')) as h
  from documents),
bytes as (
  select *, hex(encode(t)) as x, strlen(t) as n from docs),
sums as (
  select doc_id, source, s, h, (n + 8)::bigint as size,
         xor(4294967295, list_reduce(
           [4294967295::bigint] || list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::bigint),
           lambda c, b: xor(c >> 8, ({CRC_TABLE}::bigint[])[(xor(c, b) & 255) + 1])))::bigint as text_crc32
  from bytes),
ranked as (
  select *, (row_number() over (partition by s order by h, text_crc32, size, doc_id) - 0.5::double)
            / count(*) over (partition by s) as f
  from sums),
placed as (
  select *, row_number() over (order by f, s, h, text_crc32, size, doc_id) - 1 as p, count(*) over () as n from ranked)
select doc_id, size, text_crc32, 'rows' as law, (p * 24 // n)::int as shard,
       (p - ((p * 24 // n) * n + 23) // 24)::bigint as slot, null::int as grown_shard, source
from placed
"""

OP3 = """
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as o, hex(encode(coalesce(text, ''))) as x from documents),
part as (select r, o, j, substring(x, 1000 * j + 1, 1098) as p from (select r, o, x, unnest(range((length(x) + 999) // 1000)) as j from d)),
w as (select r, o, 500 * j + i as i, substring(p, 2 * i + 1, 100) as s from (select *, unnest(range(least(500, length(p) // 2 - 49))) as i from part)),
m as (select s, min(o) as least from w group by s),
hit as (select r, i, lag(i) over (partition by r order by i) as before from w join m using (s) where least < o),
island as (select r, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by r order by i) as k from hit),
run as (select r, min(i) as a, max(i) + 50 as b from island group by r, k),
cut as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as last from run),
kept as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as stop, string_agg(substring(x, 2 * last + 1, 2 * (a - last)), '' order by a) as parts
         from cut join d using (r) group by r)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(parts, '') || substring(x, 2 * coalesce(stop, 0) + 1))) as kept_sha256
from d left join kept using (r)
"""


def _kind(number: int, name: str) -> str:
    pattern, group, least = KINDS[name]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
select r, owner, repository, {number} as kind, start, start + length(whole) as stop, value from (
  select *, sum(length(gap)) over w + sum(length(whole)) over w - length(whole) as start from (
    select r, owner, repository, unnest(string_split_regex(t, {p})[1:len(regexp_extract_all(t, {p}))]) as gap,
           unnest(regexp_extract_all(t, {p}, 0)) as whole, unnest(regexp_extract_all(t, {p}, {group})) as value,
           unnest(range(len(regexp_extract_all(t, {p})))) as k
    from d)
  window w as (partition by r order by k)) where length(value) >= {least}"""


_NAMES = "['" + "', '".join(KINDS) + "']"
OP8 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce('=' || source, '-') as owner,
                  coalesce('=' || source, '-') || '/' || coalesce('=' || lang, '-') as repository from documents),
c as ({" union all ".join(_kind(n, k) for n, k in enumerate(KINDS))}),
v as (select value, count(distinct owner) <= {MAX_OWNERS} and count(distinct (owner, repository)) <= {MAX_REPOSITORIES} as live from c group by value),
j as (select c.*, live, {_NAMES}[kind + 1] || ':' || start || ':' || stop as span from c join v using (value)),
g as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
             string_agg(span, ',' order by start, kind) filter (kind < {BASE}) as base,
             string_agg(span, ',' order by start, kind) filter (kind < {BASE} or live) as spans,
             count(*) filter (kind < {BASE} and live) as n_live, count(*) filter (kind < {BASE} and not live) as n_examples
      from j group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples
from d left join g using (r)
"""

OP9 = """
with recursive e as (
  select row_number() over () as r, vec_id, embedding::double[] as v,
         embedding is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
         and list_bool_or(list_transform(embedding, lambda x: x <> 0)) as ok
  from embeddings),
links as (
  select a.r as a, b.r as b from e a join e b on a.ok and b.ok and a.r <> b.r and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(vec_id) as other from reach join e on e.r = reach.b group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(other, vec_id)) as component_id, vec_id = least(vec_id, coalesce(other, vec_id)) as kept
from e left join n on n.a = e.r left join least on least.a = e.r
"""

ORACLE: dict[str, str] = {"op3_suffix_cover": OP3, "op6_stratified_shards": OP6, "op8_secret_ownership": OP8, "op9_cross_polytope": OP9}
