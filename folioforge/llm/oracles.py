"""DuckDB SQL for the queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op2_archive"] = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), q as (
  select *, case when n >= 1000 then max(page_id) over (partition by html) end as top from p
)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from q
"""

ORACLES["op5_url_rules"] = r"""
with rules(rhost, rpath, rverdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), cut as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), judged as (
  select page_id, host, path, (
    select max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := rverdict)) from rules
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as best
  from parts
)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from judged
"""

#: Buckets of each depth that fit into a shard; a document goes to the first that does. The chains of
#: pages of buckets beyond the deepest are restated at the end.
ORACLES["op7_shards"] = r"""
with sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents
), depths as (
  select greatest(0, ceil(log2(greatest(1, sum(bytes) / 1048576.0))))::int as start from sized
), buckets as (
  select doc_id, bytes, hash, start, d, hash >> (60 - d)::int as bucket,
    sum(bytes) over (partition by d, hash >> (60 - d)::int)::bigint as held
  from sized, depths, unnest(range(start, start + 9)) as u(d)
), firsts as (
  select *, row_number() over (partition by doc_id, hash order by d) as r from buckets where held <= 1048576 or d = start + 8
), chosen as (
  select *, held > 1048576 as over,
    case when d = 0 then 'all' else right(lpad(bin(bucket), 60, '0'), d::int) end as name,
    sum(bytes) over (partition by d, bucket order by bytes, hash rows unbounded preceding) as upto
  from firsts where r = 1
), paged as (
  select *, case when over then greatest(0, floor((upto - 1) / 524288.0))::bigint else 0 end as page from chosen
)
select doc_id, bytes, case when over then name || '-' || page else name end as shard, d::int as depth, page,
  case when over then (sum(bytes) over (partition by d, bucket, page))::bigint else held end as shard_bytes
from paged
"""

_ALNUM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op10_decontaminate"] = f"""
with d as (
  select doc_id, coalesce({_ALNUM}, []) as w from documents
), b as (
  select item_id, {_ALNUM} as w from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) as size, list_aggregate(w[j : j + least(10, len(w)) - 1], 'string_agg', ' ') as key
  from b, unnest(range(1, greatest(2, len(w) - 8))) as u(j) where len(w) > 0
), sizes as (
  select distinct size from windows
), grams as (
  select doc_id, j, size, list_aggregate(w[j : j + size - 1], 'string_agg', ' ') as key
  from d, sizes, unnest(range(1, len(w) + 2 - size)) as u(j) where len(w) >= size
), found as (
  select doc_id, j, size, item_id from grams join windows using (size, key)
), hits as (
  select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(j, j + size)) as p from (select distinct doc_id, j, size from found)
  ) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from found) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

ORACLES["op4_embedding_duplicates"] = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
), good as (
  select * from e where label is not null and v is not null and len(v) > 0
    and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from e
  union
  select reach.a, links.b from reach join links on links.a = reach.b
), counts as (
  select a, count(*) as n from links group by a
), roots as (
  select a, min(b) as root from reach group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, vec_id = root as kept
from e join roots on roots.a = vec_id left join counts on counts.a = vec_id
"""

ORACLES["op6_near_duplicates"] = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select distinct doc_id, case when len(w) >= 3 then w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] else array_to_string(w, ' ') end as gram
  from w, unnest(range(1, greatest(2, len(w) - 1))) as u(j) where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (gram) where a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from w
  union
  select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b
), roots as (
  select a, min(b) as root from reach group by a
)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, root as component_id from w join roots on roots.a = w.doc_id left join n on n.doc_id = w.doc_id
"""
