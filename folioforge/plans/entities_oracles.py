"""DuckDB SQL of the queries in entities.py."""

ORACLES = {
    "merge_plans": r"""
with w as (
  select 'w' || p_partkey || ' study of ' || p_name as work from part
), people as (
  select c_custkey, replace(n_name, ' ', '') as family from customer join nation on c_nationkey = n_nationkey
), whole as (
  select distinct chr((65 + c_custkey % 20)::int) as letter, family from people
), short as (
  select distinct chr((65 + c_custkey % 26)::int) as letter, family from people
), venues as (
  select distinct s_suppkey % 10 as g, 'Venue' || [' ', '-', '  '][s_suppkey % 3 + 1] || (s_suppkey % 10) as name from supplier
), firsts as (
  select g, arg_min(name, struct_pack(n := -length(name), name := name)) as target from venues group by g
)
select upper(work) || ' (2019)' as source, work as target, 'duplicate work titles' as reason, 'paper' as kind from w
union all select work || ' and its many further uses', work, 'duplicate work titles', 'paper' from w where length(trim(regexp_replace(lower(work), '[^0-9a-z]+', ' ', 'g'))) >= 25
union all select letter || '. ' || family, letter || 'lan ' || family, 'duplicate author names', 'author' from short join whole using (letter, family)
union all select name, target, 'duplicate venue names', 'venue' from venues join firsts using (g) where name <> target
union all select 'Univ. of ' || n_name, upper('Univ. of ' || n_name), 'duplicate organization names', 'organization' from nation where n_nationkey % 2 = 1
""",
    "reconcile_records": r"""
with o as (
  select o_orderkey as k, o_orderkey % 2 = 0 as even, replace(c_name, '#', '') as who, 'region:' || r_name as venue, 'nation:' || n_name as org
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), refs as (
  select k, even, p_name, min(l_linenumber) as pos, case when even then left(md5('part:' || p_name), 12) || ' ' || p_name else upper(left(md5('part:' || p_name), 12) || '  ' || p_name) end as name
  from o join lineitem on l_orderkey = k join part on l_partkey = p_partkey group by all
), works as (
  select p_name, arg_min(name, struct_pack(k := k, pos := pos, name := name)) as canonical, min(struct_pack(k := k, pos := pos, name := name)) as first from refs group by p_name
), listed as (
  select k, string_agg(canonical, '|' order by pos, refs.p_name) as refs, count(*) filter (first = struct_pack(k := k, pos := pos, name := refs.name)) as n_new, count(*) as n from refs join works using (p_name) group by k
), people as (select who, min(k) as first from o group by who), venues as (select venue, min(k) as first from o group by venue), houses as (select org, min(k) as first from o group by org)
select o.k as ordinal, 'o' || o.k || ' order' as title, case when people.first % 2 = 0 then 'Ann ' || o.who else o.who || ', Ann' end as authors,
  case when venues.first % 2 = 0 then o.venue else upper(o.venue) end as venue, coalesce(refs, '') as "references", coalesce(n_new, 0)::int as n_new,
  (coalesce(n - n_new, 0) + (people.first < o.k)::int + (venues.first < o.k)::int + (houses.first < o.k)::int)::int as n_existing
from o join people using (who) join venues using (venue) join houses using (org) left join listed on listed.k = o.k
""",
    "enrich_records": r"""
with p as (
  select p_partkey as k, case when p_partkey % 3 < 2 then 1 when p_partkey % 2 = 0 then 2 else 0 end as src from part
), r as (
  select p.*, a.k is not null and a.k % 3 < 2 as next1, c.k is not null and c.k % 3 < 2 as next3 from p left join p a on a.k = p.k + 1 left join p c on c.k = p.k + 3
)
select 'doc-' || k as doc_id, case src when 1 then 'P' || k || ' Title' when 2 then 'P' || k || ' title' else 'p' || k || ' title' end as title,
  case when src > 0 then (2000 + k % 20)::int end as year, case when src > 0 then '10.1000/k' || k end as doi,
  'Ref A' || k || '|p' || (k + 1) || ' Title!' || case when src = 1 and next3 then '|P' || (k + 3) || ' Title' when src = 2 then '|Old ' || k else '' end as "references",
  case when src > 0 then concat_ws('|', case when src = 1 and next3 then 'P' || (k + 3) || ' Title=10.1000/k' || (k + 3) end, case when src = 1 and next1 then 'p' || (k + 1) || ' Title!=10.1000/k' || (k + 1) end) end as dois,
  case src when 1 then 'openalex' when 2 then 'crossref' end as metadata_source
from r
""",
    "layout_shelves": r"""
with recursive b as (
  select n_name as component, (200 + n_nationkey * 37 % 400)::double as w, (150 + n_nationkey * 53 % 300)::double as h from nation
), o as (
  select *, row_number() over (order by w * h desc, component) as r, greatest(1.3 * sqrt(sum(w * h) over ()), max(w) over ()) as lim from b
), s as (
  select r, component, 0.0::double as x, 0.0::double as y, w + 160 as nx, h as tall from o where r = 1
  union all
  select o.r, o.component, case when s.nx > 0 and s.nx + o.w > lim then 0.0 else s.nx end, case when s.nx > 0 and s.nx + o.w > lim then s.y + tall + 160 else s.y end,
    case when s.nx > 0 and s.nx + o.w > lim then 0.0 else s.nx end + o.w + 160, case when s.nx > 0 and s.nx + o.w > lim then o.h else greatest(tall, o.h) end
  from s join o on o.r = s.r + 1
)
select component, x, y from s
""",
}
