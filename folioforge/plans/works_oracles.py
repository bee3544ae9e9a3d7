"""DuckDB SQL of the queries in works.py."""

_ORDERS = "with o as (select o_orderkey as k, c_name as c, n_name as n, o_orderpriority as p from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"

ORACLES = {
    "catalogue_open": _ORDERS + """
select k, 'w' || k as work_id, 'Work no ' || k as title, '10.1000/abc.' || k as doi, case when 1400 + k % 800 between 1500 and 2100 then (1400 + k % 800)::int end as year, p as venue,
  case when k % 2 = 0 then c else c || '|B C' end as authors, c || '=' || n as affiliations, c || '=openalex:A' || k || '+orcid:0000-0000-0000-000X' as ids, n || '=ror:0ab' as places, 'w' || (k + 1) as refs from o
""",
    "catalogue_deposit": _ORDERS + """
select k, '10.1000/k' || k as work_id, 'Work ' || k as title, '10.1000/k' || k as doi, case when 1400 + k % 800 between 1500 and 2100 then 1400 + k % 800 else 2001 end::int as year, p as venue,
  'A. ' || c || '|Group ' || (k % 10) as authors, 'A. ' || c || '=' || n as affiliations, 'A. ' || c || '=orcid:0000-0000-0000-0001' as ids, '10.1000/r' || k || '@10.1000/r' || k || '|Cited work@' as refs from o
""",
    "candidate_pick": """
with c as (
  select p_partkey as record_id, i::int as ordinal, abs((p_partkey * (i + 1)) % 5 - p_partkey % 4) as apart, case when i = 2 then null else ((p_partkey + i) % 3 = p_partkey % 3)::int end as share
  from part, unnest(range(3)) as u(i)
), s as (
  select record_id, ordinal, 1 + 0.1 * coalesce(share, 0) + case when apart = 0 then 0.05 when apart > 1 then -0.1 else 0 end as score
  from c where (share is null or share > 0) and (apart <= 1 or share > 0)
)
select record_id, arg_max(ordinal, [score, -ordinal])::int as ordinal, round(max(score), 6)::double as score from s group by record_id
""",
    "canvas_verify": """
with p as (
  select p_partkey as k, 'canvas-' || (p_partkey // 100) as path, row_number() over (partition by p_partkey // 100 order by p_partkey) - 1 as pos, p_partkey % 10 * 500 as x, p_partkey // 10 % 10 * 300 as y,
    case when p_partkey % 17 = 0 then 0 when p_partkey % 31 = 0 then 600 else 400 end as width from part
), v as (
  select path, pos, 'nodes' as part, unnest([case when k % 11 = 0 then 'id_not_hex16' end, case when k % 13 = 0 then 'type_invalid' end, case when k % 19 = 0 then 'x_not_integer' end,
    case when k % 17 = 0 then 'width_not_positive' end, case when k % 29 = 0 and k % 13 > 0 then 'text_missing' end, case when k % 23 = 0 then 'color_invalid' end]) as rule from p
  union all
  select p.path, p.pos, 'edges', unnest([case when k % 5 = 0 then 'fromSide_invalid' end, case when k % 7 = 0 then 'color_invalid' end,
    case when not exists (select 1 from p q where q.k = p.k + 1 and q.path = p.path) then 'toNode_unknown' end]) from p
)
select path, part, pos, rule, 'error' as severity, 1::bigint as n from v where rule is not null
union all
select a.path, 'document', null, 'overlap', 'error', count(*) from p a join p b on a.path = b.path and a.k < b.k and a.k % 19 > 0 and b.k % 19 > 0
  and a.x < b.x + b.width and b.x < a.x + a.width and a.y < b.y + 200 and b.y < a.y + 200 group by a.path
""",
}
