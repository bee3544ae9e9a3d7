"""DuckDB SQL for the queries of plans.biblio."""

ORACLES: dict[str, str] = {}

_RECORDS = """
people as (
  select c_custkey, 'customer:' || c_name as author, 'nation:' || n_name as org, 'market:' || c_mktsegment as market, 'region:' || r_name as venue, n_nationkey as n
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), papers as (
  select o_orderkey as k, 'doc-' || o_orderkey as doc_id, 'order:' || o_orderkey as paper, year(o_orderdate) as y, author, org, market, venue, c_custkey, n
  from orders join people on o_custkey = c_custkey
), refs as (
  select l_orderkey as k, 'part:' || p_name as ref, min(l_linenumber) as pos from lineitem join part on l_partkey = p_partkey group by all
), ents as (
  select k, doc_id, paper as entity_name, 'paper' as entity_type, 'Academic paper titled ''' || paper || ''', published in ' || venue || ' (' || y || ').' as description, 1 as phase, 0 as pos from papers
  union all select k, doc_id, author, 'author', 'Author of ''' || paper || '''. Identifiers: orcid:c' || c_custkey || '.', 2, 0 from papers
  union all select k, doc_id, venue, 'venue', 'Publication venue of ''' || paper || '''.', 3, 0 from papers
  union all select k, doc_id, y::varchar, 'year', 'Publication year of ''' || paper || '''.', 4, 0 from papers
  union all select k, doc_id, ref, 'citedwork', 'Work cited by ''' || paper || '''.', 5, pos from papers join refs using (k)
  union all select k, doc_id, org, 'organization', 'Institution affiliated with ''' || paper || '''. Identifiers: ror:n' || n || '.', 7, 0 from papers
  union all select k, doc_id, market, 'organization', 'Institution affiliated with ''' || paper || '''.', 7, 1 from papers
), rels as (
  select k, doc_id, paper as src_id, author as tgt_id, 'authored_by' as keywords, '''' || paper || ''' was authored by ' || author || '.' as description, 2 as phase from papers
  union all select k, doc_id, paper, venue, 'published_in', '''' || paper || ''' was published in ' || venue || '.', 3 from papers
  union all select k, doc_id, paper, y::varchar, 'published_year', '''' || paper || ''' was published in ' || y || '.', 4 from papers
  union all select k, doc_id, paper, ref, 'cites', '''' || paper || ''' cites ''' || ref || '''.', 5 from papers join refs using (k)
  union all select k, doc_id, author, org, 'affiliated_with', author || ' is affiliated with ' || org || ' on ''' || paper || '''.', 6 from papers where n % 2 = 0
  union all select k, doc_id, paper, market, 'affiliated_with', '''' || paper || ''' lists the affiliation ' || market || '.', 7 from papers where n % 2 = 0
  union all select k, doc_id, author, unnest([org, market]), 'affiliated_with', author || ' is listed with affiliation ' || unnest([org, market]) || ' on ''' || paper || '''.', 7 from papers where n % 2 = 1
), nodes as (
  select * exclude r from (select *, row_number() over (partition by entity_name order by k desc, phase, pos) as r from ents) where r = 1
), edges as (
  select * exclude r from (select *, row_number() over (partition by least(src_id, tgt_id), greatest(src_id, tgt_id) order by k desc, phase) as r from rels) where r = 1
), degrees as materialized (
  select entity_name as id, entity_type, count(e) as degree from nodes left join (select unnest([src_id, tgt_id]) as e from edges) on e = entity_name group by all
)
"""
_COLOR = "case lower({0}) when 'paper' then '6' when 'author' then '4' when 'venue' then '5' when 'year' then '3' when 'citedwork' then '1' when 'organization' then '2' end"


def _graph(name: str, sql: str) -> None:
    ORACLES[name] = f"with {_RECORDS}{sql}"


_graph("kg_entities", "select entity_name, entity_type, description, doc_id from nodes")
_graph("kg_relations", "select doc_id, src_id, tgt_id, keywords, description, 1.0::double as weight from rels")
_graph("kg_degree", "select id, entity_type, degree from degrees")
_graph("kg_prune_topk", f"select id as name, entity_type, degree, {_COLOR.format('entity_type')} as color from degrees order by degree desc, id limit 40")
_graph("kg_induced_edges", ", top as materialized (select id from degrees order by degree desc, id limit 200) select least(src_id, tgt_id) as a, greatest(src_id, tgt_id) as b, keywords from edges where src_id in (from top) and tgt_id in (from top)")
_graph("kg_edge_style", "select src_id as from_node, tgt_id as to_node, '4' as color, keywords as label from edges")
_graph("kg_new_entities", """
, old as (select distinct entity_name from ents where k % 2 = 0)
select distinct doc_id, entity_name, entity_type from ents where k % 2 = 1 and (entity_type = 'paper' or entity_name not in (from old))
""")  # fmt: skip
_graph("kg_node_text_size", f"""
, texts as (
  select entity_name as id, entity_type, '# ' || entity_name || chr(10) || chr(10) || '**Type:** ' || entity_type || chr(10) || chr(10)
    || case when length(description) > 350 then rtrim(substr(description, 1, 349)) || '…' else description end
    || chr(10) || chr(10) || '_Source: order-' || k || '.txt_' as text from nodes
)
select id, text, 400 as width,
  greatest(160, least(520, 60 + 24 * list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(length(x) / 44.0)::int)))))::int as height,
  {_COLOR.format('entity_type')} as color from texts
""")  # fmt: skip
_graph("kg_header_text", """
select doc_id, concat_ws(chr(10), 'Title: ' || paper, 'Authors: ' || author, 'Venue: ' || venue, 'Year: ' || y, 'DOI: 10.1000/o' || k, 'Affiliations: ' || org || ', ' || market,
  'References: ' || (select string_agg(ref, '; ' order by pos, ref) from refs where refs.k = papers.k)) as content, 0 as chunk_order_index from papers
""")  # fmt: skip
_graph("type_histogram", "select entity_type, count(*) as n from nodes group by all")
_graph("kg_merge", """
, plans as (
  select 'customer:' || c_name as source, min('customer:' || c_name) over (partition by c_nationkey) as target from customer
  where 'customer:' || c_name in (select entity_name from nodes)
), live as (
  select source, target from plans where source <> target and source in (select entity_name from nodes) and target in (select entity_name from nodes)
), turned as (
  select coalesce(a.target, src_id) as s, coalesce(b.target, tgt_id) as t, keywords from edges
  left join live a on a.source = src_id left join live b on b.source = tgt_id
)
select least(s, t) as src, greatest(s, t) as tgt, string_agg(distinct keywords, '<SEP>' order by keywords) as keywords, count(*)::double as weight
from turned where s <> t group by 1, 2
""")  # fmt: skip
# titles are told apart by their letters and digits in lower case; part names are unlike orders' titles
_graph("ref_merge_cap", """
, cited as materialized (
  select k, ref, trim(regexp_replace(lower(ref), '[^0-9a-z]+', ' ', 'g')) as norm, pos from refs
), own as (
  select k, norm, arg_min(ref, struct_pack(pos := pos, ref := ref)) as ref, min(pos) as pos from cited group by all
), kept as (
  select k, list(ref order by pos, ref) as l, list(norm) as norms, count(*) as n from own group by k
), offered as (
  select p.author, c.ref, c.norm, row_number() over (partition by p.author order by p.k, c.pos, c.ref) as place from papers p join cited c using (k)
), firsts as (
  select author, norm, arg_min(ref, place) as ref, min(place) as place from offered group by all
), more as (
  select p.k, f.ref, row_number() over (partition by p.k order by f.place) as r
  from papers p join firsts f using (author) left join kept on kept.k = p.k
  where coalesce(kept.n, 0) < 5 and not list_contains(coalesce(norms, []), f.norm)
), added as (
  select more.k, list(ref order by r) as l from more left join kept using (k) where r <= 5 - coalesce(n, 0) group by all
), filled as (
  select doc_id, coalesce(kept.l, []) || coalesce(added.l, []) as r from papers left join kept using (k) left join added using (k)
)
select doc_id, array_to_string(r, '|') as "references", len(r)::int as n from filled
""")  # fmt: skip

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(of: str) -> str:
    return f"regexp_replace({of}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"



ORACLES |= {
    "doc_ids": f"select doc_id, 'doc-' || md5({_strip('text')}) as content_id from documents",
    "doc_fallback_title": f"""
select doc_id, coalesce(left(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'),
  lambda x: {_strip("regexp_replace(" + _strip('x') + ", '^#+', '')")}), lambda x: x <> '')[1], 200), 'doc' || doc_id) as title from documents""",
    "doc_excerpt": "select doc_id, case when length(text) <= 10000 then text else left(text, 6000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 4000) end as excerpt from documents",
    "doc_chunks": "select doc_id, (start // 3800)::int as chunk_order_index, start::int as start, substr(text, start::int + 1, 4000) as content from documents, unnest(range(0, length(text), 3800)) as u(start)",
    "pdf_text_repair": r"select doc_id, " + _strip(r"regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}]{6})([\p{L}]{3})', '\1-' || chr(10) || '\2', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " as text from documents",
    "norm_title_groups": "select trim(regexp_replace(lower(p_name || '   . ' || p_brand), '[^0-9a-z]+', ' ', 'g')) as norm, count(*) as n, min(p_partkey) as first_key from part group by 1",
    "doi_extract": "select p_partkey, '10.' || (1000 + p_partkey % 9000) || '/part.' || p_partkey as doi from part",
    "identifiers": "select s_suppkey, 'openalex:A' || s_suppkey as work, 'orcid:0000-0001-' || case when s_suppkey < 10000 then lpad(s_suppkey::varchar, 4, '0') else left(s_suppkey::varchar, 4) end || '-123X' as orcid, 'ror:0' || s_suppkey as ror from supplier",
    "years": "select o_orderkey, year(o_orderdate)::int as year, year(o_orderdate)::int as valid from orders",
    "html_title_records": r"select page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '') as title, nullif(regexp_extract(html, '<html lang=.([a-z]+).', 1), '') as lang from pages",
    "shared_id_components": "select min(least('c' || c_custkey, 's' || c_nationkey || '-' || c_mktsegment)) as root, count(distinct c_custkey) + 1 as n from customer group by c_nationkey, c_mktsegment",
    "entity_tagging": "select doc_id, name, type from documents, (values ('the', 'Concept'), ('aux', 'Method'), ('der', 'Concept'), ('que', 'Metric')) d(name, type) where contains(lower(text), name)",
    "question_keywords": "select item_id, coalesce(nullif(concat_ws('|', case when contains(lower(text), 'then') then 'Then' end, case when contains(lower(text), 'of the') then 'of the' end, case when contains(lower(text), 'est') then 'est' end, case when contains(lower(text), 'ung') then 'ung' end), ''), 'overview') as keywords from benchmark",
    "answers_ok": "select conv_id, turn, turn % 3 = 2 and text <> '' and not contains(text, '[no-context]') as ok from conversations",
    "box_overlaps": """
with b as (select p_partkey as id, p_partkey * 7919 % 20011 as x, p_partkey * 104729 % 15013 as y, 200 + p_partkey % 5 * 60 as w, 160 + p_partkey % 7 * 40 as h from part)
select a.id as a, b.id as b from b a join b b on a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h""",
}

_EMBED = r"""
{0}_w as (
  select id, md5(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) as m from {0}
), {0}_s as (
  select id, ((('0x' || m[1:2])::bigint + ('0x' || m[3:4])::bigint * 256 + ('0x' || m[5:6])::bigint * 65536 + ('0x' || m[7:8])::bigint * 16777216) % 64) as place,
    sum(case when ('0x' || m[9:10])::bigint % 2 = 1 then 1.0 else -1.0 end) as v from {0}_w group by all
), {0}_d as (
  select id, d.place, (coalesce(v, 0) + case when d.place = 0 then 1e-3 else 0 end)::double as v from {0} cross join (select unnest(range(64)) as place) d left join {0}_s using (id, place)
), {0}_v as (
  select id, list(v / n order by place) as v from (select *, sqrt(sum(v * v) over (partition by id)) as n from {0}_d) group by id
)"""

ORACLES["hash_embedding"] = "with b as (select item_id as id, text from benchmark), " + _EMBED.format("b") + " select id as item_id, (i - 1)::int as place, round(v[i], 6) as x from b_v, unnest(range(1, 65)) as u(i)"
ORACLES["cosine_topk"] = """
with s as (
  select q.vec_id as query_id, r.vec_id as id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) as score
  from embeddings q, embeddings r where q.vec_id % 50 = 0
)
select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score >= 0.05) where rank <= 5
"""
ORACLES["retrieve_modes"] = "with " + _RECORDS + f"""
, asked as (
  select item_id as q, text, coalesce(nullif(concat_ws(', ', case when contains(lower(text), 'then') then 'Then' end, case when contains(lower(text), 'of the') then 'of the' end,
    case when contains(lower(text), 'est') then 'est' end, case when contains(lower(text), 'ung') then 'ung' end), ''), 'overview') as low from benchmark
), links as (
  select least(src_id, tgt_id) || '|' || greatest(src_id, tgt_id) as id, least(src_id, tgt_id) as src, greatest(src_id, tgt_id) as tgt, keywords from edges
), x as (
  select 'low|' || q as id, low as text from asked union all select 'high|' || q, 'retrieval-augmented generation, long-document understanding' from asked union all select 'text|' || q, text from asked
  union all select 'entity|' || entity_name, entity_name || ' ' || entity_type from nodes
  union all select 'relation|' || id, keywords || ' ' || src || ' ' || tgt from links
  union all select 'chunk|' || doc_id || '-' || (start // 3800), substr(text, start::int + 1, 4000) from documents, unnest(range(0, length(text), 3800)) as u(start)
), {_EMBED.format("x")}, near as (
  select q, kind, id from (
    select *, row_number() over (partition by q, kind order by score desc, id) as rank from (
      select split_part(a.id, '|', 2)::bigint as q, split_part(b.id, '|', 1) as kind, substr(b.id, instr(b.id, '|') + 1) as id, round(list_dot_product(a.v, b.v), 6) as score
      from x_v a join x_v b on split_part(a.id, '|', 1) = case split_part(b.id, '|', 1) when 'entity' then 'low' when 'relation' then 'high' when 'chunk' then 'text' end
    ) where score >= 0.05
  ) where rank <= 3
), both_ways as (
  select q, kind, id from near where kind <> 'chunk'
  union select q, 'relation', links.id from near join links on near.id = links.src or near.id = links.tgt where kind = 'entity'
  union select q, 'entity', unnest([src, tgt]) from near join links on near.id = links.id where kind = 'relation'
)
select q as query_id, mode, kind, id from both_ways, (values ('hybrid'), ('mix')) m(mode)
union select q, 'mix', kind, id from near where kind = 'chunk'
"""
ORACLES["extraction"] = """
with held as (
  select doc_id, contains(lower(text), 'the') as a, contains(lower(text), 'aux') as b, contains(lower(text), 'der') as c, contains(lower(text), 'que') as d from documents
)
select doc_id, concat_ws(chr(10), case when b then 'entity<|#|>aux<|#|>Method<|#|>' end, case when c then 'entity<|#|>der<|#|>Concept<|#|>German' end, case when d then 'entity<|#|>que<|#|>Metric<|#|>' end,
  case when a then 'entity<|#|>the<|#|>Concept<|#|>English' end, case when b and d then 'relation<|#|>aux<|#|>que<|#|>French<|#|>' end, case when a and c then 'relation<|#|>the<|#|>der<|#|>alike<|#|>Both are articles' end, '<|COMPLETE|>') as content
from held where a or b or c or d
"""
