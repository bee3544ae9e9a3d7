"""Queries of the engine over the star schema read as a bibliography: an order is a paper, its customer
the author, the customer's region the venue and nation the institution, the order's year the year, and
the parts it orders the works it cites. Documents, benchmark and pages stand for texts and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import catalogue, graph, kg, retrieve
from folioforge.operators.components import connected_components
from folioforge.plans.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order; see kg.RECORD. The customer's market is a second affiliation of the paper, and in nations of
    even number the author's own institution is told."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    people = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_nationkey", "n_name", "r_name")
    cited = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cited = cited.groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: F.concat(F.lit("part:"), x["p_name"]))).alias("references"))
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(people, F.col("o_custkey") == F.col("c_custkey")).join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    said = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    author, house = said("customer:", "c_name"), said("nation:", "n_name")
    return rows.select(
        said("doc-", "o_orderkey").alias("doc_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat(said("order-", "o_orderkey"), F.lit(".txt")).alias("file_path"),
        said("order:", "o_orderkey").alias("title"),
        F.array(author).alias("authors"),
        F.year("o_orderdate").alias("year"),
        said("region:", "r_name").alias("venue"),
        said("10.1000/o", "o_orderkey").alias("doi"),
        F.array(house, said("market:", "c_mktsegment")).alias("affiliations"),
        F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(author.alias("author"), F.array(house).alias("institutions")))).alias("author_affiliations"),
        F.create_map(author, F.array(said("orcid:c", "c_custkey"))).alias("author_ids"),
        F.create_map(house, F.array(said("ror:n", "n_nationkey"))).alias("institution_ids"),
        F.lit(None).cast("map<string,string>").alias("reference_dois"),
        F.lit(None).cast("string").alias("catalogue_id"),
        F.lit(None).cast("string").alias("metadata_source"),
    )


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.prepared(records(spark, sf_dir))


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what is said of them."""
    rows = emitted(spark, sf_dir)
    return kg.nodes(rows), kg.edges(rows)


@query
def kg_entities(spark, sf_dir):
    return kg.upsert(emitted(spark, sf_dir))[0].select(F.col("id").alias("entity_name"), "entity_type", "description", "doc_id")


@query
def kg_relations(spark, sf_dir):
    return kg.record_rows(kg.emissions(records(spark, sf_dir)))[1].select("doc_id", "src_id", "tgt_id", "keywords", "description", "weight")


@query
def kg_degree(spark, sf_dir):
    return graph.degrees(*graph_of(spark, sf_dir)).select("id", "entity_type", "degree")


@query
def kg_prune_topk(spark, sf_dir):
    nodes = graph.prune(*graph_of(spark, sf_dir), 40)[0]
    return nodes.select(F.col("id").alias("name"), "entity_type", "degree", kg.color_of(F.col("entity_type")).alias("color"))


@query
def kg_induced_edges(spark, sf_dir):
    return graph.prune(*graph_of(spark, sf_dir), 200)[1].select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "keywords")


@query
def kg_edge_style(spark, sf_dir):
    rows = emitted(spark, sf_dir)
    return graph.style_edges(kg.nodes(rows), kg.upsert(rows)[1])


@query
def kg_new_entities(spark, sf_dir):
    rows = emitted(spark, sf_dir)
    existing = kg.nodes(rows.where("ordinal % 2 = 0")).select(F.col("id").alias("entity_name"))
    return kg.new_entities(kg.record_rows(rows.where("ordinal % 2 = 1"))[0], existing).select("doc_id", "entity_name", "entity_type")


@query
def kg_node_text_size(spark, sf_dir):
    return graph.node_text(kg.upsert(emitted(spark, sf_dir))[0]).select("id", "text", "width", "height", "color")


@query
def kg_header_text(spark, sf_dir):
    return kg.header_text(records(spark, sf_dir)).select("doc_id", "content", "chunk_order_index")


@query
def type_histogram(spark, sf_dir):
    return graph.type_histogram(kg.nodes(emitted(spark, sf_dir)))


@query
def kg_merge(spark, sf_dir):
    """Every customer becomes the customer before them in their nation, and so by a chain its first."""
    nodes, edges = graph_of(spark, sf_dir)
    people = nodes.where("entity_type = 'author'").select(F.col("id").alias("source")).join(table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_name").alias("source"), "c_nationkey"), "source")
    plans = people.select("source", F.lag("source").over(Window.partitionBy("c_nationkey").orderBy("source")).alias("target")).where("target is not null")
    kept = graph.merge_nodes(nodes.select("id", "entity_type"), edges.select("src", "tgt", "keywords", "weight"), plans)[1]
    return kept.select("src", "tgt", "keywords", "weight")


@query
def doc_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(F.col("text")).alias("content_id"))


@query
def doc_fallback_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fallback_title(F.col("text"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("title"))


@query
def doc_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query
def doc_chunks(spark, sf_dir):
    return retrieve.chunks(table(spark, sf_dir, "documents"))


@query
def pdf_text_repair(spark, sf_dir):
    """Documents with their spaces after long words broken as PDF lines are."""
    broken = F.regexp_replace("text", r"([\p{L}]{6})([\p{L}]{3})", "$1-\n$2")
    return table(spark, sf_dir, "documents").select("doc_id", T.repair_pdf_text(broken).alias("text"))


@query
def norm_title_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(T.normalize_title_ascii(F.concat("p_name", F.lit(" (2017a). "), "p_brand")).alias("norm"), "p_partkey")
    return parts.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))


@query
def doi_extract(spark, sf_dir):
    text = F.concat(F.lit("See https://doi.org/10."), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("/Part."), F.col("p_partkey").cast("string"), F.lit(".)."))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_doi(text).alias("doi"))


@query
def identifiers(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.catalogue_identifier(F.concat(F.lit("https://catalogue.example/a"), key)).alias("work"), T.orcid_identifier(F.concat(F.lit("https://orcid.org/0000-0001-"), F.lpad(key, 4, "0"), F.lit("-123x"))).alias("orcid"), T.ror_identifier(F.concat(F.lit("https://ROR.org/0"), key)).alias("ror"))


@query
def years(spark, sf_dir):
    said = F.concat(F.lit("printed "), F.year("o_orderdate").cast("string"), F.lit(", no. "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.coerce_year(said).alias("year"), T.valid_year(F.year("o_orderdate")).alias("valid"))


@query
def html_title_records(spark, sf_dir):
    title = T.squeeze(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"))


@query
def shared_id_components(spark, sf_dir):
    """Customers and nations' segments that share an identifier are one cluster."""
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("dst"))
    return connected_components(edges).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query
def ref_merge_cap(spark, sf_dir):
    """References of an order: its own, all of them, then its customer's other orders' parts while there are fewer than five."""
    own = records(spark, sf_dir).select("doc_id", "ordinal", F.col("authors")[0].alias("key"), "title", "references")
    # an order's own parts are under its customer too: it has them already
    works = own.select("key", "ordinal", F.posexplode("references").alias("at", "label")).select("key", F.struct("ordinal", "at").alias("place"), "label")
    return catalogue.merge_references(own, works).select("doc_id", F.array_join("references", "|").alias("references"), F.size("references").alias("n"))


@query
def hash_embedding(spark, sf_dir):
    v = retrieve.embed(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("v").alias("place", "x")).select("item_id", "place", F.round("x", 6).alias("x"))


@query
def cosine_topk(spark, sf_dir):
    """The five nearest vectors for every fiftieth vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", retrieve.unit(F.col("embedding").cast("array<double>")).alias("v"))
    return retrieve.top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "id"), 5, retrieve.OFFLINE_SCORE)


#: Names that questions are searched for.
NAMES = ["Then", "of the", "est", "ung"]


@query
def retrieve_modes(spark, sf_dir):
    """Every item of the benchmark as a question in hybrid and mix mode, over the whole graph of orders and the chunks of all documents."""
    nodes, edges = graph_of(spark, sf_dir)
    embed = lambda rows, *extra: rows.join(retrieve.embed(rows, "id", "text"), "id").select("id", *extra, "v")
    entities = cut(embed(nodes.select("id", F.concat_ws(" ", "id", "entity_type").alias("text"))), "entity-vectors")
    relations = edges.select(F.concat_ws("|", F.least("src", "tgt"), F.greatest("src", "tgt")).alias("id"), "src", "tgt", F.concat_ws(" ", "keywords", F.least("src", "tgt"), F.greatest("src", "tgt")).alias("text"))
    relations = cut(embed(relations, "src", "tgt"), "relation-vectors")
    parts = retrieve.chunks(table(spark, sf_dir, "documents")).select(F.concat_ws("-", "doc_id", "chunk_order_index").alias("id"), F.col("content").alias("text"))
    questions = cut(retrieve.question_vectors(table(spark, sf_dir, "benchmark"), NAMES, id_col="item_id"), "question-vectors")
    return retrieve.retrieve(questions, entities, relations, cut(embed(parts), "chunk-vectors"), ["hybrid", "mix"], 3, retrieve.OFFLINE_SCORE)


@query
def entity_tagging(spark, sf_dir):
    return retrieve.tag_entities(table(spark, sf_dir, "documents"), [("the", "Concept"), ("aux", "Method"), ("der", "Concept"), ("que", "Metric")])


@query
def extraction(spark, sf_dir):
    """What the deterministic extractor says of every document: names of a dictionary, and relations of those that stand in it together."""
    tagged = cut(retrieve.tag_entities(table(spark, sf_dir, "documents"), [("the", "Concept"), ("aux", "Method"), ("der", "Concept"), ("que", "Metric")]), "tagged")
    related = retrieve.tag_relations(tagged, [("the", "der", "alike", "Both are articles"), ("aux", "que", "French", "")])
    return retrieve.extraction_rows(tagged, related, {"the": "English", "der": "German"})


@query
def question_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(retrieve.keywords(F.col("text"), NAMES), "|").alias("keywords"))


def part_boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 20011).alias("x"), (k * 104729 % 15013).alias("y"), (200 + k % 5 * 60).alias("width"), (160 + k % 7 * 40).alias("height"))


@query
def box_overlaps(spark, sf_dir):
    return graph.box_overlaps(part_boxes(spark, sf_dir))


@query
def answers_ok(spark, sf_dir):
    answer = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" [no-context]"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieve.answer_ok(F.lit("success"), answer).alias("ok"))
