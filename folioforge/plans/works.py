"""Queries of the catalogue and canvas operators. Orders stand for works, parts for nodes of canvases."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import canvas, catalogue
from folioforge.plans.biblio import query, table


def _flat(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")


def _orders(spark, sf_dir):
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("c_name").alias("c"), F.col("n_name").alias("n"), "o_orderpriority")


@query
def catalogue_open(spark, sf_dir):
    """Works of the first catalogue, written as its JSON and read back."""
    text = F.format_string(
        '{"id":"https://openalex.org/w%d","doi":"https://doi.org/10.1000/ABC.%d.","display_name":" Work  no %d ","publication_year":%d,"authorships":[{"author":{"id":"https://openalex.org/a%d","display_name":"%s","orcid":"https://orcid.org/0000-0000-0000-000x"},"institutions":[{"display_name":"%s","ror":"https://ror.org/0ab"},{"display_name":"%s"}]},{"raw_author_name":"  "},{"raw_author_name":"%s"}],"primary_location":{"source":{"display_name":"%s"}},"referenced_works":["https://openalex.org/w%d"]}',
        "k", "k", "k", 1400 + F.col("k") % 800, "k", "c", "n", "n", F.when(F.col("k") % 2 == 0, F.col("c")).otherwise(F.lit("B C")), "o_orderpriority", F.col("k") + 1,
    )
    w = catalogue.open_works(_orders(spark, sf_dir).select("k", text.alias("json")))
    return w.select("k", "work_id", "title", "doi", "year", "venue", F.array_join("authors", "|").alias("authors"), _flat("author_affiliations").alias("affiliations"), _flat("author_ids").alias("ids"), _flat("institution_ids").alias("places"), F.array_join("reference_ids", "|").alias("refs"))


@query
def catalogue_deposit(spark, sf_dir):
    """Works of the second catalogue, written as its JSON and read back."""
    text = F.format_string(
        '{"DOI":"10.1000/K%d","title":["Work %d"],"author":[{"given":"A.","family":"%s","ORCID":"https://orcid.org/0000-0000-0000-0001","affiliation":[{"name":"%s"}]},{"name":"Group %d"},{"given":""}],"container-title":["%s"],"issued":{"date-parts":[[%d]]},"created":{"date-parts":[[2001,2]]},"reference":[{"DOI":"10.1000/R%d"},{"article-title":"","unstructured":"Cited  work"},{"key":"x"}]}',
        "k", "k", "c", "n", F.col("k") % 10, "o_orderpriority", 1400 + F.col("k") % 800, "k",
    )
    w = catalogue.deposit_works(_orders(spark, sf_dir).select("k", text.alias("json")))
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["title"], F.lit("@"), F.coalesce(r["doi"], F.lit("")))), "|")
    return w.select("k", "work_id", "title", "doi", "year", "venue", F.array_join("authors", "|").alias("authors"), _flat("author_affiliations").alias("affiliations"), _flat("author_ids").alias("ids"), refs.alias("refs"))


@query
def candidate_pick(spark, sf_dir):
    """For each part, the best of three works of its title that differ in author and year."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k.alias("record_id"), F.col("p_name").alias("title"), (2000 + k % 4).cast("int").alias("year"), F.array(F.concat(F.lit("Ann Maker"), k % 3)).alias("authors"))
    i = F.col("ordinal")
    found = part.select("record_id", "title", F.explode(F.array(*map(F.lit, range(3)))).alias("ordinal"))
    found = found.select("record_id", "ordinal", F.concat(F.upper("title"), F.lit(" (1999)")).alias("title"), (2000 + (F.col("record_id") * (i + 1)) % 5).cast("int").alias("year"), F.when(i == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Maker"), (F.col("record_id") + i) % 3, F.lit(", A.")))).alias("authors"))
    picked = catalogue.pick_candidates(part, found)
    return picked.select("record_id", "ordinal", F.round("score", 6).alias("score"))


@query
def canvas_verify(spark, sf_dir):
    """Canvases of a hundred parts each, with faults by the rests of their keys."""
    k = F.col("k")
    name = lambda k: F.when(k % 11 == 0, F.concat(F.lit("P"), k)).otherwise(F.lower(F.lpad(F.hex(k), 16, "0")))
    node = F.format_string('{"id":"%s","type":"%s","x":%s,"y":%d,"width":%d,"height":200,"color":"%s"%s}', name(k), F.when(k % 13 == 0, "blob").otherwise("text"), F.when(k % 19 == 0, "1.5").otherwise((k % 10 * 500).cast("string")), F.floor(k / 10) % 10 * 300, F.when(k % 17 == 0, 0).when(k % 31 == 0, 600).otherwise(400), F.when(k % 23 == 0, "7").otherwise("#0aF9c1"), F.when(k % 29 == 0, "").otherwise(',"text":"t"'))
    edge = F.format_string('{"id":"%s","fromNode":"%s","toNode":"%s","fromSide":"%s"%s}', F.lower(F.lpad(F.hex(k + (1 << 40)), 16, "0")), name(k), name(k + 1), F.when(k % 5 == 0, "middle").otherwise("right"), F.when(k % 7 == 0, ',"color":null').otherwise(""))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(k, F.concat(F.lit("canvas-"), F.floor(k / 100)).alias("path"), node.alias("node"), edge.alias("edge"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), ",")
    files = parts.groupBy("path").agg(F.concat(F.lit('{"nodes":['), listed("node"), F.lit('],"edges":['), listed("edge"), F.lit("]}")).alias("content"))
    return canvas.verify(files)
