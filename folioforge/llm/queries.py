"""The thin queries over the operators of this subpackage: each applies its operator, with
production parameters, to its whole table and derives the columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, embeddings, lm, mixing, ngrams, pii, sharding, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(number(k) for k in pii.KINDS),
        F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_sanitise": op1_sanitise}


def op2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op2_archive"] = op2_archive


#: Fixed values of the rules that op5 is asked for.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, verdict)")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs).select("doc_id", "bytes", "shard", "depth", "page", "shard_bytes")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES |= {"op5_url_rules": op5_url_rules, "op7_shards": op7_shards, "op9_mix": op9_mix}


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES["op10_decontaminate"] = op10_decontaminate


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES["op8_toxicity"] = op8_toxicity


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op6_near_duplicates"] = op6_near_duplicates


def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES["op4_embedding_duplicates"] = op4_embedding_duplicates


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


QUERIES["op3_lm_scores"] = op3_lm_scores
