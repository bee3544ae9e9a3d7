"""A training corpus from raw documents, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again, so that its lineage
starts at a file and a lost executor repeats tasks of one stage only. ``documents`` has its columns up
to the last stage, which adds the shard of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, mixing, ngrams, sharding, toxicity
from folioforge.plans.storage import cut

#: Sampled rounds of a model's fit and the choice of repeats by a program over lengths are no SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from those of ``docs`` that have labels. Null and empty
    texts score alike; repeated rows stay or go together; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word five-grams, Jaccard 0.8 or more) the document with the
    least doc_id stays, once. Documents without words or without a doc_id all stay, as often as they are there."""
    found = ngrams.near_duplicates(docs, shingle_words=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows that repeat an id and a text are copies of each other
    known = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return rest.where(known).dropDuplicates(["doc_id", "text"]).unionByName(rest.where(~known))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item whole, go. Null and wordless
    texts stay, and so does everything where the benchmark is empty; repeated rows stay or go together."""
    return decontaminate.remove_affected(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. Documents without words stay, once. A null
    source is a source; a repeated row is a document of its own."""
    taken = mixing.mix(docs, carry=True)
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    return taken.select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as often as it is there, with the shard that it is written to. A null id is a key, a null text has
    no bytes; a column that bears a result's name is replaced."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each keeps the columns it does not ask for, whatever they are called; an empty table
    gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
