"""Incremental ingestion: each document once, whatever its file is called and however often it arrives."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources.files import read_documents


def known_documents(spark: SparkSession, ledger: str, before: int | None = None) -> DataFrame:
    """doc_id of the documents that ``ledger`` has, from batches ``before`` one; none, with a warning, where it cannot be read."""
    try:
        rows = spark.read.schema("doc_id string, batch long").parquet(ledger)
        return (rows if before is None else rows.where(f"batch < {before}")).select("doc_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            warnings.warn(f"{ledger} cannot be read: {e}", stacklevel=2)
        return spark.createDataFrame([], "doc_id string")


def ingest(spark: SparkSession, folder: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append documents of ``folder`` that ``ledger`` (Parquet, by batch) does not have, in one run over what has
    arrived; a later call goes on from there. Batches carry their number, and one that is repeated after
    a loss replaces its own part of the ledger. Of earlier batches only ids are read."""

    def step(batch: DataFrame, number: int) -> None:
        new = batch.where("status = 'ok'").dropDuplicates(["doc_id"])
        new = new.join(known_documents(spark, ledger, number), "doc_id", "left_anti")
        new.select("doc_id", "path", "text").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    stream = read_documents(spark, folder, stream=True)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
