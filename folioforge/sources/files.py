"""Documents, graphs and canvases from files."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.sources.pdf import pdf_text

# fixed values: suffixes of what is read
TEXT_SUFFIXES, PDF_SUFFIX = ("txt", "md"), "pdf"
DOCUMENT = "path string, doc_id string, text string, status string"


def _pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns path, suffix, content: path and the text of PDF files."""
    for batch in batches:
        texts = [pdf_text(c.as_buffer().to_pybytes()) if s.as_py() == PDF_SUFFIX and c.is_valid else None for s, c in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])


def read_documents(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Documents of a folder, not of those in it, by path: path, doc_id, text, status (ok, empty, unreadable or unsupported).

    Bytes that are no UTF-8 become U+FFFD, line ends ``\\n``; of a PDF, the text of its pages, with words that a line end parts joined.
    Files of other kinds keep a row without text, so that a report can name them. A folder that is not there is empty,
    with a warning. With ``stream``, an unbounded DataFrame of files as they arrive, in no order."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = (spark.readStream if stream else spark.read).format("binaryFile").schema(schema)
    try:
        files = reader.load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"there is no folder {folder}", stacklevel=2)
        return spark.createDataFrame([], DOCUMENT)
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    plain = files.where(F.col("suffix") != PDF_SUFFIX)
    known = F.col("suffix").isin(*TEXT_SUFFIXES)
    text = F.when(known, F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n"))
    plain = plain.select("path", text.alias("text"), F.when(~known, "unsupported").when(T.strip(text) == "", "empty").otherwise("ok").alias("status"))
    pages = files.where(F.col("suffix") == PDF_SUFFIX).select("path", "suffix", "content").mapInArrow(_pdf, "path string, text string")
    pages = pages.withColumn("text", T.repair_pdf_text(F.col("text")))
    pages = pages.withColumn("status", F.when(F.col("text").isNull(), "unreadable").when(F.col("text") == "", "empty").otherwise("ok"))
    rows = plain.unionByName(pages).select("path", F.when(F.col("status") == "ok", T.document_id(F.col("text"))).alias("doc_id"), "text", "status")
    return rows if stream else rows.orderBy("path")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (src, tgt, attributes) of GraphML; attributes are a map by name. What is said again of a
    node or of a pair, in this direction, replaces what was said before: by file, then by place in it.
    The keys of a file's attributes are a few, and are joined by broadcast."""

    def rows(tag: str, schema: str) -> DataFrame:
        read = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        return read.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))

    keys = F.broadcast(rows("key", "_id string, `_attr.name` string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name")).distinct())
    data = "data array<struct<_key: string, _VALUE: string>>"

    def named(frame: DataFrame, *ends: str) -> DataFrame:
        flat = frame.select(*ends, "file", "place", F.posexplode_outer("data").alias("at", "d")).select(*ends, "file", "place", "at", F.col("d._key").alias("key"), F.coalesce("d._VALUE", F.lit("")).alias("value")).join(keys, "key", "left")
        last = flat.groupBy(*ends, "name").agg(F.max_by("value", F.struct("file", "place", "at")).alias("value"))
        pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
        return last.groupBy(*ends).agg(F.map_from_entries(pairs).alias("attributes"))

    nodes = named(rows("node", f"_id string, {data}").withColumnRenamed("_id", "id"), "id")
    return nodes, named(rows("edge", f"_source string, _target string, {data}").withColumnsRenamed({"_source": "src", "_target": "tgt"}), "src", "tgt")


def read_canvases(spark: SparkSession, path: str) -> DataFrame:
    """Canvas files as (path, content) for ``canvas.verify``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))
