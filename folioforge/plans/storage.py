"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset (tests, a laptop), a temporary folder
is made and set, which only local mode can use.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_sweeping: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``; removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='folioforge-')}"
            spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/folioforge-{spark.sparkContext.applicationId}"
    if folder not in _sweeping:
        _sweeping.add(folder)
        atexit.register(_sweep, spark, folder)
    return folder


def _sweep(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # noqa: BLE001  the session may have ended before; there is nobody left to tell
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: its lineage ends here,
    and a lost executor costs one task and not the plan above it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` has written, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of any file system that Spark knows, in UTF-8; it appears whole."""
    jvm = spark.sparkContext._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(beside)
    out.write(text.encode())
    out.close()
    system.delete(where, False)
    system.rename(beside, where)
