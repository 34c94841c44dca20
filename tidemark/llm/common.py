"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    On a cluster it is the one named in ``spark.checkpoint.dir``, and it is an error if that is
    unset.  Only in local mode (tests, one machine) a fresh local folder is taken instead.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not have:
        jdir = sc._jsc.sc().getCheckpointDir()
        have = jdir.get() if jdir.isDefined() else None
    if not have:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        have = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(have)
    return have.rstrip("/")


_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, noted for ``release``."""
    _PATHS.append(f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def release(spark: SparkSession) -> int:
    """Delete what operators have written so far; call it once their results have been used. Returns the number of paths."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _PATHS:
        path = jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a written table, which ``release`` deletes like the others."""
    return written(df, "cut")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the whole text (null: empty), whatever else ``docs`` holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
