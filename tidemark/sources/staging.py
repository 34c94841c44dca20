"""Tables between steps: written once in the folder that driver and executors share and read back, which cuts the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only in local mode, where none need be named, a fresh local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = named.get() if named.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-staging-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, so that a plan that goes on from it does not depend on how it came about."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def unstage(spark: SparkSession, keep: int = 0, since: int = 0) -> int:
    """Delete the tables staged after the first ``since`` but the last ``keep``; returns how many there were."""
    gone = _PATHS[since : len(_PATHS) - keep]
    del _PATHS[since : len(_PATHS) - keep]
    return sum(_delete(spark, path) for path in gone)


def count_staged() -> int:
    return len(_PATHS)
