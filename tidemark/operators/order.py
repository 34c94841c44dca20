"""Running sums, ranks and order statistics of a whole table without drawing it into one task.

Rows are dealt to partitions by ranges of the order and written once (ranges come from a sample, so a second run could deal
them otherwise); each partition is summed by itself and shifted by the sums of those before it.  What meets in one task is
one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.staging import staged


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one in the order; give an order without ties."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_run_value", value).repartitionByRange(n, *order)
    dealt = staged(ranged.withColumn("_run_part", F.spark_partition_id()), "ranged")
    sums = dealt.groupBy("_run_part").agg(F.sum("_run_value").alias("_run_sum"))
    before = sums.select("_run_part", (F.sum("_run_sum").over(W.orderBy("_run_part")) - F.col("_run_sum")).alias("_run_before"))  # a row for each partition
    within = F.sum("_run_value").over(W.partitionBy("_run_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn(name, within).join(F.broadcast(before), "_run_part").withColumn(name, F.col(name) + F.col("_run_before")).drop("_run_value", "_run_part", "_run_before")


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 1."""
    return running_sum(df, order, F.lit(1).cast("long"), name)


def first_places(df: DataFrame, order: list[Column], top: int, name: str) -> DataFrame:
    """The first ``top`` rows with their places: each partition hands on no more than that."""
    return df.orderBy(*order).limit(top).withColumn(name, F.row_number().over(W.orderBy(*order)))


def counts_upto(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """(value, n, upto): how often each value occurs and how many rows have it or one before it; nulls are left out."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_sum(sizes, [F.desc(value) if descending else F.asc(value)], F.col("n"), "upto")


def at_shares(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at index floor(share (n - 1)) of the order; no row for a table without values."""
    spark = df.sparkSession
    upto = counts_upto(df, value)
    asked = spark.createDataFrame([(float(p),) for p in shares], "share double")
    at = upto.agg(F.max("upto").alias("total")).where("total > 0").crossJoin(F.broadcast(asked)).select("share", F.floor(F.col("share") * (F.col("total") - 1)).alias("at"))
    return upto.join(F.broadcast(at), F.col("upto") > F.col("at")).groupBy("share").agg(F.min(value).alias(value))  # as many rows as shares asked for
