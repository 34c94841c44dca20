"""The incremental sides as Structured Streaming: weekly counts, upserts, ratings and versions.

Every job takes a streaming DataFrame; state is bounded by its watermark or kept in tables.  Those that keep state of their
own by key (months, newest snapshots, momentum, ratings) are in ``state``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import elo, tickets

LATE = "7 days"
#: Windows start at the epoch, a Thursday; four days on is a Monday.
MONDAY = "4 days"


def weekly_counts(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("user_id",), late: str = LATE) -> DataFrame:
    """Monday-aligned weeks; rows late by up to a week still count, then the week is frozen."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", "7 days", "7 days", MONDAY).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("week"), *keys, "n")


def sliding_counts(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("user_id",), late: str = LATE) -> DataFrame:
    """Two-week windows that start each Monday: the recent side of momentum."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", "14 days", "7 days", MONDAY).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("start"), *keys, "n")


def newest_once(rows: DataFrame, key: str, updated: str, late: str = LATE) -> DataFrame:
    """Each version of a key once, within the watermark."""
    timed = rows.withColumn("_t", F.col(updated).cast("timestamp")).withWatermark("_t", late)
    return timed.dropDuplicatesWithinWatermark([key, updated]).drop("_t")


def keep_in_table(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2) -> DataStreamWriter:
    """A writer whose batches replace a table by ``step(old, batch)``: the new version is written beside the old ones, of which
    the last ``keep`` stay, so that a batch that is run again finds the version it began from."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a missing earlier version is an error: only the first batch of a checkpoint begins from nothing
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        step(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > keep:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - keep - 1}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def upsert_scores(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Idempotent: a batch that comes twice changes nothing."""
    have = old if old is not None else batch.sparkSession.createDataFrame([], "ticket string, points int, source string, hash string, posted boolean")
    newest = batch.groupBy("ticket").agg(F.max_by("points", "at").alias("points"), F.max_by("hash", "at").alias("hash"))
    return tickets.upsert(have, newest).drop("outcome")


RATED = "league string, dev string, rating double, periods_played long, idle_streak long, last_period string, period string, outcome double"


def rate_periods(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State after a batch of outcomes (league, period, dev, outcome).

    A league's newest period may still get rows and waits in the table (rows with a period); those before it are over and
    are applied once, in order.  Rows of a period that was applied come too late and are dropped."""
    have = old if old is not None else batch.sparkSession.createDataFrame([], RATED)
    waiting = have.where("period IS NOT NULL").select("league", "period", "dev", "outcome").unionByName(batch.select("league", "period", "dev", "outcome"))
    state = have.where("period IS NULL").select("league", "dev", "rating", "periods_played", "idle_streak", "last_period")
    done = state.groupBy("league").agg(F.max("last_period").alias("_done"))
    newest = waiting.groupBy("league").agg(F.max("period").alias("_newest"))
    fresh = waiting.join(done, "league", "left").where("_done IS NULL OR period > _done").join(newest, "league").dropDuplicates(["league", "period", "dev"])
    over = fresh.where("period < _newest").select("league", "period", "dev", "outcome")
    moved = elo.state_of(elo.rating_fold(over, state.drop("last_period")))  # everyone known, idle ones too
    last = over.groupBy("league").agg(F.max("period").alias("_new")).join(done, "league", "full").select("league", F.greatest("_new", "_done").alias("last_period"))
    rated = state.drop("last_period").join(moved.select("league", "dev"), ["league", "dev"], "left_anti").unionByName(moved).join(last, "league")
    rated = rated.withColumns({"period": F.lit(None).cast("string"), "outcome": F.lit(None).cast("double")})
    left = fresh.where("period = _newest").select("league", "dev", "period", "outcome")
    return rated.unionByName(left, allowMissingColumns=True)
