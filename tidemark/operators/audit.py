"""Comparisons of a baseline with a candidate over the same corpus, and of snapshots."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Spike
from tidemark.operators import order, tickets


def diff_snapshots(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta, change): the union of keys with new and dropped ones marked."""
    both = base.select(key, F.col(value).alias("before")).join(other.select(key, F.col(value).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "dropped").when(F.col("before") == F.col("after"), "same").otherwise("moved")
    return both.select(key, "before", "after", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"), change.alias("change"))


def movement(diff: DataFrame) -> DataFrame:
    """Keys per pair of values."""
    return diff.groupBy("before", "after").agg(F.count("*").alias("n"))


def check_expectations(diff: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, direction, passed) of (key, direction up, down or same)."""
    sign = F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same")
    rows = wanted.join(diff, key, "left")
    return rows.select(key, "direction", F.coalesce(sign == F.col("direction"), F.lit(False)).alias("passed"))


def rank_shift(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return base.select(key, F.col("rank").alias("before")).join(other.select(key, F.col("rank").alias("after")), key).withColumn("shift", F.col("before") - F.col("after"))


def band_changes(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: tickets, those whose lines, points or tier of risk differ, and the flagged ones on either side."""
    side = lambda df, mark: df.select("issue_key", *[F.col(c).alias(f"{mark}{c}") for c in ("net_loc", "points", "risk", "needs_insight")])
    both = side(base, "a_").join(side(other, "b_"), "issue_key")
    differ = lambda c: F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long"))
    flagged = lambda m: F.sum(F.col(f"{m}needs_insight").cast("long"))
    return both.agg(F.count("*").alias("tickets"), differ("net_loc").alias("lines"), differ("points").alias("points"), differ("risk").alias("risk"), flagged("a_").alias("flagged_before"), flagged("b_").alias("flagged_after"))


def movers_by_glob(base: DataFrame, other: DataFrame) -> DataFrame:
    """(risk_glob, movers): tickets whose points differ, by the glob that drives the other side's risk."""
    both = base.select("issue_key", F.col("points").alias("_p")).join(other.select("issue_key", "points", "risk_glob"), "issue_key")
    return both.where("points <> _p").groupBy("risk_glob").agg(F.count("*").alias("movers"))


def unexplained(diff: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """Movers that nothing explains: keys that moved and aren't among ``explained``."""
    return diff.where("change = 'moved'").join(explained.select(key).distinct(), key, "left_anti")


def spike_summary(rows: DataFrame, knobs: Spike = Spike()) -> DataFrame:
    """One row over investigations (as ``tickets.spike_band`` takes them, with ``described``): how many there are, have follow-ups
    or links past the threshold, moved up by these nudges and by how many points, are flagged, would be flagged but for their
    follow-ups, and have a description or a link to an artifact."""
    plain = tickets.spike_band(rows, replace(knobs, spawned=0.0, breadth=0.0)).withColumnRenamed("points", "_plain").drop("band", "straddles", "raw", "confidence", "needs_insight", "artifacts")
    both = tickets.spike_band(plain, knobs)
    count = lambda when: F.coalesce(F.sum(when.cast("long")), F.lit(0))
    up = F.col("points") > F.col("_plain")
    quiet = (F.col("cycle_days") >= knobs.cycle_days) & (F.col("artifact_links") + F.col("substantive") == 0) & (F.col("status_flips") < 4) & (F.col("spawned") > 0)
    return both.agg(
        F.count("*").alias("spikes"), count(F.col("spawned") > 0).alias("spawned"), count(F.col("breadth") > knobs.breadth_over).alias("broad"), count(up).alias("moved"),
        F.coalesce(F.sum(F.when(up, F.col("points") - F.col("_plain"))), F.lit(0)).alias("steps"), count(F.col("needs_insight")).alias("flagged"), count(quiet).alias("suppressed"),
        count(F.col("described")).alias("described"), count(F.col("artifact_links") > 0).alias("linked"),
    )


def spike_top(rows: DataFrame, key: str, top: int, knobs: Spike = Spike()) -> DataFrame:
    """The ``top`` investigations by raw effort, ties by key, with their place."""
    banded = tickets.spike_band(rows, knobs)
    return order.first_places(banded, [F.desc("raw"), F.asc(key)], top, "place")
