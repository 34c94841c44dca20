"""Jobs that keep their own state by key: calendar months, newest snapshots, momentum and ratings.

Each is a stateful processor behind one function.  State is let go by timers on the watermark, so it does not outlive what
may still come: a row later than ``late`` is dropped by Spark, which counts it in each batch's progress.  The state store
must be able to hold timers; ``use_state_store`` names it in the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from tidemark.config import Elo, Surge
from tidemark.functions.calendar import month_key, period_close, week_ordinal
from tidemark.operators import elo, epics

LATE = "7 days"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which holds timers and more than fits memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(progress: list) -> int:
    """Rows that came too late, by a query's ``recentProgress``."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def _timed(rows: DataFrame, when, late: str) -> DataFrame:
    """With the event time as a timestamp and, for the timers, in milliseconds; rows without one are dropped."""
    timed = rows.withColumn("_t", when.cast("timestamp")).where("_t IS NOT NULL").withColumn("_ms", F.unix_millis("_t"))
    return timed.withWatermark("_t", late)


class _MonthSums(StatefulProcessor):
    """Sums by measure of a person's month, given once the month is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getMapState("sums", "measure string", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found: dict[str, float] = {}
        for r in rows:
            found[r.measure] = found.get(r.measure, 0.0) + r.value
            ends = r._ends
        for measure, value in found.items():
            before = self.sums.getValue((measure,)) if self.sums.containsKey((measure,)) else None
            self.sums.updateValue((measure,), ((before[0] if before else 0.0) + value,))
        self.handle.registerTimer(ends)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        out = [Row(dev=key[0], bucket=key[1], measure=m[0], value=v[0]) for m, v in self.sums.iterator()]
        self.sums.clear()
        return iter(out)

    def close(self) -> None:
        pass


def month_sums(facts: DataFrame, late: str = LATE) -> DataFrame:
    """(dev, bucket, measure, value) of a stream of facts (dev, ts, measure, value): calendar months, each given once, when the
    watermark has passed its end; rows late by up to ``late`` still count."""
    rows = _timed(facts.where("dev IS NOT NULL AND measure IS NOT NULL AND value IS NOT NULL"), F.col("ts"), late)
    ends = F.unix_millis(F.add_months(F.date_trunc("month", "_t").cast("date"), 1).cast("timestamp"))
    rows = rows.select("dev", month_key("_t").alias("bucket"), "measure", F.col("value").cast("double").alias("value"), ends.alias("_ends"), "_t")
    return rows.groupBy("dev", "bucket").transformWithState(_MonthSums(), "dev string, bucket string, measure string, value double", "append", "eventtime")


class _Newest(StatefulProcessor):
    """The newest version of a key, given whenever it changes and let go once no older one can come."""

    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        names = self.schema.fieldNames()
        place = [names.index(c) for c in ("_ms", *self.order)]
        rank = lambda r: tuple((r[i] is not None, r[i]) for i in place)  # noqa: E731  # missing values are the lowest
        had = self.newest.get()
        best = had
        for r in rows:
            best = r if best is None or rank(r) > rank(best) else best
        if best is had:
            return iter(())
        self.newest.update(tuple(best))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(best[names.index("_ms")] + 1)
        return iter([Row(**dict(zip(names, tuple(best))))])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_snapshots(rows: DataFrame, key: str, updated: str, order: tuple[str, ...] = (), late: str = LATE) -> DataFrame:
    """The newest version of each key of a stream (by ``updated``, then ``order``, the later one at equal values), given again
    whenever it changes; an older version that comes after it is never given."""
    timed = _timed(rows.where(F.col(key).isNotNull()), F.col(updated), late)
    names = [f for f in timed.schema.fields if f.name != "_t"]
    schema = StructType([StructField(f.name, f.dataType, True) for f in names])
    found = timed.select(*[f.name for f in names], "_t").groupBy(key).transformWithState(_Newest(schema, list(order)), schema, "update", "eventtime")
    return found.drop("_ms")


def latest_of(given: DataFrame, key: str, updated: str, order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key of a table to which ``newest_snapshots`` was appended."""
    whole = F.struct(*given.columns)
    return given.groupBy(key).agg(F.max_by(whole, F.struct(updated, *order)).alias("_row")).select("_row.*")


_RING = "epic_key string, ring array<struct<week:bigint,issues:bigint,prs:bigint,commits:bigint>>, first_week bigint, peak_busy bigint, peak_week bigint, active_weeks bigint, prs bigint, commits bigint"


class _Rings(StatefulProcessor):
    """An epic's counts of its last weeks and what is known of those before."""

    def __init__(self, weeks: int):
        self.weeks = weeks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "week bigint", "issues bigint, prs bigint, commits bigint")
        self.past = handle.getValueState("past", "first_week bigint, peak_busy bigint, peak_week bigint, active_weeks bigint, prs bigint, commits bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ring = {int(w[0]): [int(x) for x in v] for w, v in self.ring.iterator()}
        touched = set()
        for r in rows:
            at = ring.setdefault(r.week, [0, 0, 0])
            at[0], at[1], at[2] = at[0] + r.issues, at[1] + r.prs, at[2] + r.commits
            touched.add(r.week)
        past = self.past.get()
        first, busy, peak, active, prs, commits = tuple(past) if past else (None, 0, None, 0, 0, 0)
        newest = max(ring)
        for week in sorted(w for w in ring if w <= newest - self.weeks):  # no late row reaches these any more
            issues, p, c = ring.pop(week)
            first = week if first is None else min(first, week)
            if issues + p + c > busy:
                busy, peak = issues + p + c, week
            active, prs, commits = active + (issues + p + c > 0), prs + p, commits + c
            if self.ring.containsKey((week,)):
                self.ring.removeKey((week,))
        for week in touched & set(ring):
            self.ring.updateValue((week,), tuple(ring[week]))
        self.past.update((first, busy, peak, active, prs, commits))
        cells = [Row(week=w, issues=v[0], prs=v[1], commits=v[2]) for w, v in sorted(ring.items())]
        return iter([Row(epic_key=key[0], ring=cells, first_week=first, peak_busy=busy, peak_week=peak, active_weeks=active, prs=prs, commits=commits)])

    def close(self) -> None:
        pass


def epic_rings(events: DataFrame, late: str = LATE, knobs: Surge = Surge()) -> DataFrame:
    """A stream of (epic_key, ts, issues, prs, commits) as each epic's weekly counts: those of the weeks that momentum looks at
    one by one, older ones as sums.  An epic's row is given anew whenever something happens in it."""
    rows = _timed(events.where("epic_key IS NOT NULL"), F.col("ts"), late)
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("issues", "prs", "commits")]
    rows = rows.select("epic_key", week_ordinal("_t").cast("long").alias("week"), *counts, "_t")
    return rows.groupBy("epic_key").transformWithState(_Rings(knobs.recent + knobs.baseline), _RING, "update", "eventtime")


def ring_momentum(rings: DataFrame, knobs: Surge = Surge(), anchor: int | None = None) -> DataFrame:
    """``epics.momentum`` from the last row of each epic of ``epic_rings``; the anchor is the newest week of any or a later one."""
    weeks = rings.select("epic_key", F.explode("ring").alias("w")).select("epic_key", "w.*")
    found = epics.momentum(weeks, knobs, anchor)
    past = rings.select("epic_key", *[F.col(c).alias(f"_{c}") for c in ("first_week", "peak_busy", "peak_week", "active_weeks", "prs", "commits")])
    peak = weeks.groupBy("epic_key").agg(F.max(F.col("issues") + F.col("prs") + F.col("commits")).alias("_busy"))
    out = found.join(past, "epic_key").join(peak, "epic_key")
    earlier = F.col("_peak_busy") >= F.col("_busy")  # at equal counts the earlier week
    return out.withColumns(
        {
            "first_week": F.coalesce("_first_week", "first_week"), "peak_week": F.when(earlier & (F.col("_peak_busy") > 0), F.col("_peak_week")).otherwise(F.col("peak_week")),
            "active_weeks": F.col("active_weeks") + F.col("_active_weeks"), "prs": F.col("prs") + F.col("_prs"), "commits": F.col("commits") + F.col("_commits"),
        }
    ).select(found.columns)


class _Ratings(StatefulProcessor):
    """A league's people and the outcomes of its periods that aren't over."""

    def __init__(self, knobs: Elo):
        self.knobs = knobs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.people = handle.getMapState("people", "dev string", "rating double, periods_played bigint, idle_streak bigint")
        self.waiting = handle.getMapState("waiting", "period string, dev string", "outcome double, closes bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            if not self.waiting.containsKey((r.period, r.dev)):  # rows that come again count once
                self.waiting.updateValue((r.period, r.dev), (r.outcome, r._ms))
                self.handle.registerTimer(r._ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(k[0], k[1], v[0]) for k, v in self.waiting.iterator() if v[1] <= now]
        if not over:
            return iter(())
        known = [(k[0], *v) for k, v in self.people.iterator()]
        state = pd.DataFrame(known, columns=["dev", "rating", "periods_played", "idle_streak"])
        found = elo.walk(pd.DataFrame(over, columns=["period", "dev", "outcome"]), state, self.knobs, hand_on=True)
        for period, dev, _ in over:
            self.waiting.removeKey((period, dev))
        out = []
        for r in found.itertuples(index=False):
            if r.kind == elo.STATE:
                self.people.updateValue((r.dev,), (float(r.rating), int(r.periods_played), int(r.idle_streak)))
            else:
                outcome = None if pd.isna(r.outcome) else float(r.outcome)
                out.append(Row(league=key[0], dev=r.dev, period=r.period, kind=r.kind, outcome=outcome, delta=float(r.delta), rating=float(r.rating), periods_played=int(r.periods_played), idle_streak=int(r.idle_streak)))
        return iter(out)

    def close(self) -> None:
        pass


def rating_stream(outcomes: DataFrame, knobs: Elo = Elo(), late: str = LATE) -> DataFrame:
    """History rows (``elo.HISTORY``) of a stream of outcomes (league, period, dev, outcome), given as periods come to be over.

    A league's state is its people, idle ones with their streaks, and the outcomes of its open periods.  A period is applied
    when the watermark has passed the day it closes: once the stream holds a period that closes ``late`` after that."""
    rows = outcomes.where("league IS NOT NULL AND dev IS NOT NULL AND period IS NOT NULL")
    rows = _timed(rows, period_close("period"), late).select("league", "period", "dev", "outcome", "_ms", "_t")
    return rows.groupBy("league").transformWithState(_Ratings(knobs), elo.HISTORY, "append", "eventtime")
