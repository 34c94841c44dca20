"""Streams end with what the batch form gives."""

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import elo
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, df):
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_weekly_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id")
    query = jobs.weekly_counts(_stream(spark, tmp_path, events)).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    want = events.groupBy(cal.week_start("ts").alias("week"), "user_id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("weeks").collect()} == {tuple(r) for r in want.collect()}


def test_sliding_counts_overlap(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id")
    query = jobs.sliding_counts(_stream(spark, tmp_path, events)).writeStream.format("memory").queryName("slides").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    assert spark.table("slides").agg(F.sum("n")).first()[0] == 2 * events.count()


def test_newest_once(spark, tmp_path):
    rows = spark.sql("select 'K' as key, timestamp'2024-01-01' as updated union all select 'K', timestamp'2024-01-01' union all select 'K', timestamp'2024-01-02'")
    query = jobs.newest_once(_stream(spark, tmp_path, rows), "key", "updated").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_upserts_and_ratings(spark, tmp_path):
    scores = spark.sql("select 'A' as ticket, 3 as points, 'h' as hash, timestamp'2024-01-01' as at union all select 'A', 5, 'g', timestamp'2024-01-02'")
    query = jobs.keep_in_table(_stream(spark, tmp_path, scores), f"{tmp_path}/t", f"{tmp_path}/c", jobs.upsert_scores).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    rows = [("l", p, d, o) for p, o in (("2024-P01", 0.7), ("2024-P03", 0.6), ("2024-P05", 0.2)) for d, o in (("a", o), ("b", 1 - o))]
    frame = lambda rs: spark.createDataFrame(rs, "league string, period string, dev string, outcome double")
    names = [c.split()[0] for c in jobs.RATED.split(", ")]
    step = lambda old, rs: spark.createDataFrame(jobs.rate_periods(old, frame(rs)).select(*names).collect(), jobs.RATED)  # noqa: E731  # a table between batches, as the writer keeps one
    first = step(None, rows[:1])  # the newest period waits for its other rows
    assert first.where("rating IS NOT NULL").count() == 0
    second = step(first, rows[1:4])
    third = step(second, rows[2:])  # rows that come again count once
    late = step(third, [("l", "2024-P01", "c", 0.5)])  # too late: the period has closed
    want = {(r.dev, round(r.rating, 6)) for r in elo.state_of(elo.rating_fold(frame(rows[:4]))).collect()}
    for got in (third, late):
        assert {(r.dev, round(r.rating, 6)) for r in got.where("rating IS NOT NULL").collect()} == want


def test_ratings_period_by_period_decay_the_idle(spark):
    rows = [("l", f"2024-P{p:02d}", d, 0.7 if d == "a" else 0.4) for p in range(1, 14, 2) for d in "abc" if d != "a" or p == 1]
    frame = lambda rs: spark.createDataFrame(rs, "league string, period string, dev string, outcome double")
    names, table = [c.split()[0] for c in jobs.RATED.split(", ")], None
    for p in sorted({r[1] for r in rows}):
        table = spark.createDataFrame(jobs.rate_periods(table, frame([r for r in rows if r[1] == p])).select(*names).collect(), jobs.RATED)
    want = elo.state_of(elo.rating_fold(frame([r for r in rows if r[1] < "2024-P13"])))
    key = lambda df: {(r.dev, round(r.rating, 6), r.periods_played, r.idle_streak) for r in df.where("rating IS NOT NULL").collect()}
    assert key(table) == key(want) and any(r[3] > 3 for r in key(want))
