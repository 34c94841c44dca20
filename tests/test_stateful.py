"""Stateful streams over several files and a restart, against the batch forms."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import elo, epics, flow, rollup
from tidemark.plans import activity
from tidemark.plans.corpus import frame
from tidemark.streaming import state

SF = "/root/testdata/sf0.001"


class Feed:
    """A folder that a stream reads file by file; each ``add`` is one more file, each ``run`` starts the query anew from its checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        state.use_state_store(spark)
        self.spark, self.path, self.schema, self.n, self.progress = spark, tmp_path, schema, 0, []

    def add(self, df):
        self.n += 1
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, build, mode):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        keep = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{self.path}/out")
        query = build(rows).writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{self.path}/check").start()
        query.awaitTermination(240)
        assert query.exception() is None
        self.progress += query.recentProgress
        return self.spark.read.parquet(f"{self.path}/out")


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_months(spark, tmp_path, few_partitions):
    facts = activity._facts(lambda name: frame(spark, SF, name)).select("dev", F.col("ts").cast("timestamp").alias("ts"), "measure", F.col("value").cast("double").alias("value")).where("ts >= '1996-01-01' AND ts < '1996-09-20'").cache()
    feed = Feed(spark, tmp_path, facts.schema)
    late = facts.where("ts BETWEEN '1996-03-28' AND '1996-04-01'")  # comes with the next file, within the seven days
    feed.add(facts.where("ts < '1996-04-03'").subtract(late))
    feed.add(late)
    feed.run(state.month_sums, "append")
    feed.add(facts.where("ts >= '1996-04-03'"))
    feed.add(facts.where("ts BETWEEN '1996-02-01' AND '1996-02-09'"))  # too late: dropped
    got = feed.run(state.month_sums, "append")
    # repeated facts collapse in subtract: compare with what was fed
    fed = facts.where("ts < '1996-04-03'").subtract(late).unionByName(late).unionByName(facts.where("ts >= '1996-04-03'"))
    want = fed.where("ts < '1996-09-01'").groupBy("dev", cal.month_key("ts").alias("bucket"), "measure").agg(F.sum("value").alias("value"))
    want = want.where(F.col("bucket") <= got.agg(F.max("bucket")).first()[0])
    key = ("dev", "bucket", "measure", F.round("value", 6))
    assert _rows(got, *key) == _rows(want, *key)
    assert got.agg(F.max("bucket")).first()[0] == "1996-08"
    assert state.late_rows(feed.progress) > 0


def test_newest_snapshots(spark, tmp_path, few_partitions):
    old = [("A", "2024-01-01", 1, "a1"), ("B", "2024-01-05", 2, "b1"), ("B", "2024-01-05", 3, "b2"), ("C", "2024-01-03", 4, None)]
    mid = [("A", "2023-12-30", 9, "older, in time"), ("A", "2024-01-04", 5, "a2"), ("C", "2024-01-03", 4, "the same version")]
    new = [("D", "2024-03-01", 6, "d1"), ("A", "2024-01-02", 7, "a1.5")]
    gone = [("A", "2023-11-01", 99, "much too late"), ("B", "2024-03-02", 8, "b3"), (None, "2024-03-03", 1, "no key"), ("E", None, 1, "no time")]
    schema = "issue_key string, updated string, issue_ord long, v string"
    make = lambda rows: spark.createDataFrame(rows, schema).withColumn("updated", F.col("updated").cast("timestamp"))
    feed = Feed(spark, tmp_path, make(old).schema)
    build = lambda rows: state.newest_snapshots(rows, "issue_key", "updated", ("issue_ord",))
    for part in (old, mid, new):
        feed.add(make(part))
    three = feed.run(build, "update")
    batch = flow.latest_snapshot(make(old + mid + new))
    got = state.latest_of(three, "issue_key", "updated", ("issue_ord",))
    assert _rows(got, "issue_key", "issue_ord") == _rows(batch, "issue_key", "issue_ord")
    feed.add(make(gone))
    given = feed.run(build, "update")
    assert not given.where("v IN ('older, in time', 'a1.5', 'much too late')").count()
    assert {(r.issue_key, r.v) for r in state.latest_of(given.drop("_batch"), "issue_key", "updated", ("issue_ord",)).collect()} == {("A", "a2"), ("B", "b3"), ("C", None), ("D", "d1")}


def test_momentum(spark, tmp_path, few_partitions):
    t = lambda name: frame(spark, SF, name)
    issues, prs, commits = t("issues"), t("prs"), t("commits")
    item = lambda when, *n: ["epic_key", F.col(when).cast("timestamp").alias("ts"), *[F.lit(x).cast("long").alias(c) for c, x in zip(("issues", "prs", "commits"), n)]]
    events = issues.where("epic_key <> ''").select(*item("updated", 1, 0, 0))
    requests = epics.item_epics(prs.withColumn("at", F.coalesce("merged", "created")), issues, ["repo", "pr_number"])
    events = events.unionByName(requests.select(*item("at", 0, 1, 0))).unionByName(epics.item_epics(commits, issues, ["sha"]).select(*item("committed", 0, 0, 1)))
    events = events.where(cal.week_ordinal("ts") <= 1600).cache()
    feed = Feed(spark, tmp_path, events.schema)
    cuts = ["1900-01-01", "1998-01-01", "2000-07-05", "2100-01-01"]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        feed.add(events.where((F.col("ts") >= a) & (F.col("ts") < b)))
        if k != 1:
            given = feed.run(state.epic_rings, "update")
    rings = given.groupBy("epic_key").agg(F.max_by(F.struct(*given.columns), "_batch").alias("r")).select("r.*")
    weeks = epics.epic_weeks(issues, prs, commits).where("week <= 1600")
    columns = ["epic_key", "recent", "baseline", "first_week", "last_week", "peak_week", "active_weeks", "prs", "commits", F.round("momentum", 9), "state", "trigger"]
    for anchor in (None, 1600, 1601):
        want = _rows(epics.momentum(weeks, anchor=anchor), *columns)
        assert _rows(state.ring_momentum(rings, anchor=anchor), *columns) == want and want


def test_ratings(spark, tmp_path, few_partitions):
    away = {"a": {1, 2, 3, 4, 5, 6}, "b": {2, 3}, "c": set(), "d": {0, 1}}
    labels = [f"2024-P{2 * p + 1:02d}" for p in range(9)]
    rows = [(lg, labels[p], d, 0.2 + 0.1 * ((p * 5 + ord(d) + len(lg)) % 7)) for lg in ("l", "other") for p in range(9) for d in "abcd" if p not in away[d]]
    make = lambda rs: spark.createDataFrame(rs, "league string, period string, dev string, outcome double")
    feed = Feed(spark, tmp_path, make(rows).schema)
    feed.add(make([r for r in rows if r[1] <= labels[2]]))
    feed.add(make([r for r in rows if r[1] == labels[3]][:3]))
    feed.run(state.rating_stream, "append")
    feed.add(make([r for r in rows if labels[3] <= r[1] <= labels[5]]))  # some come again
    feed.add(make([r for r in rows if labels[6] <= r[1]] + [("l", labels[0], "z", 0.9)]))  # the last is too late
    got = feed.run(state.rating_stream, "append")
    want = elo.rating_walk(make([r for r in rows if r[1] < labels[-1]]))  # the last period is still open
    key = ("league", "period", "dev", "kind", F.round("rating", 9), "periods_played", "idle_streak")
    assert _rows(got, *key) == _rows(want, *key)
    assert want.where("kind = 'decay'").count() > 0
