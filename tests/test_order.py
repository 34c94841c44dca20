"""Running sums, ranks and order statistics over ranges against plain sorting."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import order, ranking, tickets


def _table(spark, n=500):
    rng = random.Random(11)
    rows = [(f"d{i:03d}", rng.choice([None, 1.0, 2.0, 2.0, 2.0, rng.random() * 5]), rng.randint(-3, 9), 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "dev string, score double, v long, _value int").repartition(7)


def test_running_sums_and_row_numbers(spark):
    rows, df = _table(spark)
    got = {r.dev: (r.upto, r.place) for r in order.row_numbers(order.running_sum(df, [F.desc("dev")], F.col("v"), "upto"), [F.col("score").desc_nulls_last(), F.asc("dev")], "place").collect()}
    total, want = 0, {}
    for dev, _, v, _ in sorted(rows, reverse=True):
        total += v
        want[dev] = total
    line = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: (want[r[0]], i + 1) for i, r in enumerate(line)}
    assert order.running_sum(df.where("v > 100"), [F.asc("dev")], F.col("v"), "upto").count() == 0


def test_mid_ranks_of_a_whole_table(spark):
    rows, df = _table(spark)
    key = lambda r: (r[1] is None, -(r[1] or 0))
    line = sorted(rows, key=key)
    places = {}
    for i, r in enumerate(line):
        places.setdefault(key(r), []).append(i + 1)
    got = {r.dev: r.place for r in ranking.mid_ranks(df, "score", "place", []).collect()}
    assert got == {r[0]: sum(places[key(r)]) / len(places[key(r)]) for r in rows}
    one = {r.dev: r.place for r in ranking.mid_ranks(df.withColumn("p", F.lit("x")), "score", "place", ["p"]).collect()}
    assert got == one


def test_ranks_and_places(spark):
    rows, df = _table(spark)
    line = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    ranked = ranking.rank_cohort(df.where("score IS NOT NULL"), []).orderBy("rank").collect()
    assert [r.dev for r in ranked] == [r[0] for r in line] and [r["rank"] for r in ranked] == list(range(1, len(line) + 1))
    top = ranking.sort_people(df, "score", 5).orderBy("place").collect()
    assert [(r.dev, r.place) for r in top] == [(r[0], i + 1) for i, r in enumerate(line[:5])]
    assert ranking.sort_people(df, "score").agg(F.max("place")).first()[0] == len(rows)


def test_quantiles_by_index(spark):
    rng = random.Random(5)
    hours = [rng.choice([0.0, 24.0, 48.0, rng.random() * 999]) for _ in range(300)]
    df = spark.createDataFrame([(h, 0.0, None, None) for h in hours], "active_hours double, cycle_hours double, created timestamp, resolved timestamp")
    days = sorted(h / 24 for h in hours if h > 0)
    got = {r.share: r.days for r in tickets.cycle_quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == {s: days[math.floor(s * (len(days) - 1))] for s in (0.0, 0.25, 0.5, 0.9, 1.0)}
    assert tickets.cycle_quantiles(df.where("active_hours < 0"), [0.5]).count() == 0
