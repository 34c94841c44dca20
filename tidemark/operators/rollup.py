"""Zero-filled activity roll-ups, window totals and comparisons.

All people, buckets and windows are done by one attribution and one grouping each.  Additive
measures are sums; distinct ones (files, weeks, keys) are taken again over each window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Impact
from tidemark.functions.calendar import iso_week, month_key, period_label, period_start, week_start
from tidemark.operators import people

MEASURES = ("touched", "created", "resolved", "story_points", "scored", "prs_created", "prs_merged", "loc", "commits", "reviewed")


def facts(issues: DataFrame, prs: DataFrame, commits: DataFrame, reviews: DataFrame) -> DataFrame:
    """(dev, ts, measure, value) of attributed tables: one long table that every bucket groups.

    Each source is read and attributed once; each of its rows gives an array of its facts."""

    def fact(ts: str, name: str, value: Column = F.lit(1), when: Column = F.lit(True)) -> Column:
        return F.when(F.col(ts).isNotNull() & when, F.struct(F.col(ts).alias("ts"), F.lit(name).alias("measure"), value.cast("double").alias("value")))

    points = F.col("story_points") > 0
    sources = [
        (issues, [fact("updated", "touched"), fact("created", "created"), fact("resolved", "resolved"), fact("resolved", "story_points", F.col("story_points"), points), fact("resolved", "scored", when=points)]),
        (prs, [fact("created", "prs_created"), fact("merged", "prs_merged"), fact("merged", "loc", F.col("additions") + F.col("deletions"))]),
        (commits, [fact("committed", "commits")]),
        (reviews, [fact("submitted", "reviewed")]),
    ]
    return reduce(DataFrame.unionAll, [df.select("dev", F.inline(F.array_compact(F.array(*own)))) for df, own in sources])


def dated(issues: DataFrame, prs: DataFrame, commits: DataFrame, reviews: DataFrame, roster: DataFrame, logins: DataFrame) -> DataFrame:
    """(dev, day, measures): attributed facts with a column for each measure, so that sums compare no names and no label is made of
    each fact.  A source's row gives one row for each of its times; bots are left out by their logins on the roster."""

    def own(df: DataFrame, facts: dict[str, dict[str, Column]]) -> DataFrame:
        names = list(dict.fromkeys(m for found in facts.values() for m in found))
        at = [F.struct(F.to_date(ts).alias("day"), *[found.get(m, F.lit(0.0)).cast("double").alias(m) for m in names]) for ts, found in facts.items()]
        rows = df.select("dev", F.inline(F.array(*at))).where("day IS NOT NULL")
        return rows.select("dev", "day", *[F.coalesce(m, F.lit(0.0)).alias(m) if m in names else F.lit(0.0).alias(m) for m in MEASURES])

    one, points = F.lit(1.0), F.col("story_points") > 0
    sources = [
        own(people.attribute_issues(issues, roster), {"updated": {"touched": one}, "created": {"created": one}, "resolved": {"resolved": one, "story_points": F.when(points, F.col("story_points")), "scored": F.when(points, one)}}),
        own(people.attribute_github(prs, logins, "author"), {"created": {"prs_created": one}, "merged": {"prs_merged": one, "loc": F.col("additions") + F.col("deletions")}}),
        own(people.attribute_github(commits, logins, "author"), {"committed": {"commits": one}}),
        own(people.attribute_github(reviews, people.drop_bots(logins, "login"), "reviewer"), {"submitted": {"reviewed": one}}),
    ]
    return reduce(DataFrame.unionAll, sources)


def person_totals(rows: DataFrame) -> DataFrame:
    """(dev, measures, active_weeks) of ``dated`` rows: weeks are bits of a word for each 64 of them, so that rows of a person meet before they travel."""
    week = F.floor((F.unix_date("day") - 4) / 7)
    words = rows.groupBy("dev", F.floor(week / 64).alias("_word")).agg(*[F.sum(m).alias(m) for m in MEASURES], F.bit_or(_bit(F.pmod(week, F.lit(64)))).alias("_weeks"))
    return words.groupBy("dev").agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum(F.bit_count("_weeks")).alias("active_weeks"))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def attributed(issues: DataFrame, prs: DataFrame, commits: DataFrame, reviews: DataFrame, roster: DataFrame, logins: DataFrame) -> DataFrame:
    return facts(
        people.attribute_issues(issues, roster),
        people.attribute_github(prs, logins, "author"),
        people.attribute_github(commits, logins, "author"),
        people.attribute_github(people.drop_bots(reviews, "reviewer"), logins, "reviewer"),
    )


def rollup(rows: DataFrame, bucket: Column, spine: DataFrame, roster: DataFrame, name: str = "bucket") -> DataFrame:
    """One row per person and bucket of the spine, measures zero-filled."""
    own = rows.groupBy("dev", bucket.alias(name)).agg(*[F.sum(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in MEASURES])
    grid = roster.select("dev").crossJoin(spine.select(name))  # people x buckets: the result's own size
    return grid.join(own, ["dev", name], "left").fillna(0.0, list(MEASURES))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Measures and active weeks for each key."""
    week = F.when(F.col("measure").isin("touched", "created", "resolved", "prs_created", "prs_merged", "reviewed", "commits"), week_start("ts"))
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in MEASURES], F.countDistinct(week).alias("active_weeks"))


def unique_files(prs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct paths of merged pull requests for each key."""
    merged = prs.where("merged IS NOT NULL").select("repo", "pr_number", *keys)
    return merged.join(files.select("repo", "pr_number", "path"), ["repo", "pr_number"]).groupBy(*keys).agg(F.countDistinct("path").alias("unique_files"))


def code_impact(files: Column, loc: Column, prs: Column, knobs: Impact = Impact()) -> Column:
    inside = knobs.alpha * files + knobs.beta * F.greatest(loc, F.lit(0.0)) + knobs.gamma * prs
    return F.when(inside > 0, F.sqrt(inside)).otherwise(0.0)


def unknown_facts(issues: DataFrame, prs: DataFrame, commits: DataFrame, reviews: DataFrame, roster: DataFrame, logins: DataFrame) -> DataFrame:
    """Facts of nobody on the roster, as of one person named 'unknown'; its issues keep their resolution."""
    name = lambda df: df.withColumn("dev", F.lit("unknown"))
    lost = [people.unknown_github(df, logins, c) for df, c in ((prs, "author"), (commits, "author"), (reviews, "reviewer"))]
    return facts(name(people.unknown_issues(issues, roster)), *map(name, lost))


def own_moves(changelog: DataFrame, roster: DataFrame) -> DataFrame:
    """Moves into work, review or QA by who made them."""
    moves = changelog.where(F.col("to_status").isin("In Progress", "Code Review", "Ready QA", "In QA"))
    return moves.join(roster.select("dev", F.col("account").alias("author")), "author")


def progressed(changelog: DataFrame, roster: DataFrame, keys: list[Column]) -> DataFrame:
    """Distinct issues that each person moved into work, review or QA."""
    return own_moves(changelog, roster).groupBy("dev", *keys).agg(F.countDistinct("issue_key").alias("progressed"))


def reported(issues: DataFrame, roster: DataFrame) -> DataFrame:
    return issues.join(roster.select("dev", F.col("account").alias("reporter")), "reporter")


def issues_created(issues: DataFrame, roster: DataFrame, keys: list[Column]) -> DataFrame:
    return reported(issues, roster).groupBy("dev", *keys).agg(F.countDistinct("issue_key").alias("created_keys"))


def window_totals(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Measures of each person in several overlapping windows at once.  Windows begin and end at midnight, so facts are
    summed per day first; what is left meets the few windows in a range join."""
    daily = rows.groupBy("dev", "measure", F.col("ts").cast("date").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("value"))
    met = daily.join(F.broadcast(windows), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("stop")))  # a row per window asked for
    return totals(met, ["dev", "window"])


def keys_in_windows(rows: DataFrame, ts: str, key: str, windows: DataFrame, name: str) -> DataFrame:
    """(dev, window, name): distinct keys of each person in each window, taken again per window."""
    daily = rows.select("dev", F.col(key).alias("_k"), F.col(ts).cast("date").cast("timestamp_ntz").alias("_t")).distinct()
    met = daily.join(F.broadcast(windows), (F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("stop")))
    return met.groupBy("dev", "window").agg(F.countDistinct("_k").alias(name))


def daily_sketches(rows: DataFrame, ts: str, key: str, log_k: int = 12) -> DataFrame:
    """(dev, day, keys): a mergeable sketch of the distinct keys of each person and day, to be kept beside the exact rows."""
    return rows.where(F.col(key).isNotNull()).groupBy("dev", F.col(ts).cast("date").alias("day")).agg(F.hll_sketch_agg(F.col(key).cast("string"), log_k).alias("keys"))


def sketched_in_windows(sketches: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """(dev, window, name): about how many distinct keys each person has in each window, by merging the days' sketches alone.

    The opt-in to ``keys_in_windows``: 4096 registers (``log_k`` 12) give a relative standard error of 1.6 %, small sets are exact."""
    day = F.col("day").cast("timestamp_ntz")
    met = sketches.join(F.broadcast(windows), (day >= F.col("start")) & (day < F.col("stop")))
    return met.groupBy("dev", "window").agg(F.hll_sketch_estimate(F.hll_union_agg("keys")).alias(name))


def compare_windows(found: DataFrame, base: str, other: str, measure: str) -> DataFrame:
    """Delta and percentage of a measure between two windows."""
    side = lambda w, name: found.where(F.col("window") == w).select("dev", F.col(measure).alias(name))
    both = side(base, "now").join(side(other, "before"), "dev", "full").fillna(0.0, ["now", "before"])
    delta = F.col("now") - F.col("before")
    return both.select("dev", "now", "before", delta.alias("delta"), F.when(F.col("before") != 0, 100 * delta / F.abs("before")).alias("percent"))


def period_totals(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Measures, active weeks and distinct issues moved (``own_moves``) of each person and bi-weekly period, for all periods at
    once, of ``dated`` rows.  Periods go by their first day; the label is made of that, once a person and period."""
    busy = reduce(Column.__add__, [F.col(m) for m in ("touched", "prs_created", "prs_merged", "commits", "reviewed")]) > 0
    second = F.weekofyear("day") % 2 == 0
    kept = [m for m in MEASURES if m not in ("story_points", "scored")]
    own = rows.groupBy("dev", period_start("day").alias("_first")).agg(*[F.sum(m).alias(m) for m in kept], F.bit_or(F.when(busy, F.when(second, 2).otherwise(1)).otherwise(0)).alias("_weeks"))
    moved = moves.groupBy("dev", period_start("at").alias("_first")).agg(F.countDistinct("issue_key").alias("progressed"))
    found = own.join(moved, ["dev", "_first"], "left").fillna(0, ["progressed"])
    return found.select("dev", period_label("_first").alias("period"), *kept, F.bit_count("_weeks").cast("long").alias("active_weeks"), "progressed")


def active_people(monthly: DataFrame, bucket: str) -> DataFrame:
    busy = F.col("prs_merged") + F.col("commits") + F.col("resolved") + F.col("reviewed") + F.col("touched") > 0
    return monthly.groupBy(bucket).agg(F.countDistinct(F.when(busy, F.col("dev"))).alias("active"))


def grouped_counts(prs: DataFrame) -> DataFrame:
    """Pull requests and lines over several groupings in one pass."""
    loc = F.col("additions") + F.col("deletions")
    sets = prs.cube("repo", "branch").agg(F.count("*").alias("prs"), F.sum(loc).cast("long").alias("loc"), F.grouping_id().cast("long").alias("level"))
    return sets.select(F.coalesce("repo", F.lit("*")).alias("repo"), F.coalesce("branch", F.lit("*")).alias("branch"), "prs", "loc", "level")


def monthly_label(ts: str = "ts") -> Column:
    return month_key(ts)


def weekly_label(ts: str = "ts") -> Column:
    return iso_week(ts)
