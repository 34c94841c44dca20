"""Changelog windows: status durations, rework, cycle times, QA and team flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import ACTIVE_STATUSES, QA_STATUSES, QUEUE_STATUSES, STATUS_RANK
from tidemark.sources.staging import count_staged, staged, unstage

HOUR = 3600.0


def hours(a, b) -> Column:
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return (seconds(b) - seconds(a)) / HOUR


def rank_of(status: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.coalesce(pairs[status], F.lit(0))


def latest_snapshot(issues: DataFrame, key: str = "issue_key", order: str = "updated") -> DataFrame:
    over = W.partitionBy(key).orderBy(F.desc(order), F.desc("issue_ord"))
    return issues.withColumn("_r", F.row_number().over(over)).where("_r = 1").drop("_r")


def status_durations(changelog: DataFrame, issues: DataFrame) -> DataFrame:
    """(issue_key, status, hours): each stay ends at the next move, else when the issue is done (``done_at``, if issues have it),
    else when it is resolved; re-entries add up."""
    over = W.partitionBy("issue_key").orderBy("at", "ord")
    ends = [c for c in ("done_at", "resolved") if c in issues.columns]
    stays = changelog.where("to_status <> ''").withColumn("until", F.lead("at").over(over))
    stays = stays.join(issues.select("issue_key", *ends), "issue_key", "left").withColumn("until", F.coalesce("until", *ends))
    return stays.withColumn("h", hours("at", "until")).where("h > 0").groupBy("issue_key", F.col("to_status").alias("status")).agg(F.sum("h").alias("hours"))


def status_sums(durations: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Hours per issue in each set of statuses."""
    return durations.groupBy("issue_key").agg(*[F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("hours"))), F.lit(0.0)).alias(n) for n, s in sets.items()])


def bounces(changelog: DataFrame) -> DataFrame:
    """Moves from review or later back into work: rank 2 and more to rank 1 or 2, downwards."""
    f, t = rank_of(F.col("from_status")), rank_of(F.col("to_status"))
    return changelog.where((f >= 2) & t.between(1, 2) & (t < f))


def rework_count(changelog: DataFrame) -> DataFrame:
    return bounces(changelog).groupBy("issue_key").agg(F.count("*").alias("rework"))


def ticket_flow(changelog: DataFrame, commits: DataFrame, issues: DataFrame, comments: DataFrame | None = None, dwell_minutes: float = 5.0) -> DataFrame:
    """Per issue with moves: first_in_progress, done_at, cycle_hours, active_hours, queue_hours, status_flips, rework and
    pre_code_comments, all in one pass over its moves, commits and comments in order of time.

    What follows a move (the next one, the next into QA, the next commit) is the last value seen in reverse order, so a long
    history costs no more than its sort.  A bounce counts if a commit answers it before the issue reaches QA again (else
    before it is resolved), or if it came after some dwelling."""
    named = F.col("issue_key").isNotNull() & (F.col("issue_key") != "")
    none = {c: F.lit(None).cast("string") for c in ("from_status", "to_status")}
    moves = changelog.select("issue_key", F.col("at").alias("ts"), F.lit(0).alias("k"), F.col("ord").cast("long").alias("ord"), "from_status", "to_status")
    pushes = commits.select("issue_key", F.col("committed").alias("ts")).where(named).distinct().withColumns({"k": F.lit(1), "ord": F.lit(0).cast("long"), **none})
    rows = moves.unionByName(pushes)
    if comments is not None:
        rows = rows.unionByName(comments.where(named).select("issue_key", F.col("at").alias("ts")).withColumns({"k": F.lit(2), "ord": F.lit(0).cast("long"), **none}))
    order = W.partitionBy("issue_key").orderBy("ts", "k", "ord")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy("issue_key").orderBy(F.desc("ts"), F.desc("k"), F.desc("ord")).rowsBetween(W.unboundedPreceding, -1)
    move, to = F.col("k") == 0, F.col("to_status")
    later = lambda when: F.last(F.when(when, F.col("ts")), ignorenulls=True).over(future)
    rows = rows.withColumns(
        {
            "_next": later(move & (to != "")), "_qa": later(move & (rank_of(to) >= 3)), "_push": later(F.col("k") == 1),
            "_before": F.last(F.when(move, F.col("ts")), ignorenulls=True).over(past), "_first": F.first(F.when(move, F.col("from_status")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)),
            "_n": F.row_number().over(W.partitionBy("issue_key", "k", "to_status").orderBy("ts", "ord")),
        }
    )
    rows = rows.join(issues.select("issue_key", "resolved"), "issue_key", "left").withColumns({"_end": F.coalesce("_next", "resolved"), "_until": F.coalesce("_qa", "resolved", "ts")})
    stay, f, t = hours("ts", "_end"), rank_of(F.col("from_status")), rank_of(to)
    spent = lambda names: F.coalesce(F.sum(F.when(move & to.isin(*names) & (stay > 0), stay)), F.lit(0.0))
    bounced = move & (f >= 2) & t.between(1, 2) & (t < f)
    kept = (hours("_before", "ts") * 60 >= dwell_minutes) | (F.col("_push") <= F.col("_until"))
    count = lambda when: F.sum(F.coalesce(when, F.lit(False)).cast("long"))
    own = rows.groupBy("issue_key").agg(
        F.min(F.when(move, F.col("ts"))).alias("first_in_progress"), F.max(F.when(move, F.col("ts"))).alias("_last"), F.max("resolved").alias("_resolved"),
        spent(ACTIVE_STATUSES).alias("active_hours"), spent(QUEUE_STATUSES).alias("_queue"), count(move & ((F.col("_n") > 1) | (to == F.col("_first")))).alias("status_flips"),
        count(bounced & kept).alias("rework"), count((F.col("k") == 2) & F.col("_before").isNull()).alias("pre_code_comments"),
    ).where("first_in_progress IS NOT NULL")
    out = own.withColumn("done_at", F.coalesce("_resolved", "_last")).withColumn("cycle_hours", F.greatest(hours("first_in_progress", "done_at"), F.lit(0.0)))
    return out.withColumn("queue_hours", F.when(F.col("cycle_hours") > 0, F.col("_queue")).otherwise(0.0)).drop("_last", "_resolved", "_queue")


def rework_denoised(changelog: DataFrame, commits: DataFrame, issues: DataFrame, dwell_minutes: float = 5.0) -> DataFrame:
    """(issue_key, rework): bounces that a commit answers before the issue reaches QA again, or that came after some dwelling."""
    return ticket_flow(changelog, commits, issues, None, dwell_minutes).where("rework > 0").select("issue_key", "rework")


def issue_signals(changelog: DataFrame, issues: DataFrame) -> DataFrame:
    """first_in_progress, done_at, cycle_hours and status_flips (moves into a status seen before) of each issue with moves."""
    order = W.partitionBy("issue_key").orderBy("at", "ord")
    seen = W.partitionBy("issue_key", "to_status").orderBy("at", "ord")
    rows = changelog.withColumns({"_first": F.first("from_status").over(order), "_n": F.row_number().over(seen)})
    flips = F.sum(((F.col("_n") > 1) | (F.col("to_status") == F.col("_first"))).cast("long"))
    own = rows.groupBy("issue_key").agg(F.min("at").alias("first_in_progress"), F.max("at").alias("last_at"), flips.alias("status_flips"))
    out = own.join(issues.select("issue_key", "resolved"), "issue_key").withColumn("done_at", F.coalesce("resolved", "last_at"))
    return out.select("issue_key", "first_in_progress", "done_at", F.greatest(hours("first_in_progress", "done_at"), F.lit(0.0)).alias("cycle_hours"), "status_flips")


def median_positive(value: Column) -> Column:
    return F.coalesce(F.percentile(F.when(value > 0, value), F.lit(0.5)), F.lit(0.0))


def qa_flow(changelog: DataFrame, issues: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket of the resolution: resolved issues and median hours in work, ready for QA and in QA."""
    sums = status_sums(status_durations(changelog, issues), {"active": ACTIVE_STATUSES, "ready_qa": ("Ready QA",), "in_qa": QA_STATUSES})
    done = issues.where("resolved IS NOT NULL").join(sums, "issue_key", "left")
    return done.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("resolved"), *[median_positive(F.col(c)).alias(f"median_{c}") for c in ("active", "ready_qa", "in_qa")])


def qa_bugs(changelog: DataFrame, bucket: Column) -> DataFrame:
    """Moves from QA back into work per bucket."""
    return changelog.where(F.col("from_status").isin("Ready QA", "In QA") & F.col("to_status").isin("In Progress", "Code Review")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("bugs"))


def team_flow(issues: DataFrame, prs: DataFrame, cycle: DataFrame, tagged: Column, spine: DataFrame) -> DataFrame:
    """Zero-filled months of the spine (column bucket): counts and median cycle hours, tagged or not."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("bucket")
    done = issues.where("resolved IS NOT NULL").withColumn("tagged", tagged).join(cycle, "issue_key", "left")
    resolved = done.groupBy(month("resolved")).agg(
        F.count("*").alias("resolved"), F.sum("story_points").alias("story_points"), F.sum(F.col("tagged").cast("long")).alias("tagged"),
        median_positive(F.col("cycle_hours")).alias("median_all"), median_positive(F.when(F.col("tagged"), F.col("cycle_hours"))).alias("median_tagged"), median_positive(F.when(~F.col("tagged"), F.col("cycle_hours"))).alias("median_other"),
    )
    parts = [
        issues.groupBy(month("created")).agg(F.count("*").alias("created")),
        resolved,
        prs.groupBy(month("created")).agg(F.count("*").alias("prs_created")),
        prs.where("merged IS NOT NULL").groupBy(month("merged")).agg(F.count("*").alias("prs_merged")),
    ]
    out = spine
    for p in parts:
        out = out.join(p, "bucket", "left")
    return out.fillna(0)


def deep_threads(comments: DataFrame, least: int = 3) -> DataFrame:
    """(repo, pr_number, inline, deep): threads of review comments by their root.

    ``comments`` has repo, pr_number, id and in_reply_to (0: a root).  Pointers jump to the parent's pointer, which
    doubles their reach each time, until none moves; replies to nothing known are roots.  Only what moved last jumps
    again, and each jump starts from a written table, so neither the plan nor the number of its joins grows with the
    longest thread.  Members of a cycle never come to rest: they jump as often as a chain of all comments of a request
    would need and then keep some member."""
    spark, before = comments.sparkSession, count_staged()
    start = F.when(F.col("in_reply_to") == 0, F.col("id")).otherwise(F.col("in_reply_to"))
    rows = staged(comments.select("repo", "pr_number", "id", start.alias("root"), (start != F.col("id")).alias("moved")), "threads")
    longest = rows.groupBy("repo", "pr_number").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # one number
    for _ in range(max(1, (longest - 1).bit_length())):
        up = rows.select("repo", "pr_number", F.col("id").alias("root"), F.col("root").alias("_up"))
        jumped = rows.where("moved").join(up, ["repo", "pr_number", "root"], "left")
        jumped = jumped.select("repo", "pr_number", "id", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("moved"))
        rows = staged(rows.where("NOT moved").unionByName(jumped), "threads")
        unstage(spark, keep=1, since=before)
        if rows.where("moved").isEmpty():
            break
    threads = rows.groupBy("repo", "pr_number", "root").agg(F.count("*").alias("n"))
    return threads.groupBy("repo", "pr_number").agg(F.sum("n").alias("inline"), F.sum((F.col("n") >= least).cast("long")).alias("deep"))


def projection(series: DataFrame, fraction: Column, cumulative: bool = True) -> DataFrame:
    """The last bucket of (bucket, value) projected by the elapsed fraction, with its pace against the bucket before; dropped if too early."""
    order = W.orderBy("bucket")
    rows = series.withColumns({"before": F.lag("value").over(order), "_last": F.lead("bucket").over(order).isNull()}).withColumn("fraction", fraction)
    value = F.when(F.col("_last") & F.lit(cumulative) & (F.col("fraction") >= 0.15), F.col("value") / F.col("fraction")).otherwise(F.col("value"))
    pace = F.when(~F.col("_last") | F.col("before").isNull(), F.lit("")).when(value > 1.05 * F.col("before"), "above").when(value < 0.95 * F.col("before"), "below").otherwise("on")
    return rows.where(~F.col("_last") | (F.col("fraction") >= 0.15)).select("bucket", value.alias("value"), pace.alias("pace"))


def label_cut(issues: DataFrame, cycle: DataFrame, tagged: Column) -> DataFrame:
    """One row: resolved, tagged ones, their share, and median cycle hours of either side."""
    done = issues.where("resolved IS NOT NULL").withColumn("tagged", tagged).join(cycle, "issue_key", "left")
    n, t = F.count("*"), F.sum(F.col("tagged").cast("long"))
    return done.agg(n.alias("resolved"), t.alias("tagged"), (100 * t / n).alias("share"), median_positive(F.when(F.col("tagged"), F.col("cycle_hours"))).alias("median_tagged"), median_positive(F.when(~F.col("tagged"), F.col("cycle_hours"))).alias("median_other"))


def window_median(monthly: DataFrame, value: str) -> DataFrame:
    """The upper median of positive monthly values: the element at floor(n / 2)."""
    kept = F.array_sort(F.collect_list(F.when(F.col(value) > 0, F.col(value))))
    return monthly.agg(F.when(F.size(kept) > 0, F.element_at(kept, F.floor(F.size(kept) / 2).cast("int") + 1)).otherwise(0.0).alias(value))
