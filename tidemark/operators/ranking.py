"""Cohort scores: effort multipliers, z-scores, composites, ranks and rank correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import WEIGHTS, Effort
from tidemark.operators import order

METRICS = tuple(WEIGHTS)


def effort_multiplier(df: DataFrame, commits: str = "commits", files: str = "unique_files", loc: str = "loc", cohort: str | None = None, knobs: Effort = Effort()) -> DataFrame:
    """Adds ``multiplier``: many commits per file and outsized lines per file count less, never under the floor.

    Without a ``cohort`` column ``df`` is read twice, once for the limit: give a written table."""
    per_file = F.when(F.col(files) > 0, F.col(loc) / F.col(files))
    limit = F.percentile(per_file, F.lit(knobs.stuff_percentile))
    spam = F.when(F.col(files) > 0, F.col(commits) / F.col(files))
    spammed = F.greatest(F.lit(knobs.floor), 1 - knobs.spam_slope * F.greatest(F.lit(0.0), spam - knobs.spam_ratio))
    stuffed = F.greatest(F.lit(knobs.floor), 1 - knobs.stuff_slope * F.greatest(F.lit(0.0), per_file / F.col("_limit") - 1))
    out = df.withColumn("_limit", limit.over(W.partitionBy(cohort))) if cohort else df.crossJoin(F.broadcast(df.agg(limit.alias("_limit"))))  # one row
    both = F.coalesce(spammed, F.lit(1.0)) * F.when(F.col("_limit") > 0, F.coalesce(stuffed, F.lit(1.0))).otherwise(1.0)
    return out.withColumn("multiplier", F.greatest(F.lit(knobs.floor), both)).drop("_limit")


def _beside(df: DataFrame, cohort: list[str], stats: DataFrame) -> DataFrame:
    """``df`` with what ``stats`` has of its cohort; without cohorts that is one row."""
    if not cohort:
        return df.crossJoin(F.broadcast(stats))
    return df.join(stats.toDF(*[f"_c{i}" for i in range(len(cohort))], *stats.columns[len(cohort) :]), reduce(Column.__and__, [df[c].eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cohort)]))


def metrics(df: DataFrame, cohort: list[str]) -> DataFrame:
    """(cohort..., dev, a column for each metric) of totals with a multiplier; lines are capped at the cohort's 95th percentile
    after it.  ``df`` is read twice: give a written table."""
    m = F.col("multiplier")
    loc = F.col("loc") * m
    cap = df.groupBy(*cohort).agg(F.percentile(loc, F.lit(0.95)).alias("_cap"))
    return _beside(df, cohort, cap).select(
        *cohort,
        "dev",
        F.col("prs_merged").cast("double").alias("prs_merged"),
        F.col("resolved").cast("double").alias("resolved"),
        (F.col("code_impact") * m).alias("code_impact"),
        F.col("reviewed").cast("double").alias("prs_reviewed"),
        F.col("prs_created").cast("double").alias("prs_created"),
        F.col("progressed").cast("double").alias("progressed"),
        F.col("active_weeks").cast("double").alias("active_weeks"),
        F.when(F.col("scored") > 0, F.col("story_points") / F.col("scored")).otherwise(0.0).alias("story_points"),
        F.sqrt(F.greatest("created", F.lit(0))).alias("created"),
        F.sqrt(F.greatest(F.least(loc, F.col("_cap")), F.lit(0.0))).alias("loc"),
        (F.col("commits") * m).alias("commits"),
    )


def standard(wide: DataFrame, cohort: list[str]) -> DataFrame:
    """``metrics`` with each metric's z instead of its value, as ``z_scores`` has it of long rows: the statistics of a cohort are one
    row, so people stay one row each and no metric is drawn into one task.  ``wide`` is read twice: let it come from a written table."""
    counts = {c: F.col(c) > 0 if c == "story_points" else F.lit(True) for c in METRICS}
    v = {c: F.when(counts[c], F.col(c)) for c in METRICS}
    stats = wide.groupBy(*cohort).agg(*[f(v[c]).alias(f"{name}_{c}") for c in METRICS for f, name in ((F.avg, "_mean"), (F.stddev_pop, "_sd"))])

    def z(c: str) -> Column:
        mean, sd = F.col(f"_mean_{c}"), F.col(f"_sd_{c}")
        flat = sd < 1e-12 * F.greatest(F.lit(1.0), F.abs(mean))
        return F.when(flat | ~counts[c] | sd.isNull(), 0.0).otherwise((F.col(c) - mean) / sd).alias(c)

    return _beside(wide, cohort, stats).select(*cohort, "dev", *[z(c) for c in METRICS])


def by_metric(z: DataFrame, cohort: list[str]) -> DataFrame:
    """(cohort..., dev, metric, z) of ``standard``."""
    return z.unpivot([*cohort, "dev"], list(METRICS), "metric", "z")


def scores(wide: DataFrame, cohort: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(cohort..., dev, score) of ``metrics``: the weighted sum of everyone's z."""
    return standard(wide, cohort).select(*cohort, "dev", reduce(Column.__add__, [F.lit(weights.get(c, 0.0)) * F.col(c) for c in METRICS]).alias("score"))


def z_scores(long: DataFrame, cohort: list[str]) -> DataFrame:
    """Adds ``z``: population statistics per metric; story points by those who have any, zero for the rest; flat metrics give zero."""
    over = W.partitionBy(*cohort, "metric")
    counts = (F.col("metric") != "story_points") | (F.col("value") > 0)
    v = F.when(counts, F.col("value"))
    out = long.withColumns({"_mean": F.avg(v).over(over), "_sd": F.stddev_pop(v).over(over)})
    flat = F.col("_sd") < 1e-12 * F.greatest(F.lit(1.0), F.abs("_mean"))
    return out.withColumn("z", F.when(flat | ~counts | F.col("_sd").isNull(), 0.0).otherwise((F.col("value") - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def weighted(z: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds each metric's contribution."""
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return z.withColumn("contribution", F.coalesce(pairs[F.col("metric")], F.lit(0.0)) * F.col("z"))


def breakdown(z: DataFrame, cohort: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Contributions that aren't zero, the largest first."""
    rows = weighted(z, weights).where("contribution <> 0")
    order = W.partitionBy(*cohort, "dev").orderBy(F.desc(F.abs("contribution")), "metric")
    return rows.withColumn("place", F.row_number().over(order)).select(*cohort, "dev", "metric", "z", "contribution", "place")


def rank_cohort(scores: DataFrame, cohort: list[str], tie: str = "dev") -> DataFrame:
    """Adds the rank by score, ties by ``tie``; without a cohort over the whole table, in ranges of the order."""
    by = [F.desc("score"), F.asc(tie)]
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*cohort).orderBy(*by))) if cohort else order.row_numbers(scores, by, "rank")


def mid_ranks(df: DataFrame, value: str, name: str, part: list[str]) -> DataFrame:
    """Descending ranks, ties at their middle.  Over a whole table (no ``part``) the ranks are those of its distinct values,
    counted and summed in ranges; missing values come last."""
    if part:
        over, same = W.partitionBy(*part), W.partitionBy(*part, value)
        return df.withColumn(name, F.rank().over(over.orderBy(F.desc(value))) + (F.count("*").over(same) - 1) / 2)
    sizes = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    places = order.running_sum(sizes, [F.desc_nulls_last("_v")], F.col("_n"), "_upto").select("_v", (F.col("_upto") - F.col("_n") + 1 + (F.col("_n") - 1) / 2).alias(name))
    return df.join(places, df[value].eqNullSafe(places["_v"]), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str, part: list[str]) -> DataFrame:
    ranked = mid_ranks(mid_ranks(df, a, "_a", part), b, "_b", part)
    d = F.col("_a") - F.col("_b")
    n = F.col("n")
    sums = ranked.groupBy(*part).agg(F.count("*").alias("n"), F.sum(d * d).alias("_d2"))
    return sums.select(*part, "n", F.when(n < 2, 0.0).otherwise(1 - 6 * F.col("_d2") / (n * (n * n - 1))).alias("rho"))


def logistic_z(value: Column, over) -> Column:
    mean, sd = F.avg(value).over(over), F.stddev_pop(value).over(over)
    return F.when((F.count(value).over(over) < 2) | (sd < 1e-12), 0.5).otherwise(1 / (1 + F.exp(-(value - mean) / sd)))


def min_max(value: Column, over) -> Column:
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when((F.count(value).over(over) < 2) | (high - low < 1e-12), 0.5).otherwise((value - low) / (high - low))


def sort_people(df: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Adds the place by a measure, nulls last, ties by name; with ``top`` only so many."""
    line = [F.col(by).desc_nulls_last(), F.asc("dev")]
    return order.first_places(df, line, top, "place") if top else order.row_numbers(df, line, "place")


def find_person(df: DataFrame, logins: DataFrame, login: str) -> DataFrame:
    """The rows of whoever has a login, whatever its case."""
    return df.join(logins.where(F.lower("login") == login.lower()).select("dev").distinct(), "dev", "left_semi")
