"""Pull requests that only merge other work up: commit re-ship overlap and corroborating signals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import LONG_LIVED, Integration

PR = ["repo", "pr_number"]


def reship(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, pr_number, reship): the share of a merged request's commits that an earlier one of the repository has shipped."""
    merged = prs.where("merged IS NOT NULL").select(*PR, "merged")
    rows = commits.where("sha <> ''").select(*PR, "sha").join(merged, PR).distinct()  # rows of one number merged at one time are one
    order = W.partitionBy("repo", "sha").orderBy("merged", "pr_number")
    again = rows.withColumn("again", (F.row_number().over(order) > 1).cast("double"))
    return again.groupBy(*PR).agg(F.avg("again").alias("reship"))


def long_lived(branch: Column, branches: tuple[str, ...] = LONG_LIVED) -> Column:
    b = F.lower(branch)
    exact = [x for x in branches if not x.endswith("/")]
    out = b.isin(*exact)
    for p in branches:
        if p.endswith("/"):
            out = out | b.startswith(p)
    return out


def signals(prs: DataFrame, commits: DataFrame, knobs: Integration = Integration(), keys: str = "n_keys") -> DataFrame:
    """The nine signals of each request; ``prs`` has n_keys, the number of its issue keys, and title, looked through for
    the patterns of ``knobs.titles``."""
    author = prs.select(*PR, F.col("author").alias("_author"))
    known = F.col("author") != ""
    own = commits.join(author, PR).groupBy(*PR).agg(
        F.avg(F.when(known, (F.col("author") != F.col("_author")).cast("double"))).alias("diversity"),
        F.avg((F.col("parent_count") >= 2).cast("double")).alias("merges"),
    )
    rows = prs.fillna("", ["title"]).join(reship(prs, commits), PR, "left").join(own, PR, "left").fillna(0.0, ["reship", "diversity", "merges"])
    quiet = (F.col("inline_comments") == 0) & (F.col("deep_threads") == 0)
    base, head = long_lived(F.col("base_branch")), long_lived(F.col("branch"))
    n = F.col(keys)
    flag = lambda c: c.cast("double")
    return rows.withColumns(
        {
            "no_review": flag(quiet),
            "key_shape": F.when((n == 0) | (n >= knobs.many_keys), 1.0).when(n == 1, -1.0).otherwise(0.0),
            "big_diff": flag(quiet & (F.col("additions") + F.col("deletions") >= knobs.big_loc)),
            "long_ends": flag(base & head),
            "keyless": flag(base & (n == 0) & ((F.col("reship") > 0) | (base & head))),
            "title": flag(F.lower("title").rlike("|".join(re.escape(x.strip().lower()) for x in knobs.titles)) if knobs.titles else F.lit(False)),
        }
    )


def classify(prs: DataFrame, commits: DataFrame, knobs: Integration = Integration()) -> DataFrame:
    """(repo, pr_number, score, flagged, weight) and the signals; requests that aren't merged score 0."""
    found = signals(prs, commits, knobs)
    names = ("reship", "diversity", "merges", "no_review", "key_shape", "big_diff", "long_ends", "keyless", "title")
    total = sum((getattr(knobs, n) * F.col(n) for n in names), F.lit(0.0)) / knobs.total
    score = F.when(F.col("merged").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
    out = found.withColumn("score", score).withColumn("flagged", F.col("score") >= knobs.threshold)
    return out.withColumn("weight", F.when(F.col("flagged"), knobs.factor).otherwise(1.0))


def overrides(classified: DataFrame) -> DataFrame:
    """Per author: weighted requests created and merged, weighted lines, and how many were flagged."""
    merged = F.col("merged").isNotNull()
    loc = F.col("additions") + F.col("deletions")
    return classified.groupBy("author").agg(
        F.sum("weight").alias("prs_created"), F.sum(F.when(merged, F.col("weight")).otherwise(0.0)).alias("prs_merged"),
        F.sum(F.when(merged, loc * F.col("weight")).otherwise(0.0)).alias("loc"), F.sum((merged & F.col("flagged")).cast("long")).alias("flagged"),
    )


def report(classified: DataFrame) -> DataFrame:
    """Histogram of scores of merged requests by tenths, with lines and flagged ones."""
    merged = classified.where("merged IS NOT NULL")
    bin_ = F.least(F.floor(F.round(F.col("score") * 10, 9)), F.lit(9)).cast("long")
    return merged.groupBy(bin_.alias("bin")).agg(F.count("*").alias("prs"), F.sum(F.col("additions") + F.col("deletions")).cast("long").alias("loc"), F.sum(F.col("flagged").cast("long")).alias("flagged"))


def signal_means(classified: DataFrame) -> DataFrame:
    """(flagged, prs, share, loc_share, mean of each signal) of merged requests."""
    loc = F.col("additions") + F.col("deletions")
    names = ("reship", "diversity", "merges", "no_review", "key_shape", "big_diff", "long_ends", "keyless", "title")
    rows = classified.where("merged IS NOT NULL")
    total = rows.agg(F.count("*").alias("_n"), F.sum(loc).alias("_l"))
    own = rows.groupBy("flagged").agg(F.count("*").alias("prs"), F.sum(loc).alias("loc"), *[F.avg(n).alias(n) for n in names])
    return own.crossJoin(F.broadcast(total)).select("flagged", "prs", (F.col("prs") / F.col("_n")).alias("share"), (F.col("loc") / F.col("_l")).alias("loc_share"), *names)


def top_groups(classified: DataFrame, by: str, top: int = 10) -> DataFrame:
    """(by, prs, flagged, place): where most merged requests are flagged."""
    rows = classified.where("merged IS NOT NULL").groupBy(by).agg(F.count("*").alias("prs"), F.sum(F.col("flagged").cast("long")).alias("flagged"))
    best = rows.orderBy(F.desc("flagged"), F.desc("prs"), by).limit(top)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("flagged"), F.desc("prs"), by)))  # top rows


def person_loss(classified: DataFrame, factors: list[float]) -> DataFrame:
    """(author, factor, flagged_share, lost): what part of a person's merged requests and lines counts less at each factor."""
    loc = F.col("additions") + F.col("deletions")
    own = classified.where("merged IS NOT NULL").groupBy("author").agg(
        F.avg(F.col("flagged").cast("double")).alias("flagged_share"), F.sum(loc).alias("_l"), F.sum(F.when(F.col("flagged"), loc).otherwise(0)).alias("_f"),
    )
    asked = classified.sparkSession.createDataFrame([(float(x),) for x in factors], "factor double")
    lost = F.when(F.col("_l") > 0, (1 - F.col("factor")) * F.col("_f") / F.col("_l")).otherwise(0.0)
    return own.crossJoin(F.broadcast(asked)).select("author", "factor", "flagged_share", lost.alias("lost"))


def score_sample(classified: DataFrame, per_bin: int = 3) -> DataFrame:
    """(bin, repo, pr_number, score): the first few merged requests of each tenth of the score, to look at."""
    bin_ = F.least(F.floor(F.round(F.col("score") * 10, 9)), F.lit(9)).cast("long")
    rows = classified.where("merged IS NOT NULL").select(bin_.alias("bin"), *PR, "score")
    order = W.partitionBy("bin").orderBy("pr_number", "repo")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_bin).drop("_r")
