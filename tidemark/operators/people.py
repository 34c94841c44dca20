"""Who did what: attribution of facts to people, the unknown bucket, scopes and identity work."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import EXCLUDED_ROLES
from tidemark.functions.text import is_bot


def drop_bots(df: DataFrame, login: str) -> DataFrame:
    return df.where(~is_bot(F.col(login)))


def attribute_github(df: DataFrame, logins: DataFrame, login: str) -> DataFrame:
    """Each row to every person who claims its login (case matters). The roster side is small; Spark broadcasts it by its size."""
    return df.join(logins.select("dev", F.col("login").alias("_login")), F.col(login) == F.col("_login")).drop("_login")


def attribute_issues(issues: DataFrame, roster: DataFrame) -> DataFrame:
    """Each issue to its assignee and its reporter, once if they are one; ``resolved`` counts for the assignee alone."""
    people = issues.withColumn("_account", F.explode(F.array_distinct(F.array("assignee", "reporter"))))
    own = people.join(roster.select("dev", F.col("account").alias("_a")), F.col("_account") == F.col("_a"))
    return own.withColumn("resolved", F.when(F.col("assignee") == F.col("_account"), F.col("resolved"))).drop("_account", "_a")


def unknown_github(df: DataFrame, logins: DataFrame, login: str) -> DataFrame:
    """Rows that nobody on the roster claims, bots aside."""
    return drop_bots(df, login).join(logins.select(F.col("login").alias(login)).distinct(), login, "left_anti")


def unknown_issues(issues: DataFrame, roster: DataFrame) -> DataFrame:
    """Issues with an assignee or a reporter who is named but not on the roster."""
    known = lambda side: roster.select(F.col("account").alias(f"_{side}"), F.lit(True).alias(f"_{side}_known"))
    both = issues.join(known("a"), F.col("assignee") == F.col("_a"), "left").join(known("r"), F.col("reporter") == F.col("_r"), "left")
    lost = ((F.col("assignee") != "") & F.col("_a_known").isNull()) | ((F.col("reporter") != "") & F.col("_r_known").isNull())
    return both.where(lost).select(*issues.columns)


def scoreable(roster: DataFrame, logins: DataFrame, roles: tuple[str, ...] = EXCLUDED_ROLES) -> DataFrame:
    """People who aren't all bots and whose role is not excluded."""
    bots = logins.groupBy("dev").agg(F.min(is_bot(F.col("login")).cast("int")).alias("_bot"))
    keep = roster.where(~F.lower(F.coalesce("role", F.lit("dev"))).isin(*roles)).join(bots, "dev", "left")
    return keep.where(F.coalesce("_bot", F.lit(0)) == 0).drop("_bot")


def only_person(df: DataFrame, logins: DataFrame, login: str, dev: str | None) -> DataFrame:
    """One person's rows; without a person, all."""
    if dev is None:
        return df
    return df.join(logins.where(F.col("dev") == dev).select(F.col("login").alias(login)).distinct(), login, "left_semi")


def only_account(issues: DataFrame, roster: DataFrame, dev: str | None) -> DataFrame:
    """Issues that one person is assigned to or reported; without a person, all."""
    if dev is None:
        return issues
    own = roster.where(F.col("dev") == dev).agg(F.collect_set("account").alias("_own"))  # one row
    return issues.crossJoin(F.broadcast(own)).where(F.array_contains("_own", F.col("assignee")) | F.array_contains("_own", F.col("reporter"))).drop("_own")


def activity_by_login(prs: DataFrame, commits: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = prs.select(F.col("author").alias("login")).unionAll(commits.select("author")).unionAll(reviews.select("reviewer"))
    return rows.groupBy("login").agg(F.count("*").alias("n"))


def primary_login(activity: DataFrame, logins: DataFrame) -> DataFrame:
    """(dev, login): the busiest login, the alphabetically first of equals."""
    rows = logins.join(activity, "login", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("dev").orderBy(F.desc("n"), "login")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("dev", "login", "n")


def scan_identities(prs: DataFrame, commits: DataFrame, reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """(kind, identity) that occur, bots aside."""
    logins = prs.select(F.col("author").alias("identity")).unionAll(commits.select("author")).unionAll(reviews.select("reviewer"))
    accounts = issues.select(F.col("assignee").alias("identity")).unionAll(issues.select("reporter"))
    found = drop_bots(logins, "identity").select(F.lit("login").alias("kind"), "identity").unionAll(accounts.select(F.lit("account").alias("kind"), "identity"))
    return found.where("identity <> ''").distinct()


def unmapped(found: DataFrame, roster: DataFrame, logins: DataFrame) -> DataFrame:
    known = logins.select(F.lit("login").alias("kind"), F.col("login").alias("identity")).unionAll(roster.select(F.lit("account"), "account"))
    return found.join(known, ["kind", "identity"], "left_anti")


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def match_score(login: Column, name: Column) -> Column:
    """How well a login fits a display name, 0 to 100."""
    a, b = _normal(login), _normal(name)
    glued_a, glued_b = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    ta, tb = F.filter(F.split(a, " "), lambda x: x != ""), F.filter(F.split(b, " "), lambda x: x != "")
    initial = F.concat(F.substring(F.element_at(tb, 1), 1, 1), F.element_at(tb, -1))
    reverse = F.concat(F.element_at(tb, -1), F.substring(F.element_at(tb, 1), 1, 1))
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    part = F.size(F.filter(tb, lambda t: (F.length(t) >= 3) & F.contains(glued_a, t))) / F.size(tb)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(glued_a == glued_b, 100.0)
        .when((F.size(tb) >= 2) & ((glued_a == initial) | (glued_a == reverse)), 95.0)
        .when(jaccard >= 0.5, F.least(F.lit(90.0), 60 + 30 * jaccard))
        .when(part > 0, F.least(F.lit(70.0), 40 + 30 * part))
        .otherwise(0.0)
    )


def _tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, " "), lambda x: x != ""))


def _short_prefix(s: Column) -> Column:
    """Of the tokens, the longest first, as many as two sets need to share one at a Jaccard of 0.5; those of three and more
    are left out, as ``part`` covers them."""
    order = F.array_sort(F.transform(_tokens(s), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    return F.transform(F.filter(F.slice(order, 1, F.floor(F.size(order) / 2).cast("int") + 1), lambda x: x["l"] > -3), lambda x: F.concat(F.lit("t:"), x["t"]))


def candidates(logins: DataFrame, names: DataFrame, least: float = 40.0, top: int = 3) -> DataFrame:
    """(login, account, score, rank): the best names for each login, of all pairs that score ``least`` (above zero) or more.

    Each case of ``match_score`` has a key by equality: the glued forms and initials, a short token, or a token of the name
    among the login's substrings (of the lengths that such tokens have).  Equal normalised forms go as one, with the first
    ``top`` accounts of each name."""
    glue = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    key = lambda k, c: F.concat(F.lit(f"{k}:"), c)
    a = logins.select("login", _normal(F.col("login")).alias("a")).where("a <> ''").distinct()
    b = names.select("account", "name", _normal(F.col("name")).alias("b")).where("b <> ''").distinct()
    b = b.withColumn("_r", F.row_number().over(W.partitionBy("b").orderBy("account", "name"))).where(F.col("_r") <= top)
    b = b.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("account", "name"))).alias("who"))
    words = F.split("b", " ")
    initial, last = F.substring(F.element_at(words, 1), 1, 1), F.element_at(words, -1)
    glued = F.array(key("g", glue("b")), key("g", F.concat(initial, last)), key("g", F.concat(last, initial)))
    long = F.filter(_tokens(F.col("b")), lambda t: F.length(t) >= 3)
    own = F.array_distinct(F.concat(glued, _short_prefix(F.col("b")), F.transform(long, lambda t: key("s", t))))
    right = b.select("b", F.col("who")[0].alias("first"), F.explode(own).alias("key"))
    lengths = b.select(F.explode(F.transform(long, lambda t: F.length(t))).alias("n")).distinct().agg(F.collect_list("n").alias("lengths"))
    left = a.select("a", glue("a").alias("glued")).distinct().crossJoin(F.broadcast(lengths))
    subs = F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length("glued")), lambda n: F.transform(F.sequence(F.lit(1), F.length("glued") - n + 1), lambda i: key("s", F.substr("glued", i, n)))))
    left = left.select("a", F.explode(F.array_distinct(F.concat(F.array(key("g", F.col("glued"))), _short_prefix(F.col("a")), subs))).alias("key"))
    pairs = left.join(right, "key").select("a", "b", "first").distinct()
    scored = pairs.withColumn("score", match_score(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    best = scored.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "first"))).where(F.col("_r") <= top)
    found = a.join(best.select("a", "b", "score"), "a").join(b, "b").select("login", "score", F.explode("who").alias("w")).select("login", "score", "w.*")
    order = W.partitionBy("login").orderBy(F.desc("score"), "account", "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("login", "account", "score", "rank")


def merge_roster(existing: DataFrame, pending: DataFrame) -> DataFrame:
    """(account, logins, outcome) of (account, login, ord) tables: logins joined in order, new accounts appended."""
    rows = existing.select("account", "login", "ord", F.lit(0).alias("new")).unionAll(pending.select("account", "login", "ord", F.lit(1).alias("new")))
    merged = rows.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("new", "ord", "login"))).alias("l"), F.min("new").alias("first"), F.max("new").alias("last"))
    state = F.when(F.col("first") == 1, "appended").when(F.col("last") == 1, "extended").otherwise("kept")
    return merged.select("account", F.array_distinct(F.transform("l", lambda x: x["login"])).alias("logins"), state.alias("outcome"))


def mint_aliases(names: DataFrame, existing: DataFrame, prefix: str = "Person", pools: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """(name, alias): old ones stay, new names are numbered after the highest number in use; '' and 'unknown' stay themselves.

    Numbers go by the first byte of the name's MD5 sum, then by name: each of the 256 groups is numbered by itself and
    begins after those before it, so no task holds all names.  ``pools`` of first and last names give the numbers words:
    the pair at that place, with the round after it once all pairs are used up."""
    new = names.where(~F.col("name").isin("", "unknown")).select("name").distinct().join(existing, "name", "left_anti").withColumn("_g", F.substring(F.md5("name"), 1, 2))
    pattern = rf"^{re.escape(prefix)} (\d+)$"
    base = existing.agg(F.coalesce(F.max(F.nullif(F.regexp_extract("alias", pattern, 1), F.lit("")).cast("long")), F.lit(0).cast("long")).alias("_base"))
    sizes = new.groupBy("_g").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 256 rows at most
    numbered = new.withColumn("_k", F.row_number().over(W.partitionBy("_g").orderBy("name"))).join(F.broadcast(starts), "_g").crossJoin(F.broadcast(base))
    number = F.col("_k") + F.col("_start") + F.col("_base")
    alias = F.format_string(f"{prefix} %d", number)
    if pools:
        first, last = (F.array(*[F.lit(x) for x in p]) for p in pools)
        at, size = number - 1, len(pools[0]) * len(pools[1])
        pair = F.concat_ws(" ", F.get(first, F.pmod(at, F.lit(len(pools[0]))).cast("int")), F.get(last, F.pmod(F.floor(at / len(pools[0])), F.lit(len(pools[1]))).cast("int")))
        alias = F.when(at < size, pair).otherwise(F.concat_ws(" ", pair, (F.floor(at / size) + 1).cast("string")))
    return existing.select("name", "alias").unionByName(numbered.select("name", alias.alias("alias")))


def scrub(df: DataFrame, aliases: DataFrame, columns: list[str], blank: list[str]) -> DataFrame:
    """``df`` with aliases in place of names, and blanks."""
    out = df
    for c in columns:
        out = out.join(aliases.select(F.col("name").alias(c), F.col("alias").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.withColumns({c: F.lit("") for c in blank}).select(*df.columns)
