"""Queries behind lists, filters and audits, with their SQL."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.config import Effort, Impact, Spike
from tidemark.functions import calendar as cal
from tidemark.functions.text import disciplines
from tidemark.operators import audit, elo, epics, flow, ranking, tickets
from tidemark.plans import activity, delivery
from tidemark.plans.activity import EFFECTIVE, LEADER_SQL, effective_sql, n, r
from tidemark.plans.delivery import BANDED, DURATIONS, EPIC, SPIKES
from tidemark.sources import corpus_files
from tidemark.sources.staging import staged

#: The leaderboard with a multiplier of 1.
FLAT_SQL = re.sub(r"w3 AS \(SELECT \*, .*? AS m FROM w2\)", "w3 AS (SELECT *, 1.0 AS m FROM w2)", LEADER_SQL, flags=re.DOTALL)


def corpus_meta(t):
    parts = [t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name in ("issues", "prs", "commits", "reviews", "roster_dev")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _cycle(t):
    return flow.status_sums(flow.status_durations(t("changelog"), t("issues")), {"cycle_hours": ("In Progress", "Code Review")})


def sorted_people(t):
    return ranking.sort_people(ranking.scores(ranking.metrics(activity._leaderboard(t), []), []), "score", 10).select("dev", r("score"), n("place"))


def found_person(t):
    return ranking.find_person(activity._leaderboard(t), t("roster_login"), "ALT3").select("dev", r("code_impact"))


def cohort_audit(t):
    """Ranks by composite with and without the effort multiplier."""
    wide = activity._leaderboard(t)
    flat = ranking.effort_multiplier(wide.drop("multiplier"), knobs=replace(Effort(), spam_slope=0.0, stuff_slope=0.0))
    return audit.rank_shift(activity._ranked(flat), activity._ranked(wide), "dev").select("dev", n("before"), n("after"), n("shift"))


def spike_audit(t):
    """Points of investigations with and without nudges."""
    points = lambda k: tickets.spike_band(delivery.spike_rows(t), k).select("conv_id", F.col("points").alias("v"))
    return audit.movement(audit.diff_snapshots(points(replace(Spike(), spawned=0.0, breadth=0.0)), points(Spike()), "conv_id", "v")).select(n("before"), n("after"), n("n"))


def spike_population(t):
    """Per band of investigations: how many, with follow-ups, with artifacts, flagged, and the most effort."""
    rows = tickets.spike_band(delivery.spike_rows(t))
    count = lambda when: F.sum(when.cast("long"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), count(F.col("spawned") > 0).alias("spawned"), count(F.col("artifacts") > 0).alias("artifacts"), count(F.col("needs_insight")).alias("flagged"), F.round(F.max("raw").cast("double"), 4).alias("most"))


def _described(t):
    """Investigations and whether their first turn describes them."""
    first = t("conversations").groupBy("conv_id").agg(F.max(((F.col("turn") == 0) & (F.col("conv_id") % 3 != 0) & (F.trim("text") != "")).cast("int")).alias("d"))
    return delivery.spike_rows(t).join(first, "conv_id").withColumn("described", F.col("d") == 1)


DESCRIBED_SQL = "ds AS (SELECT conv_id, max(CASE WHEN turn = 0 AND conv_id % 3 <> 0 AND trim(text) <> '' THEN 1 ELSE 0 END) = 1 AS described, sum(len(regexp_extract_all(text, 'https?://\\S+'))) AS links, sum(CASE WHEN strlen(trim(text)) >= 200 THEN 1 ELSE 0 END) AS long FROM {conversations} GROUP BY 1)"


def spike_summary(t):
    found = audit.spike_summary(_described(t))
    return found.select(*[n(c) for c in found.columns])


def spike_top(t):
    return audit.spike_top(delivery.spike_rows(t), "conv_id", 25).select("conv_id", n("points"), r("raw"), n("artifact_links"), n("substantive"), n("spawned"), n("breadth"), "needs_insight", n("place"))


#: Knobs under which many files are members of families.
LOOSE = Impact(family_members=2, family_cv=1.0, family_token=8)
LOOSE_SQL = LEADER_SQL.replace(EFFECTIVE, effective_sql(LOOSE))


def impact_audit(t):
    """Lines, impact and rank of everyone under the defaults and under loose families."""
    def side(wide, mark):
        rank = activity._ranked(wide)
        return wide.select("dev", "loc", "effective_loc", "code_impact").join(rank.select("dev", "rank"), "dev").select("dev", "loc", *[F.col(c).alias(f"{c}_{mark}") for c in ("effective_loc", "code_impact", "rank")])

    plain, loose = activity._cohorts(t, Impact(), LOOSE)
    both = side(plain, "a").join(side(loose, "b").drop("loc"), "dev")
    return both.select("dev", r("loc"), *[r(f"{c}_{m}") for c in ("effective_loc", "code_impact") for m in "ab"], n("rank_a"), n("rank_b"), (F.col("rank_a") - F.col("rank_b")).cast("long").alias("shift"))


def rating_snapshot(t):
    """Ratings of every league after two periods against those after all."""
    outcomes = elo.round_robin(activity._event_scores(t))
    last = lambda df: elo.state_of(elo.rating_fold(df)).select(F.concat_ws(":", "league", "dev").alias("dev"), F.round("rating", 6).alias("v"))
    return audit.diff_snapshots(last(outcomes.where("period < '2024-P05'")), last(outcomes), "dev", "v")


def epic_facets(t):
    found = epics.momentum(delivery.epic_weeks(t), anchor=1600)
    return epics.facets(found, rising_only=True, least_work=10).select("epic_key", "state", r("momentum"))


def facets_weeks(t):
    weeks = staged(delivery.epic_weeks(t), "epic-weeks")
    return epics.facets(epics.momentum(weeks, anchor=1600), False, 3, weeks, 1500, 1502).select("epic_key", "state", "trigger")


def score_facets(t):
    scores = delivery._scores(t).join(t("issues").select(F.col("issue_key").alias("ticket"), "resolved"), "ticket")
    return tickets.score_facets(scores, ["low", "medium"], [2, 3, 5], None, "ord-1", "1998-01-01").groupBy("points", "confidence").agg(F.count("*").alias("n")).select(n("points"), "confidence", "n")


def facets_more(t):
    own = t("issues").select(F.col("issue_key").alias("ticket"), "resolved", "created", (F.col("issue_ord") % 7 == 0).alias("posted"), F.when(F.col("issue_ord") % 2 == 0, "auto").otherwise("human").alias("source"), disciplines(F.array("label")).alias("disciplines"))
    scores = delivery._scores(t).join(own, "ticket")
    return tickets.score_facets(scores, flagged=False, since="1998-01-01", posted=False, has_points=True, source="auto", discipline="FE").groupBy("points").agg(F.count("*").alias("n")).select(n("points"), "n")


def quarter_windows(t):
    """The last four quarters of requests."""
    rows = t("prs").where("merged IS NOT NULL").groupBy(cal.quarter_label("merged").alias("quarter")).agg(F.count("*").alias("prs"), F.sum(F.col("additions") + F.col("deletions")).cast("long").alias("loc"))
    return rows.orderBy(F.desc("quarter")).limit(4)


def children(t):
    grouped = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_shipdate"))).alias("lines"))
    return corpus_files.children(grouped, ["l_orderkey"], "lines").groupBy("ord").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s")).select(n("ord"), "n", "s")


QUERIES = {
    "corpus_meta": (corpus_meta, " UNION ALL ".join(f"SELECT '{x}' AS source, count(*) AS n FROM {{{x}}}" for x in ("issues", "prs", "commits", "reviews", "roster_dev"))),
    "people_sorted": (
        sorted_people,
        LEADER_SQL + ", sc AS (SELECT dev, sum(contribution) AS score FROM co GROUP BY dev), pl AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, dev) AS place FROM sc) SELECT dev, round(score, 4) AS score, place FROM pl WHERE place <= 10",
    ),
    "person_found": (found_person, LEADER_SQL + " SELECT dev, round(code_impact, 4) AS code_impact FROM w2 WHERE dev IN (SELECT dev FROM {roster_login} WHERE lower(login) = 'alt3')"),
    "audit_cohort": (
        cohort_audit,
        f"""SELECT dev, a.rank AS before, b.rank AS after, CAST(a.rank - b.rank AS BIGINT) AS shift FROM ({FLAT_SQL} SELECT dev, row_number() OVER (ORDER BY sum(contribution) DESC, dev) AS rank FROM co GROUP BY dev) a
            JOIN ({LEADER_SQL} SELECT dev, row_number() OVER (ORDER BY sum(contribution) DESC, dev) AS rank FROM co GROUP BY dev) b USING (dev)""",
    ),
    "audit_spikes": (
        spike_audit,
        f"""SELECT CAST(a.points AS BIGINT) AS before, CAST(b.points AS BIGINT) AS after, count(*) AS n FROM (WITH {SPIKES.replace("+ spawned * 0.5 + greatest(breadth - 3, 0) * 0.25", "")} SELECT * FROM p) a JOIN (WITH {SPIKES} SELECT * FROM p) b USING (conv_id) GROUP BY 1, 2""",
    ),
    "audit_spike_population": (
        spike_population,
        f"""WITH {SPIKES}, q AS (SELECT *, CASE WHEN raw > 1 AND raw < 13 AND z THEN lo || '–' || hi ELSE CAST(points AS VARCHAR) END AS band FROM p)
            SELECT band, count(*) AS n, CAST(sum(CASE WHEN spawned > 0 THEN 1 ELSE 0 END) AS BIGINT) AS spawned, CAST(sum(CASE WHEN art > 0 THEN 1 ELSE 0 END) AS BIGINT) AS artifacts, CAST(sum(CASE WHEN dormant THEN 1 ELSE 0 END) AS BIGINT) AS flagged, round(max(raw), 4)::DOUBLE AS most FROM q GROUP BY 1""",
    ),
    "audit_spike_summary": (
        spike_summary,
        f"""SELECT count(*) AS spikes, CAST(sum(CASE WHEN a.spawned > 0 THEN 1 ELSE 0 END) AS BIGINT) AS spawned, CAST(sum(CASE WHEN a.breadth > 3 THEN 1 ELSE 0 END) AS BIGINT) AS broad, CAST(sum(CASE WHEN a.points > b.points THEN 1 ELSE 0 END) AS BIGINT) AS moved,
              CAST(sum(CASE WHEN a.points > b.points THEN a.points - b.points ELSE 0 END) AS BIGINT) AS steps, CAST(sum(CASE WHEN a.dormant THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
              CAST(sum(CASE WHEN a.cd >= 2 AND links + long = 0 AND a.flips < 4 AND a.spawned > 0 THEN 1 ELSE 0 END) AS BIGINT) AS suppressed, CAST(sum(CASE WHEN described THEN 1 ELSE 0 END) AS BIGINT) AS described, CAST(sum(CASE WHEN links > 0 THEN 1 ELSE 0 END) AS BIGINT) AS linked
            FROM (WITH {SPIKES} SELECT * FROM p) a JOIN (WITH {SPIKES.replace("+ spawned * 0.5 + greatest(breadth - 3, 0) * 0.25", "")} SELECT * FROM p) b USING (conv_id) JOIN (WITH {DESCRIBED_SQL} SELECT * FROM ds) d USING (conv_id)""",
    ),
    "audit_spike_top": (
        spike_top,
        f"""WITH {SPIKES}, {DESCRIBED_SQL}, tp AS (SELECT *, row_number() OVER (ORDER BY raw DESC, conv_id) AS place FROM p JOIN ds USING (conv_id))
            SELECT conv_id, CAST(points AS BIGINT) AS points, round(raw, 4)::DOUBLE AS raw, CAST(links AS BIGINT) AS artifact_links, CAST(long AS BIGINT) AS substantive, spawned, CAST(breadth AS BIGINT) AS breadth, dormant AS needs_insight, place FROM tp WHERE place <= 25""",
    ),
    "audit_impact": (
        impact_audit,
        f"""SELECT dev, a.loc::DOUBLE AS loc, {", ".join(f"round({m}.{c}, 4)::DOUBLE AS {c}_{m}" for c in ("effective_loc", "code_impact") for m in "ab")}, a.rank AS rank_a, b.rank AS rank_b, CAST(a.rank - b.rank AS BIGINT) AS shift
            FROM ({LEADER_SQL}, rk AS (SELECT dev, row_number() OVER (ORDER BY sum(contribution) DESC, dev) AS rank FROM co GROUP BY dev) SELECT * FROM w2 JOIN rk USING (dev)) a
            JOIN ({LOOSE_SQL}, rk AS (SELECT dev, row_number() OVER (ORDER BY sum(contribution) DESC, dev) AS rank FROM co GROUP BY dev) SELECT * FROM w2 JOIN rk USING (dev)) b USING (dev)""",
    ),
    "audit_ratings": (rating_snapshot, None),
    "epic_facets": (
        epic_facets,
        f"""WITH {EPIC}, k AS (SELECT epic_key, sum(CASE WHEN 1600 - week < 2 THEN prs + commits ELSE 0 END) AS recent, sum(CASE WHEN 1600 - week BETWEEN 2 AND 9 THEN prs + commits ELSE 0 END) AS baseline, sum(prs + commits) AS work FROM ew GROUP BY 1),
            m AS (SELECT *, CASE WHEN baseline = 0 THEN 2.0 ELSE (recent / 2.0) / (baseline / 8.0) END AS momentum FROM k WHERE recent >= 3 AND work >= 10)
            SELECT epic_key, CASE WHEN baseline = 0 THEN 'new' WHEN momentum >= 2 THEN 'hot' ELSE 'rising' END AS state, round(momentum, 4)::DOUBLE AS momentum FROM m WHERE baseline = 0 OR momentum >= 1.2""",
    ),
    "epic_facets_weeks": (
        facets_weeks,
        f"""WITH {EPIC}, k AS (SELECT epic_key, sum(CASE WHEN 1600 - week < 2 THEN prs + commits ELSE 0 END) AS recent, sum(CASE WHEN 1600 - week BETWEEN 2 AND 9 THEN prs + commits ELSE 0 END) AS baseline, sum(prs + commits) AS work, max(CASE WHEN week BETWEEN 1500 AND 1502 THEN 1 ELSE 0 END) AS inside FROM ew GROUP BY 1),
            m AS (SELECT *, CASE WHEN baseline = 0 THEN 2.0 ELSE (recent / 2.0) / (baseline / 8.0) END AS mo FROM k WHERE recent >= 3 AND work >= 3 AND inside = 1),
            s AS (SELECT epic_key, CASE WHEN baseline = 0 THEN 'new' WHEN mo >= 2 THEN 'hot' WHEN mo >= 1.2 THEN 'rising' WHEN mo <= 0.8 THEN 'cooling' ELSE 'steady' END AS state FROM m)
            SELECT epic_key, state, CASE WHEN state IN ('new', 'hot', 'rising') THEN state ELSE '' END AS trigger FROM s""",
    ),
    "ticket_facets_more": (
        facets_more,
        f"WITH {BANDED}, k AS (SELECT b7.*, i.label, i.issue_ord FROM b7 JOIN {{issues}} i USING (issue_key)) SELECT CAST(points AS BIGINT) AS points, count(*) AS n FROM k WHERE NOT needs_insight AND issue_ord % 7 <> 0 AND story_points > 0 AND label = 'FE' AND issue_ord % 2 = 0 AND coalesce(resolved, created) >= TIMESTAMP '1998-01-01' GROUP BY 1",
    ),
    "ticket_facets": (
        score_facets,
        f"WITH {BANDED} SELECT CAST(points AS BIGINT) AS points, confidence, count(*) AS n FROM b7 WHERE confidence IN ('low', 'medium') AND points IN (2, 3, 5) AND issue_key LIKE 'ORD-1%' AND (resolved IS NULL OR resolved >= TIMESTAMP '1998-01-01') GROUP BY 1, 2",
    ),
    "flow_label_cut": (
        lambda t: flow.label_cut(t("issues"), _cycle(t), delivery._tagged()).select(n("resolved"), n("tagged"), r("share"), r("median_tagged"), r("median_other")),
        f"""WITH {DURATIONS}, cy AS (SELECT issue_key, sum(CASE WHEN status IN ('In Progress','Code Review') THEN hours ELSE 0 END) AS h FROM du GROUP BY 1),
            d AS (SELECT label IN ('claude-gen', 'Claude_Gen') AS tag, CASE WHEN h > 0 THEN h END AS h FROM {{issues}} LEFT JOIN cy USING (issue_key) WHERE resolved IS NOT NULL)
            SELECT count(*) AS resolved, CAST(sum(CASE WHEN tag THEN 1 ELSE 0 END) AS BIGINT) AS tagged, round(100.0 * sum(CASE WHEN tag THEN 1 ELSE 0 END) / count(*), 4)::DOUBLE AS share,
              round(coalesce(quantile_cont(CASE WHEN tag THEN h END, 0.5), 0), 4)::DOUBLE AS median_tagged, round(coalesce(quantile_cont(CASE WHEN NOT tag THEN h END, 0.5), 0), 4)::DOUBLE AS median_other FROM d""",
    ),
    "flow_window_median": (
        lambda t: flow.window_median(delivery.team_flow(t), "median_all"),
        f"""WITH {DURATIONS}, cy AS (SELECT issue_key, sum(CASE WHEN status IN ('In Progress','Code Review') THEN hours ELSE 0 END) AS h FROM du GROUP BY 1),
            sp AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(created)), max(created), INTERVAL 1 MONTH)), '%Y-%m') AS bucket FROM {{issues}}),
            m AS (SELECT strftime(resolved, '%Y-%m') AS bucket, round(coalesce(quantile_cont(CASE WHEN h > 0 THEN h END, 0.5), 0), 4)::DOUBLE AS v FROM {{issues}} LEFT JOIN cy USING (issue_key) WHERE resolved IS NOT NULL GROUP BY 1),
            l AS (SELECT list_sort(list(v)) AS vs FROM m JOIN sp USING (bucket) WHERE v > 0) SELECT vs[len(vs) // 2 + 1] AS median_all FROM l""",
    ),
    "window_quarters": (
        quarter_windows,
        "SELECT CAST(year(merged) AS VARCHAR) || '-Q' || CAST(quarter(merged) AS VARCHAR) AS quarter, count(*) AS prs, CAST(sum(additions + deletions) AS BIGINT) AS loc FROM {prs} WHERE merged IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 4",
    ),
    "week_to_month": (
        lambda t: t("orders").select(cal.iso_week("o_orderdate").alias("week")).distinct().select("week", cal.week_to_month("week").alias("month")),
        "WITH k AS (SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week FROM {orders}) SELECT week, strftime(make_date(CAST(substr(week, 1, 4) AS BIGINT), 1, 4) + CAST(7 * (CAST(substr(week, 7, 2) AS INTEGER) - 1) AS INTEGER), '%Y-%m') AS month FROM k",
    ),
    "json_children": (
        children,
        "SELECT ord, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) - 1 AS ord, l_linenumber FROM {lineitem}) GROUP BY 1",
    ),
}
