"""Queries on activity: calendar, people, roll-ups, ranking and ratings, with their SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DATA_EXTENSIONS, EXCLUDED_ROLES, Impact
from tidemark.functions import calendar as cal
from tidemark.operators import elo, flow, impact, people, ranking, rollup
from tidemark.sources.staging import staged

D = 4  # digits to which doubles are compared


def r(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), D).alias(name or c)


def n(c: str):
    return F.col(c).cast("long").alias(c)


def days(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


ATTRIBUTED = """
  att_i AS (SELECT d.dev, i.issue_key, i.created, i.updated, i.story_points, i.assignee, i.reporter, i.label,
                   CASE WHEN i.assignee = d.account THEN i.resolved END AS resolved
            FROM {issues} i JOIN {roster_dev} d ON d.account = i.assignee OR d.account = i.reporter),
  att_p AS (SELECT l.dev, p.* FROM {prs} p JOIN {roster_login} l ON l.login = p.author),
  att_c AS (SELECT l.dev, c.* FROM {commits} c JOIN {roster_login} l ON l.login = c.author),
  att_r AS (SELECT l.dev, v.* FROM {reviews} v JOIN {roster_login} l ON l.login = v.reviewer),
  fact AS (
    SELECT dev, updated AS ts, 'touched' AS measure, 1.0 AS value FROM att_i
    UNION ALL SELECT dev, created, 'created', 1.0 FROM att_i
    UNION ALL SELECT dev, resolved, 'resolved', 1.0 FROM att_i WHERE resolved IS NOT NULL
    UNION ALL SELECT dev, resolved, 'story_points', story_points FROM att_i WHERE resolved IS NOT NULL AND story_points > 0
    UNION ALL SELECT dev, resolved, 'scored', 1.0 FROM att_i WHERE resolved IS NOT NULL AND story_points > 0
    UNION ALL SELECT dev, created, 'prs_created', 1.0 FROM att_p
    UNION ALL SELECT dev, merged, 'prs_merged', 1.0 FROM att_p WHERE merged IS NOT NULL
    UNION ALL SELECT dev, merged, 'loc', additions + deletions FROM att_p WHERE merged IS NOT NULL
    UNION ALL SELECT dev, committed, 'commits', 1.0 FROM att_c
    UNION ALL SELECT dev, submitted, 'reviewed', 1.0 FROM att_r)"""
SUMS = ", ".join(f"round(coalesce(sum(CASE WHEN measure = '{m}' THEN value END), 0), 4)::DOUBLE AS {m}" for m in rollup.MEASURES)
WEEKS = "count(DISTINCT CASE WHEN measure IN ('touched','created','resolved','prs_created','prs_merged','reviewed','commits') THEN date_trunc('week', ts) END) AS active_weeks"
WEEK_SQL = "date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', {0}) AS DATE)) // 7"
PERIOD_SQL = "strftime(ts, '%G') || '-P' || lpad(CAST(CAST(strftime(ts, '%V') AS INTEGER) - 1 + CAST(strftime(ts, '%V') AS INTEGER) % 2 AS VARCHAR), 2, '0')"
WINDOWS = [("current", "2000-01-01", "2001-01-01"), ("prior", "1999-01-01", "2000-01-01"), ("half", "2000-07-01", "2001-01-01"), ("yoy", "1999-07-01", "2000-01-01")]
WINDOW_SQL = "win(w, a, b) AS (VALUES " + ", ".join(f"('{w}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for w, a, b in WINDOWS) + ")"


def _facts(t) -> DataFrame:
    return rollup.attributed(t("issues"), t("prs"), t("commits"), t("reviews"), t("roster_dev"), t("roster_login"))


def monthly_rollup(t):
    rows = _facts(t)
    spine = cal.month_spine(cal.bounds_of(rows, "ts")).select(F.date_format("month", "yyyy-MM").alias("bucket"))
    return rollup.rollup(rows, cal.month_key("ts"), spine, t("roster_dev")).select("dev", "bucket", *[r(m) for m in rollup.MEASURES])


def weekly_rollup(t):
    rows = _facts(t)
    spine = cal.week_spine(cal.bounds_of(rows, "ts")).select(cal.iso_week("week").alias("bucket"))
    return rollup.rollup(rows, cal.iso_week("ts"), spine, t("roster_dev")).select("dev", "bucket", *[r(m) for m in rollup.MEASURES])


def dev_totals(t):
    return rollup.person_totals(_dated(t)).select("dev", *[r(m) for m in rollup.MEASURES], n("active_weeks"))


def window_compare(t):
    spark = t("roster_dev").sparkSession
    found = rollup.window_totals(_facts(t), cal.windows_frame(spark, WINDOWS))
    return found.select("dev", "window", *[r(m) for m in rollup.MEASURES], n("active_weeks"))


def window_delta(t):
    spark = t("roster_dev").sparkSession
    found = rollup.window_totals(_facts(t), cal.windows_frame(spark, WINDOWS))
    return rollup.compare_windows(found, "current", "prior", "prs_merged").select("dev", r("now"), r("before"), r("delta"), r("percent"))


def _dated(t) -> DataFrame:
    return rollup.dated(t("issues"), t("prs"), t("commits"), t("reviews"), t("roster_dev"), t("roster_login"))


def _devs_files(t):
    return rollup.unique_files(people.attribute_github(t("prs"), t("roster_login"), "author"), t("pr_files"), ["dev"])


def _cohorts(t, *sides: Impact) -> list[DataFrame]:
    """Totals, files, progress, multiplier and dampened impact of scoreable people, for each of the knobs, which may differ by
    families alone; lines are capped among the people.

    Requests with their files are written once, so are the paths and, a row for each person, the cohort."""
    alike = {replace(k, family_members=0, family_cv=0, family_weight=0, family_token=0) for k in sides}
    if len(alike) > 1:
        raise ValueError("knobs differ by more than families")
    logins, roster = t("roster_login"), t("roster_dev")
    names, kinds = impact.named_paths(t("file_paths"))
    rows = staged(impact.request_files(t("prs"), t("file_lines"), kinds, sides[0], repeated=True), "request-files")  # the SQL has a weight for each row of a number
    families = [staged(impact.families(rows, names, k), "families") for k in sides]
    asked = rows.where("lead").select("author", "created", "merged", F.col("loc").alias("additions"), F.lit(0).alias("deletions"))
    wide = rollup.person_totals(rollup.dated(t("issues"), asked, t("commits"), t("reviews"), roster, logins)).drop("created")
    wide = wide.join(people.scoreable(roster, logins).select("dev"), "dev", "left_semi")
    for part in (impact.effective(rows, logins, families), rollup.progressed(t("moves"), roster, []), rollup.issues_created(t("issues"), roster, []).withColumnRenamed("created_keys", "created")):
        wide = wide.join(part, "dev", "left")
    own = [f"effective_{c}_{i}" for c in ("files", "loc") for i in range(len(sides))]
    wide = staged(wide.fillna(0, ["unique_files", "progressed", "created"]).fillna(0.0, own), "cohort")
    out = []
    for i in range(len(sides)):
        side = wide.withColumnsRenamed({f"effective_{c}_{i}": f"effective_{c}" for c in ("files", "loc")})
        capped = impact.cap_impact(side.select("*", F.col("effective_files").alias("files"), F.col("prs_merged").alias("prs")), loc="effective_loc")
        out.append(staged(ranking.effort_multiplier(capped), "people"))  # a row for each person, read again for the statistics of all
    return out


def _leaderboard(t, knobs: Impact = Impact()) -> DataFrame:
    return _cohorts(t, knobs)[0]


def _ranked(wide: DataFrame) -> DataFrame:
    return ranking.rank_cohort(ranking.scores(ranking.metrics(wide, []), []), [])


def leaderboard(t):
    return _ranked(_leaderboard(t)).select("dev", r("score"), n("rank"))


def score_breakdown(t):
    z = ranking.by_metric(ranking.standard(ranking.metrics(_leaderboard(t), []), []), [])
    return ranking.breakdown(z, []).select("dev", "metric", r("z"), r("contribution"))


NOISE = r"regexp_full_match(lower(path), '(.*/)?[^/]*\.lock|(.*/)?package-lock\.json|(.*/)?[^/]*\.min\.js|(.*/|)vendor/.*|(.*/|)node_modules/.*|(.*/|)generated/.*|(.*/)?[^/]*\.snap')"
EXT = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"
DATA = "(" + ", ".join(f"'{e}'" for e in DATA_EXTENSIONS) + ")"


def family_sql(most: int, cv: float, files: str = "{pr_files}", members: int = 3) -> str:
    """fo: members of families (r > 1: damped)."""
    return rf"""
  fm AS (SELECT f.path, max(f.additions + f.deletions) AS loc FROM {files} f JOIN {{prs}} p USING (repo, pr_number) WHERE f.status = 'added' AND p.merged IS NOT NULL GROUP BY f.path),
  fk AS (SELECT path, loc, regexp_extract(path, '^(.*/)?', 0) AS folder, regexp_extract(path, '\.([^./]*)$', 1) AS ext, regexp_split_to_array(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '[-_.]') AS tok FROM fm),
  fs AS (SELECT path, loc, folder || array_to_string(list_transform(tok, lambda x: CASE WHEN length(x) <= {most} AND regexp_full_match(x, '[A-Za-z0-9]+') THEN '#' ELSE x END), '-') || '.' || lower(ext) AS stem FROM fk
         WHERE len(list_filter(tok, lambda x: length(x) <= {most} AND regexp_full_match(x, '[A-Za-z0-9]+'))) > 0),
  fg AS (SELECT stem FROM fs GROUP BY stem HAVING count(*) >= {members} AND avg(loc) > 0 AND stddev_pop(loc) <= {cv} * avg(loc)),
  fo AS (SELECT path, row_number() OVER (PARTITION BY stem ORDER BY loc DESC, path) AS r FROM fs JOIN fg USING (stem))"""


def effective_sql(k: Impact, files: str = "{pr_files}", integration: str = "", bulk: bool = False, churn: bool = False) -> str:
    """ef and el: files and lines per person as the survey states them; ``integration``: a table of (repo, pr_number, weight)."""
    share = f"(SELECT repo, pr_number, {EXT} AS ext, count(DISTINCT path) AS n FROM {files} GROUP BY 1, 2, 3)"
    weight = f"(SELECT repo, pr_number, weight AS integ FROM {integration})" if integration else "(SELECT repo, pr_number, 1.0 AS integ FROM {prs})"
    out = f"{NOISE} OR (({EXT} IN {DATA} OR {EXT} = 'xml') AND f.additions + f.deletions > {k.dump_ceiling})"
    step = (1 - k.churn_floor) / (k.churn_full_at - 1)
    churned = f" * least(1.0, {k.churn_floor} + {step} * greatest(coalesce(touches, 0) - 1, 0))" if churn else ""
    damp = f"CASE WHEN additions + deletions >= {k.bulk_loc} AND additions >= {k.bulk_add_ratio} * (additions + deletions) AND coalesce(n_added, 0) >= {k.bulk_files} THEN {k.bulk_weight} ELSE 1.0 END" if bulk else "1.0"
    lines = f"(additions + {k.deletion_weight}::DOUBLE * deletions)"
    each = "true" if churn else "(SELECT count(*) FROM fo WHERE r > 1) > 0"
    return f"""{family_sql(k.family_token, k.family_cv, files, k.family_members)},
  dp AS (SELECT repo, pr_number, sum(n) >= {k.dump_files} AND max(n) >= {k.dump_share} * sum(n) AND max(struct_pack(n := n, ext := ext)).ext IN {DATA} AS dump FROM {share} GROUP BY 1, 2),
  mp AS (SELECT p.repo, p.pr_number, l.dev, p.additions, p.deletions, coalesce(g.integ, 1.0) AS integ FROM {{prs}} p JOIN {{roster_login}} l ON l.login = p.author LEFT JOIN {weight} g USING (repo, pr_number) WHERE p.merged IS NOT NULL),
  ff AS (SELECT dev, path, max(CASE WHEN dp.dump AND {EXT} IN {DATA} THEN {k.dump_weight} WHEN {NOISE} THEN {k.generated_weight} ELSE 1.0 END * CASE WHEN fo.r > 1 THEN {k.family_weight} ELSE 1.0 END * integ) AS w
         FROM {files} f JOIN mp USING (repo, pr_number) LEFT JOIN dp USING (repo, pr_number) LEFT JOIN fo USING (path) GROUP BY 1, 2),
  ef AS (SELECT dev, count(*) AS unique_files, sum(w) AS effective_files FROM ff GROUP BY 1),
  ch AS (SELECT path, count(*) AS touches FROM (SELECT DISTINCT repo, pr_number, path FROM {files}) JOIN {{prs}} USING (repo, pr_number) WHERE merged IS NOT NULL GROUP BY path),
  fl AS (SELECT f.repo, f.pr_number, sum(CASE WHEN {out} THEN 0 ELSE (f.additions + {k.deletion_weight}::DOUBLE * f.deletions) * CASE WHEN fo.r > 1 THEN {k.family_weight} ELSE 1.0 END{churned} END) AS net,
           sum(CASE WHEN {out} THEN f.additions + {k.deletion_weight}::DOUBLE * f.deletions ELSE 0 END) AS excluded, sum(CASE WHEN f.status = 'added' THEN 1 ELSE 0 END) AS n_added
         FROM {files} f LEFT JOIN fo USING (path) LEFT JOIN ch USING (path) GROUP BY 1, 2),
  el AS (SELECT dev, sum(integ * CASE WHEN dump THEN {k.dump_weight}::DOUBLE * {lines} WHEN net IS NOT NULL AND {each} THEN {damp} * net ELSE {damp} * greatest(0, {lines} - coalesce(excluded, 0)) END) AS effective_loc
         FROM mp LEFT JOIN fl USING (repo, pr_number) LEFT JOIN dp USING (repo, pr_number) GROUP BY 1)"""


EFFECTIVE = effective_sql(Impact())
LEADER_SQL = f"""WITH {ATTRIBUTED},
  tot AS (SELECT dev, {SUMS}, {WEEKS} FROM fact GROUP BY dev),
  {EFFECTIVE},
  pg AS (SELECT d.dev, count(DISTINCT c.issue_key) AS progressed FROM {{changelog}} c JOIN {{roster_dev}} d ON d.account = c.author WHERE c.to_status IN ('In Progress','Code Review','Ready QA','In QA') GROUP BY d.dev),
  cr AS (SELECT d.dev, count(DISTINCT i.issue_key) AS n FROM {{issues}} i JOIN {{roster_dev}} d ON d.account = i.reporter GROUP BY d.dev),
  w1 AS (SELECT tot.* EXCLUDE (created), coalesce(cr.n, 0) AS created, coalesce(unique_files, 0) AS unique_files, coalesce(effective_files, 0) AS effective_files, coalesce(effective_loc, 0) AS effective_loc, coalesce(progressed, 0) AS progressed
         FROM tot LEFT JOIN ef USING (dev) LEFT JOIN el USING (dev) LEFT JOIN pg USING (dev) LEFT JOIN cr USING (dev) JOIN {{roster_dev}} d USING (dev) WHERE d.role NOT IN ({", ".join(f"'{x}'" for x in EXCLUDED_ROLES)})),
  wc AS (SELECT *, least(effective_loc, quantile_cont(effective_loc, 0.99) OVER ()) AS capped_loc FROM w1),
  w2 AS (SELECT *, CASE WHEN effective_files + 0.5 * capped_loc + 2 * prs_merged > 0 THEN sqrt(effective_files + 0.5 * capped_loc + 2 * prs_merged) ELSE 0 END AS code_impact,
                quantile_cont(CASE WHEN unique_files > 0 THEN loc / unique_files END, 0.9) OVER () AS lim FROM wc),
  w3 AS (SELECT *, greatest(0.5, coalesce(greatest(0.5, 1 - 0.25 * greatest(0, CASE WHEN unique_files > 0 THEN commits / unique_files END - 1.5)), 1)
                * CASE WHEN lim > 0 THEN coalesce(greatest(0.5, 1 - 0.25 * greatest(0, CASE WHEN unique_files > 0 THEN loc / unique_files END / lim - 1)), 1) ELSE 1 END) AS m FROM w2),
  w4 AS (SELECT *, quantile_cont(loc * m, 0.95) OVER () AS cap FROM w3),
  mx AS (SELECT dev, prs_merged, resolved, code_impact * m AS code_impact, reviewed AS prs_reviewed, prs_created, CAST(progressed AS DOUBLE) AS progressed, CAST(active_weeks AS DOUBLE) AS active_weeks,
                CASE WHEN scored > 0 THEN story_points / scored ELSE 0.0 END AS story_points, sqrt(created) AS created, sqrt(least(loc * m, cap)) AS loc, commits * m AS commits FROM w4),
  lg AS (UNPIVOT mx ON prs_merged, resolved, code_impact, prs_reviewed, prs_created, progressed, active_weeks, story_points, created, loc, commits INTO NAME metric VALUE value),
  st AS (SELECT *, avg(CASE WHEN metric <> 'story_points' OR value > 0 THEN value END) OVER (PARTITION BY metric) AS mu, stddev_pop(CASE WHEN metric <> 'story_points' OR value > 0 THEN value END) OVER (PARTITION BY metric) AS sd FROM lg),
  zz AS (SELECT dev, metric, CASE WHEN sd IS NULL OR sd < 1e-12 * greatest(1, abs(mu)) OR (metric = 'story_points' AND value <= 0) THEN 0 ELSE (value - mu) / sd END AS z FROM st),
  wt(metric, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in ranking.WEIGHTS.items())}),
  co AS (SELECT dev, metric, z, z * weight AS contribution FROM zz JOIN wt USING (metric))"""


def period_totals(t):
    found = rollup.period_totals(_dated(t), rollup.own_moves(t("moves"), t("roster_dev")))
    return found.select("dev", "period", *[r(m) for m in rollup.MEASURES if m not in ("story_points", "scored")], n("active_weeks"), n("progressed"))


def _event_scores(t):
    """Scores per person and bi-weekly period from the event stream: the mean value of a person's events."""
    rows = t("events").withColumn("period", cal.period_label("ts"))
    return rows.groupBy(F.concat(F.lit("e"), F.col("event_type")).alias("league"), "period", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dev")).agg(F.avg("value").alias("score"))


def round_robin(t):
    return elo.round_robin(_event_scores(t)).select("league", "period", "dev", r("outcome"))


CURRENT = (date(2000, 7, 1), date(2000, 12, 1))
COMPARED = cal.comparison_windows(*CURRENT)
COMPARED_SQL = "win(w, a, b) AS (VALUES " + ", ".join(f"('{w}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for w, a, b in COMPARED) + ")"
TOTALS = ("touched", "resolved", "story_points", "scored", "prs_created", "prs_merged", "loc", "commits", "reviewed")


def dev_windows(t):
    """The window, those it is compared with and the last four quarters, of everyone and of nobody known at once; distinct
    measures are taken again in each."""
    windows = cal.windows_frame(t("roster_dev").sparkSession, COMPARED)
    sources = [t(x) for x in ("issues", "prs", "commits", "reviews", "roster_dev", "roster_login")]
    rows = _facts(t).unionByName(rollup.unknown_facts(*sources))
    own = people.attribute_github(t("prs"), t("roster_login"), "author").where("merged IS NOT NULL")
    paths = own.select("dev", "merged", "repo", "pr_number").join(t("pr_files").select("repo", "pr_number", "path"), ["repo", "pr_number"])
    found = rollup.window_totals(rows, windows).drop("created")
    for part in (
        rollup.keys_in_windows(rollup.own_moves(t("changelog"), t("roster_dev")), "at", "issue_key", windows, "progressed"),
        rollup.keys_in_windows(rollup.reported(t("issues"), t("roster_dev")), "created", "issue_key", windows, "created"),
        rollup.keys_in_windows(paths, "merged", "path", windows, "unique_files"),
    ):
        found = found.join(part, ["dev", "window"], "left")
    return found.fillna(0, ["progressed", "created", "unique_files"]).select("dev", "window", *[r(m) for m in TOTALS], *[n(c) for c in ("active_weeks", "progressed", "created", "unique_files")])


UNKNOWN_SQL = """
  un_i AS (SELECT * FROM {issues} WHERE (assignee <> '' AND assignee NOT IN (SELECT account FROM {roster_dev})) OR (reporter <> '' AND reporter NOT IN (SELECT account FROM {roster_dev}))),
  un_p AS (SELECT * FROM {prs} WHERE author NOT IN (SELECT login FROM {roster_login})), un_c AS (SELECT * FROM {commits} WHERE author NOT IN (SELECT login FROM {roster_login})),
  un_r AS (SELECT * FROM {reviews} WHERE reviewer NOT IN (SELECT login FROM {roster_login}) AND reviewer NOT LIKE '%[bot]'),
  al AS (SELECT * FROM fact UNION ALL SELECT 'unknown', updated, 'touched', 1.0 FROM un_i UNION ALL SELECT 'unknown', created, 'created', 1.0 FROM un_i UNION ALL SELECT 'unknown', resolved, 'resolved', 1.0 FROM un_i WHERE resolved IS NOT NULL
    UNION ALL SELECT 'unknown', resolved, 'story_points', story_points FROM un_i WHERE resolved IS NOT NULL AND story_points > 0 UNION ALL SELECT 'unknown', resolved, 'scored', 1.0 FROM un_i WHERE resolved IS NOT NULL AND story_points > 0
    UNION ALL SELECT 'unknown', created, 'prs_created', 1.0 FROM un_p UNION ALL SELECT 'unknown', merged, 'prs_merged', 1.0 FROM un_p WHERE merged IS NOT NULL UNION ALL SELECT 'unknown', merged, 'loc', additions + deletions FROM un_p WHERE merged IS NOT NULL
    UNION ALL SELECT 'unknown', committed, 'commits', 1.0 FROM un_c UNION ALL SELECT 'unknown', submitted, 'reviewed', 1.0 FROM un_r)"""


def cohort_scores(t):
    """(period, dev, score) of the scoreable people who were active in a period."""
    periods = rollup.period_totals(_dated(t), rollup.own_moves(t("moves"), t("roster_dev"))).join(people.scoreable(t("roster_dev"), t("roster_login")).select("dev"), "dev", "left_semi")
    return elo.period_scores(periods)


def _cohort_outcomes(t):
    keyed = cohort_scores(t).join(elo.dev_keys(t("roster_dev"), t("roster_login")), "dev").drop("dev").withColumnRenamed("dev_key", "dev")
    return elo.round_robin(keyed.withColumn("league", F.lit("org")))


def cohort_history(t):
    """Ratings of the cohort over the periods that were over by a day."""
    return elo.advance(_cohort_outcomes(t), None, None, now=F.lit("2001-06-30"), first_period="1996-P01")


COHORT_SQL = f"""WITH {ATTRIBUTED}, pt AS (SELECT dev, {PERIOD_SQL} AS period, {SUMS}, count(DISTINCT CASE WHEN measure IN ('touched','prs_created','prs_merged','commits','reviewed') THEN date_trunc('week', ts) END) AS active_weeks FROM fact GROUP BY 1, 2),
  mv AS (SELECT d.dev, {PERIOD_SQL.replace("ts", "c.at").replace("sc.atrftime", "strftime")} AS period, count(DISTINCT c.issue_key) AS progressed FROM {{changelog}} c JOIN {{roster_dev}} d ON d.account = c.author WHERE c.to_status IN ('In Progress','Code Review','Ready QA','In QA') GROUP BY 1, 2),
  pa AS (SELECT pt.*, coalesce(progressed, 0) AS progressed, quantile_cont(loc, 0.95) OVER (PARTITION BY period) AS cap FROM pt LEFT JOIN mv USING (dev, period) JOIN {{roster_dev}} d USING (dev) WHERE prs_created + prs_merged + reviewed + commits > 0 AND d.role NOT IN ('qa', 'exec', 'excluded')),
  pm AS (SELECT dev, period, prs_merged, resolved, reviewed AS prs_reviewed, prs_created, progressed::DOUBLE AS progressed, active_weeks::DOUBLE AS active_weeks, sqrt(created) AS created, sqrt(least(loc, cap)) AS loc, commits FROM pa),
  pl AS (UNPIVOT pm ON prs_merged, resolved, prs_reviewed, prs_created, progressed, active_weeks, created, loc, commits INTO NAME metric VALUE value),
  ps AS (SELECT *, avg(value) OVER (PARTITION BY period, metric) AS mu, stddev_pop(value) OVER (PARTITION BY period, metric) AS sd FROM pl),
  pw(metric, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in ranking.WEIGHTS.items())}),
  pc AS (SELECT period, dev, sum(weight * CASE WHEN sd IS NULL OR sd < 1e-12 * greatest(1, abs(mu)) THEN 0 ELSE (value - mu) / sd END) AS score FROM ps JOIN pw USING (metric) GROUP BY 1, 2)"""


def rating_history(t):
    return elo.rating_walk(elo.round_robin(_event_scores(t)))


def rating_attached(t):
    """Everyone in every league, rated or not."""
    who = t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dev")).distinct()
    leagues = t("events").select(F.concat(F.lit("e"), F.col("event_type")).alias("league")).distinct()
    return elo.attach(who.crossJoin(F.broadcast(leagues)), rating_history(t), league="league")  # the result's own size: people x leagues


QUERIES = {
    "cal_labels": (
        lambda t: t("orders").select(cal.month_key("o_orderdate").alias("month"), cal.iso_week("o_orderdate").alias("week"), cal.quarter_label("o_orderdate").alias("quarter"), cal.period_label("o_orderdate").alias("period"), F.date_format(cal.period_start("o_orderdate"), "yyyy-MM-dd").alias("start"), F.date_format(cal.period_end("o_orderdate"), "yyyy-MM-dd").alias("stop"), cal.week_ordinal("o_orderdate").alias("ordinal")).groupBy("month", "week", "quarter", "period", "start", "stop", "ordinal").agg(F.count("*").alias("n")),
        f"""WITH d AS (SELECT o_orderdate AS ts, CAST(strftime(o_orderdate, '%V') AS INTEGER) AS w, CAST(date_trunc('week', o_orderdate) AS DATE) AS mon FROM {{orders}}),
            e AS (SELECT ts, w, mon - CAST(((w + 1) % 2) * 7 AS INTEGER) AS s FROM d)
            SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%G-W%V') AS week, CAST(year(ts) AS VARCHAR) || '-Q' || CAST(quarter(ts) AS VARCHAR) AS quarter, {PERIOD_SQL} AS period,
                   strftime(s, '%Y-%m-%d') AS start, strftime(s + CASE WHEN w = 53 THEN 7 ELSE 14 END, '%Y-%m-%d') AS stop, CAST({WEEK_SQL.format("ts")} AS BIGINT) AS ordinal, count(*) AS n
            FROM e GROUP BY ALL""",
    ),
    "cal_month_spine": (
        lambda t: cal.month_spine(cal.bounds_of(t("orders"), "o_orderdate")).select(days("month")),
        "SELECT strftime(m, '%Y-%m-%d') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM {orders})",
    ),
    "cal_period_spine": (
        lambda t: cal.period_spine(cal.bounds_of(t("orders"), "o_orderdate")).select("period", days("start"), days("stop")),
        f"""WITH m AS (SELECT unnest(generate_series(CAST(date_trunc('week', min(o_orderdate)) AS TIMESTAMP), max(o_orderdate), INTERVAL 7 DAY)) AS ts FROM {{orders}}),
            e AS (SELECT ts, CAST(strftime(ts, '%V') AS INTEGER) AS w FROM m)
            SELECT DISTINCT {PERIOD_SQL} AS period, strftime(CAST(ts AS DATE) - CAST(((w + 1) % 2) * 7 AS INTEGER), '%Y-%m-%d') AS start,
              strftime(CAST(ts AS DATE) - CAST(((w + 1) % 2) * 7 AS INTEGER) + CASE WHEN w = 53 THEN 7 ELSE 14 END, '%Y-%m-%d') AS stop FROM e""",
    ),
    "cal_ranges": (
        lambda t: cal.resolve_range(cal.bounds_of(t("orders"), "o_orderdate"), ["3m", "6m", "12m", "24m", "ytd", "all"]).select("name", days("start"), days("stop")),
        """WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM {orders}),
           k AS (SELECT '3m' AS name, z - INTERVAL 2 MONTH AS s, z, a FROM b UNION ALL SELECT '6m', z - INTERVAL 5 MONTH, z, a FROM b UNION ALL SELECT '12m', z - INTERVAL 11 MONTH, z, a FROM b
                 UNION ALL SELECT '24m', z - INTERVAL 23 MONTH, z, a FROM b UNION ALL SELECT 'ytd', date_trunc('year', z), z, a FROM b UNION ALL SELECT 'all', a, z, a FROM b)
           SELECT name, strftime(greatest(s, a), '%Y-%m-%d') AS start, strftime(z, '%Y-%m-%d') AS stop FROM k""",
    ),
    "rollup_monthly": (
        monthly_rollup,
        f"""WITH {ATTRIBUTED}, sp AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(ts)), max(ts), INTERVAL 1 MONTH)), '%Y-%m') AS bucket FROM fact),
            own AS (SELECT dev, strftime(ts, '%Y-%m') AS bucket, {SUMS} FROM fact GROUP BY 1, 2)
            SELECT d.dev, sp.bucket, {", ".join(f"coalesce({m}, 0.0) AS {m}" for m in rollup.MEASURES)} FROM {{roster_dev}} d CROSS JOIN sp LEFT JOIN own ON own.dev = d.dev AND own.bucket = sp.bucket""",
    ),
    "rollup_weekly": (
        weekly_rollup,
        f"""WITH {ATTRIBUTED}, sp AS (SELECT strftime(unnest(generate_series(CAST(date_trunc('week', min(ts)) AS TIMESTAMP), CAST(date_trunc('week', max(ts)) AS TIMESTAMP), INTERVAL 7 DAY)), '%G-W%V') AS bucket FROM fact),
            own AS (SELECT dev, strftime(ts, '%G-W%V') AS bucket, {SUMS} FROM fact GROUP BY 1, 2)
            SELECT d.dev, sp.bucket, {", ".join(f"coalesce({m}, 0.0) AS {m}" for m in rollup.MEASURES)} FROM {{roster_dev}} d CROSS JOIN sp LEFT JOIN own ON own.dev = d.dev AND own.bucket = sp.bucket""",
    ),
    "dev_totals": (dev_totals, f"WITH {ATTRIBUTED} SELECT dev, {SUMS}, {WEEKS} FROM fact GROUP BY dev"),
    "window_compare": (window_compare, f"WITH {ATTRIBUTED}, {WINDOW_SQL} SELECT dev, w AS \"window\", {SUMS}, {WEEKS} FROM fact JOIN win ON ts >= a AND ts < b GROUP BY dev, w"),
    "window_delta": (
        window_delta,
        f"""WITH {ATTRIBUTED}, s AS (SELECT dev, sum(CASE WHEN ts >= TIMESTAMP '2000-01-01' AND measure = 'prs_merged' THEN value ELSE 0 END) AS now, sum(CASE WHEN ts < TIMESTAMP '2000-01-01' AND measure = 'prs_merged' THEN value ELSE 0 END) AS before
            FROM fact WHERE ts >= TIMESTAMP '1999-01-01' AND ts < TIMESTAMP '2001-01-01' GROUP BY dev)
            SELECT dev, now::DOUBLE AS now, before::DOUBLE AS before, (now - before)::DOUBLE AS delta, round(CASE WHEN before <> 0 THEN 100 * (now - before) / abs(before) END, 4)::DOUBLE AS percent FROM s""",
    ),
    "unique_files": (_devs_files, "SELECT l.dev, count(DISTINCT f.path) AS unique_files FROM {prs} p JOIN {roster_login} l ON l.login = p.author JOIN {pr_files} f USING (repo, pr_number) WHERE p.merged IS NOT NULL GROUP BY l.dev"),
    "issues_progressed": (
        lambda t: rollup.progressed(t("changelog"), t("roster_dev"), [cal.month_key("at").alias("month")]),
        "SELECT d.dev, strftime(c.at, '%Y-%m') AS month, count(DISTINCT c.issue_key) AS progressed FROM {changelog} c JOIN {roster_dev} d ON d.account = c.author WHERE c.to_status IN ('In Progress','Code Review','Ready QA','In QA') GROUP BY 1, 2",
    ),
    "issues_created": (
        lambda t: rollup.issues_created(t("issues"), t("roster_dev"), [cal.month_key("created").alias("month")]),
        "SELECT d.dev, strftime(i.created, '%Y-%m') AS month, count(DISTINCT i.issue_key) AS created_keys FROM {issues} i JOIN {roster_dev} d ON d.account = i.reporter GROUP BY 1, 2",
    ),
    "attributed_issues": (
        lambda t: people.attribute_issues(t("issues"), t("roster_dev")).groupBy("dev").agg(F.count("*").alias("issues"), F.count("resolved").alias("resolved")),
        "SELECT d.dev, count(*) AS issues, count(CASE WHEN i.assignee = d.account THEN i.resolved END) AS resolved FROM {issues} i JOIN {roster_dev} d ON d.account = i.assignee OR d.account = i.reporter GROUP BY d.dev",
    ),
    "unknown_github": (
        lambda t: people.unknown_github(t("reviews"), t("roster_login"), "reviewer").groupBy("reviewer").agg(F.count("*").alias("n")),
        "SELECT reviewer, count(*) AS n FROM {reviews} WHERE reviewer NOT IN (SELECT login FROM {roster_login}) AND NOT regexp_full_match(lower(reviewer), '.*\\[bot\\]|dependabot|renovate|github-actions|claude.*') GROUP BY 1",
    ),
    "unknown_issues": (
        lambda t: people.unknown_issues(t("issues"), t("roster_dev")).groupBy(cal.month_key("updated").alias("month")).agg(F.count("*").alias("n"), F.count("resolved").alias("resolved")),
        "SELECT strftime(updated, '%Y-%m') AS month, count(*) AS n, count(resolved) AS resolved FROM {issues} WHERE assignee NOT IN (SELECT account FROM {roster_dev}) OR reporter NOT IN (SELECT account FROM {roster_dev}) GROUP BY 1",
    ),
    "scoreable_devs": (
        lambda t: people.scoreable(t("roster_dev"), t("roster_login")).select("dev", "role"),
        "SELECT dev, role FROM {roster_dev} WHERE role NOT IN ('qa', 'exec', 'excluded')",
    ),
    "dev_keys": (
        lambda t: elo.dev_keys(t("roster_dev").withColumn("account", F.when(F.col("dev_ord") % 4 == 0, "").otherwise(F.col("account"))), t("roster_login").where("dev <> 'dev8'")),
        "SELECT d.dev, CASE WHEN dev_ord % 4 <> 0 THEN account ELSE 'gh:' || min(login) END AS dev_key FROM {roster_dev} d LEFT JOIN {roster_login} l USING (dev) WHERE d.dev <> 'dev8' GROUP BY d.dev, dev_ord, account",
    ),
    "self_scope": (
        lambda t: people.only_person(t("prs"), t("roster_login"), "author", "dev3").groupBy("repo").agg(F.count("*").alias("n")),
        "SELECT repo, count(*) AS n FROM {prs} WHERE author IN (SELECT login FROM {roster_login} WHERE dev = 'dev3') GROUP BY repo",
    ),
    "activity_by_login": (
        lambda t: people.activity_by_login(t("prs"), t("commits"), t("reviews")),
        "SELECT login, count(*) AS n FROM (SELECT author AS login FROM {prs} UNION ALL SELECT author FROM {commits} UNION ALL SELECT reviewer FROM {reviews}) GROUP BY login",
    ),
    "primary_login": (
        lambda t: people.primary_login(people.activity_by_login(t("prs"), t("commits"), t("reviews")), t("roster_login")).select("dev", "login", n("n")),
        """WITH a AS (SELECT login, count(*) AS n FROM (SELECT author AS login FROM {prs} UNION ALL SELECT author FROM {commits} UNION ALL SELECT reviewer FROM {reviews}) GROUP BY login),
           k AS (SELECT l.dev, l.login, coalesce(a.n, 0) AS n, row_number() OVER (PARTITION BY l.dev ORDER BY coalesce(a.n, 0) DESC, l.login) AS r FROM {roster_login} l LEFT JOIN a USING (login))
           SELECT dev, login, n FROM k WHERE r = 1""",
    ),
    "active_people": (
        lambda t: rollup.active_people(rollup.totals(_facts(t).withColumn("month", cal.month_key("ts")), ["dev", "month"]), "month"),
        f"WITH {ATTRIBUTED} SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT CASE WHEN measure IN ('prs_merged','commits','resolved','reviewed','touched') THEN dev END) AS active FROM fact GROUP BY 1",
    ),
    "grouped_counts": (
        lambda t: rollup.grouped_counts(t("prs")),
        "SELECT coalesce(repo, '*') AS repo, coalesce(branch, '*') AS branch, count(*) AS prs, CAST(sum(additions + deletions) AS BIGINT) AS loc, CAST(grouping(repo, branch) AS BIGINT) AS level FROM {prs} GROUP BY CUBE (repo, branch)",
    ),
    "effort_multiplier": (lambda t: _leaderboard(t).select("dev", r("multiplier")), LEADER_SQL + " SELECT dev, round(m, 4) AS multiplier FROM w3"),
    "leaderboard": (leaderboard, LEADER_SQL + " SELECT dev, round(sum(contribution), 4) AS score, row_number() OVER (ORDER BY sum(contribution) DESC, dev) AS rank FROM co GROUP BY dev"),
    "score_breakdown": (score_breakdown, LEADER_SQL + " SELECT dev, metric, round(z, 4)::DOUBLE AS z, round(contribution, 4)::DOUBLE AS contribution FROM co WHERE contribution <> 0"),
    "code_impact": (
        lambda t: _leaderboard(t).select("dev", r("code_impact")),
        LEADER_SQL + " SELECT dev, round(code_impact, 4) AS code_impact FROM w2",
    ),
    "mid_ranks": (
        lambda t: ranking.mid_ranks(t("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "place", []).select("s_suppkey", r("place")),
        "SELECT s_suppkey, round(rank() OVER (ORDER BY s_nationkey DESC) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0, 4)::DOUBLE AS place FROM {supplier}",
    ),
    "spearman": (
        lambda t: ranking.spearman(t("part"), "p_retailprice", "p_size", ["p_brand"]).select("p_brand", "n", r("rho")),
        """WITH k AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS a,
                     rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS b FROM {part})
           SELECT p_brand, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE 1 - 6 * sum((a - b) * (a - b)) / (CAST(count(*) AS DOUBLE) * (count(*) * count(*) - 1)) END, 4) AS rho FROM k GROUP BY p_brand""",
    ),
    "normalisers": (
        lambda t: t("part").select("p_partkey", F.round(ranking.logistic_z(F.col("p_retailprice"), _by("p_brand")), D).alias("logistic"), F.round(ranking.min_max(F.col("p_retailprice"), _by("p_brand")), D).alias("scaled")),
        """SELECT p_partkey, round(CASE WHEN count(*) OVER w < 2 OR stddev_pop(p_retailprice) OVER w < 1e-12 THEN 0.5 ELSE 1 / (1 + exp(-(p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w)) END, 4) AS logistic,
             round(CASE WHEN count(*) OVER w < 2 OR max(p_retailprice) OVER w - min(p_retailprice) OVER w < 1e-12 THEN 0.5 ELSE (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) END, 4) AS scaled
           FROM {part} WINDOW w AS (PARTITION BY p_brand)""",
    ),
    "period_totals": (
        period_totals,
        f"""WITH {ATTRIBUTED}, pt AS (SELECT dev, {PERIOD_SQL} AS period, {SUMS}, count(DISTINCT CASE WHEN measure IN ('touched','prs_created','prs_merged','commits','reviewed') THEN date_trunc('week', ts) END) AS active_weeks FROM fact GROUP BY 1, 2),
            mv AS (SELECT d.dev, {PERIOD_SQL.replace("ts", "c.at").replace("sc.atrftime", "strftime")} AS period, count(DISTINCT c.issue_key) AS progressed FROM {{changelog}} c JOIN {{roster_dev}} d ON d.account = c.author WHERE c.to_status IN ('In Progress','Code Review','Ready QA','In QA') GROUP BY 1, 2)
            SELECT dev, period, touched, created, resolved, prs_created, prs_merged, loc, commits, reviewed, active_weeks, coalesce(progressed, 0) AS progressed FROM pt LEFT JOIN mv USING (dev, period)""",
    ),
    "elo_round_robin": (
        round_robin,
        f"""WITH s AS (SELECT 'e' || event_type AS league, {PERIOD_SQL} AS period, 'u' || CAST(user_id AS VARCHAR) AS dev, avg(value) AS score FROM {{events}} GROUP BY 1, 2, 3),
            k AS (SELECT *, stddev_pop(score) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY league, period)),
            m AS (SELECT a.league, a.period, a.dev, a.sd, a.score - b.score AS d FROM k a JOIN s b ON a.league = b.league AND a.period = b.period AND a.dev <> b.dev)
            SELECT league, period, dev, round(avg(CASE WHEN sd < 1e-12 OR abs(d) <= 0.75 * sd THEN 0.5 ELSE 1 / (1 + exp(-(sign(d) * (abs(d) - 0.75 * sd)) / (0.5 * sd))) END), 4) AS outcome FROM m GROUP BY 1, 2, 3
            UNION ALL SELECT league, period, dev, 0.5 FROM k WHERE n < 2""",
    ),
    "elo_history": (rating_history, None),
    "elo_attached": (rating_attached, None),
    "elo_period_scores": (
        lambda t: cohort_scores(t).select("period", "dev", r("score")),
        COHORT_SQL + " SELECT period, dev, round(score, 4)::DOUBLE AS score FROM pc",
    ),
    "elo_cohort_outcomes": (
        lambda t: _cohort_outcomes(t).select("period", "dev", r("outcome")),
        COHORT_SQL + """, pk AS (SELECT *, stddev_pop(score) OVER w AS sd, count(*) OVER w AS n FROM pc WINDOW w AS (PARTITION BY period)),
            pd AS (SELECT a.period, a.dev, a.sd, a.score - b.score AS d FROM pk a JOIN pc b ON a.period = b.period AND a.dev <> b.dev),
            po AS (SELECT period, dev, avg(CASE WHEN sd < 1e-12 OR abs(d) <= 0.75 * sd THEN 0.5 ELSE 1 / (1 + exp(-(sign(d) * (abs(d) - 0.75 * sd)) / (0.5 * sd))) END) AS outcome FROM pd GROUP BY 1, 2 UNION ALL SELECT period, dev, 0.5 FROM pk WHERE n < 2)
            SELECT period, account AS dev, round(outcome, 4)::DOUBLE AS outcome FROM po JOIN {roster_dev} USING (dev)""",
    ),
    "elo_cohort_history": (lambda t: cohort_history(t).select("league", "dev", "period", "kind", r("outcome"), r("delta"), r("rating"), n("periods_played"), n("idle_streak")), None),
    "elo_cohort_attached": (lambda t: elo.histories(cohort_history(t), F.lit("1998-01-01").cast("date")).select("league", "dev", F.size("history").cast("long").alias("periods"), F.round(F.element_at("history", -1)["rating"], D).alias("rating")), None),
    "dev_windows": (
        dev_windows,
        f"""WITH {ATTRIBUTED}, {UNKNOWN_SQL}, {COMPARED_SQL}, wt AS (SELECT dev, w, {SUMS}, {WEEKS} FROM al JOIN win ON ts >= a AND ts < b GROUP BY 1, 2),
            wp AS (SELECT d.dev, w, count(DISTINCT c.issue_key) AS progressed FROM {{changelog}} c JOIN {{roster_dev}} d ON d.account = c.author JOIN win ON c.at >= a AND c.at < b WHERE c.to_status IN ('In Progress','Code Review','Ready QA','In QA') GROUP BY 1, 2),
            wc AS (SELECT d.dev, w, count(DISTINCT i.issue_key) AS reported FROM {{issues}} i JOIN {{roster_dev}} d ON d.account = i.reporter JOIN win ON i.created >= a AND i.created < b GROUP BY 1, 2),
            wf AS (SELECT p.dev, w, count(DISTINCT f.path) AS unique_files FROM att_p p JOIN {{pr_files}} f USING (repo, pr_number) JOIN win ON p.merged >= a AND p.merged < b GROUP BY 1, 2)
            SELECT dev, w AS "window", {", ".join(TOTALS)}, active_weeks, coalesce(progressed, 0) AS progressed, coalesce(reported, 0) AS created, coalesce(unique_files, 0) AS unique_files FROM wt LEFT JOIN wp USING (dev, w) LEFT JOIN wc USING (dev, w) LEFT JOIN wf USING (dev, w)""",
    ),
    "impact_monthly": (
        lambda t: impact.monthly_impact(people.attribute_github(t("prs"), t("roster_login"), "author"), t("pr_files"), cal.month_key("merged"), Impact(dump_ceiling=40)).select("dev", "bucket", r("net_loc"), n("prs_merged"), n("unique_files"), r("code_impact")),
        f"""WITH x AS (SELECT repo, pr_number, sum(additions + deletions) AS ex FROM {{pr_files}} WHERE {NOISE} OR (({EXT} IN {DATA} OR {EXT} = 'xml') AND additions + deletions > 40) GROUP BY 1, 2),
            m AS (SELECT l.dev, strftime(merged, '%Y-%m') AS bucket, repo, pr_number, additions + deletions - coalesce(ex, 0) AS net FROM {{prs}} p JOIN {{roster_login}} l ON l.login = p.author LEFT JOIN x USING (repo, pr_number) WHERE merged IS NOT NULL),
            g AS (SELECT dev, bucket, greatest(sum(net), 0) AS net_loc, count(*) AS prs_merged FROM m GROUP BY 1, 2), u AS (SELECT dev, bucket, count(DISTINCT path) AS unique_files FROM m JOIN {{pr_files}} USING (repo, pr_number) GROUP BY 1, 2)
            SELECT dev, bucket, net_loc::DOUBLE AS net_loc, prs_merged, coalesce(unique_files, 0) AS unique_files, round(sqrt(coalesce(unique_files, 0) + 0.5 * net_loc + 2 * prs_merged), 4)::DOUBLE AS code_impact FROM g LEFT JOIN u USING (dev, bucket)""",
    ),
    "self_scope_issues": (
        lambda t: people.only_account(t("issues"), t("roster_dev"), "dev3").groupBy("status").agg(F.count("*").alias("n")),
        "SELECT status, count(*) AS n FROM {issues} WHERE 'acct3' IN (assignee, reporter) GROUP BY status",
    ),
    "in_months": (
        lambda t: t("orders").where(cal.in_months("o_orderdate", F.lit("1997-03-01").cast("date"), F.lit("1997-08-01").cast("date"))).groupBy(cal.month_key("o_orderdate").alias("month")).agg(F.count("*").alias("n")),
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-09-01' GROUP BY 1",
    ),
}


def _by(c: str):
    from pyspark.sql import Window

    return Window.partitionBy(c)
