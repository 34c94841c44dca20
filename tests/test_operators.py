"""Closed-form answers and invariants of single operators."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Elo, Impact
from tidemark.functions import calendar as cal
from tidemark.functions import text as tx
from tidemark.operators import audit, elo, epics, fields, flow, impact, integration, people, ranking, rollup, tickets
from tidemark.plans import registry
from tidemark.sources import corpus_files, decode


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("day", "label", "start"),
    [("2026-05-01", "2026-P17", "2026-04-20"), ("2024-12-24", "2024-P51", "2024-12-16"), ("2026-01-02", "2026-P01", "2025-12-29"), ("2024-05-10", "2024-P19", "2024-05-06")],
)
def test_periods(spark, day, label, start):
    d = F.lit(day).cast("timestamp")
    assert one(spark, cal.period_label(d)) == label
    assert str(one(spark, cal.period_start(d))) == start


def test_period_spine(spark):
    bounds = spark.sql("select timestamp'2024-05-06' as first, timestamp'2024-06-30' as last")
    spine = cal.period_spine(bounds)
    assert sorted(r.period for r in spine.collect()) == ["2024-P19", "2024-P21", "2024-P23", "2024-P25"]
    assert [r.period for r in cal.completed_periods(spine, F.lit("2024-05-25").cast("timestamp")).collect()] == ["2024-P19"]


def test_week_53_stands_alone(spark):
    d = F.lit("2020-12-30").cast("timestamp")
    assert one(spark, cal.period_label(d)) == "2020-P53"
    assert str(one(spark, cal.period_end(d))) == "2021-01-04"
    assert one(spark, cal.week_to_month(F.lit("2024-W09"))) == "2024-02"


def test_globs(spark):
    path = lambda p: F.lit(p)
    assert one(spark, tx.matches_generated(path("a/b/yarn.LOCK"), ("*.lock",)))
    assert one(spark, tx.matches_generated(path("x/vendor/y.go"), ("*/vendor/*",)))
    assert not one(spark, tx.matches_generated(path("a/b.go"), ("a*.go",)))
    assert one(spark, tx.first_glob(path("src/auth/x/y.go"), ("**/auth/**",))) == "**/auth/**"
    assert one(spark, tx.first_glob(path("src/authors/y.go"), ("auth",))) is None
    assert one(spark, tx.is_bot(F.lit("Renovate[bot]"))) and not one(spark, tx.is_bot(F.lit("renovater")))


def test_text(spark):
    assert one(spark, tx.issue_keys(F.lit("AB-1 fixes CD-22"), F.lit("AB-1 xAB-3"))) == ["AB-1", "CD-22"]
    assert one(spark, tx.family_stem(F.lit("m/001-init-abc.sql"), 4)) == "m/#-#-#.sql"
    assert one(spark, tx.slugify(F.lit("  Hello, World! "))) == "hello-world"
    assert str(one(spark, tx.parse_time(F.lit("2024-01-02T03:04:05.000+0200")))) == "2024-01-02 01:04:05"
    assert one(spark, tx.parse_time(F.lit("nonsense"))) is None
    assert one(spark, tx.migration_dir(F.lit("a/db/changelog/x/1.sql"))) == "a/db/changelog"


def test_churn_ramp(spark):
    got = [r.w for r in spark.range(5).select(impact.churn_weight(F.col("id"), Impact()).alias("w")).collect()]
    assert np.allclose(got, [0.5, 0.5, 2 / 3, 5 / 6, 1.0])


def test_spearman(spark):
    df = spark.createDataFrame([(1, 5, 5), (1, 4, 4), (1, 3, 2), (1, 2, 3), (1, 1, 1)], "p int, a int, b int")
    assert ranking.spearman(df, "a", "b", ["p"]).first().rho == pytest.approx(0.9)
    ties = spark.createDataFrame([(1, 3, 5), (1, 3, 4), (1, 1, 1)], "p int, a int, b int")
    assert ranking.spearman(ties, "a", "b", ["p"]).first().rho == pytest.approx(0.875)


def test_z_scores_flat_and_population(spark):
    df = spark.createDataFrame([("a", "m", 0.0), ("b", "m", 1.0), ("c", "m", 2.0), ("a", "k", 7.0), ("b", "k", 7.0)], "dev string, metric string, value double")
    got = {(r.dev, r.metric): r.z for r in ranking.z_scores(df, []).collect()}
    assert got["c", "m"] == pytest.approx(1 / math.sqrt(2 / 3)) and got["a", "k"] == 0


def test_name_match(spark):
    score = lambda a, b: one(spark, people.match_score(F.lit(a), F.lit(b)))
    assert score("jsmith", "Jane Smith") == 95 and score("jane-smith", "Jane Smith") == 100 and score("zzz", "Jane Smith") == 0


def test_candidates_equal_brute_force(spark):
    rng = random.Random(1)
    parts = ["jo", "li", "x", "jane", "smith", "smithson", "000", "000000001", "al", "ann"]
    word = lambda sep, n: sep.join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    logins = [("jo",), ("JSmith",), ("smithj",), ("",), (None,), ("--",), ("jo",)] + [(word(rng.choice(["", "-", "."]), 3),) for _ in range(80)]
    names = [(f"c{i}", n) for i, n in enumerate(["Jo Li", "Jane Smith", "", None, "J. Smith", "jane  smith", "Jane Smith"])] + [(f"d{i}", word(" ", 4)) for i in range(120)]
    a, b = spark.createDataFrame(logins, "login string").distinct(), spark.createDataFrame(names, "account string, name string")
    want = collections.defaultdict(list)
    for r in a.crossJoin(b).withColumn("s", people.match_score(F.col("login"), F.col("name"))).where("s >= 40").collect():
        want[r.login].append((-r.s, r.account))
    got = collections.defaultdict(list)
    for r in people.candidates(spark.createDataFrame(logins, "login string"), b).orderBy("login", "rank").collect():
        got[r.login].append((-r.score, r.account))
    assert got == {k: sorted(v)[:3] for k, v in want.items()} and (-75.0, "c0") in want["jo"]


def test_identity_candidates_take_every_customer(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["identity_candidates"](spark, sf).where("rank = 1 AND score = 95").collect()
    assert len({r.account for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/customer.parquet").count()


CHANGES = "issue_key string, at timestamp, ord int, author string, from_status string, to_status string"


def test_status_durations(spark):
    rows = [("K", f"2026-01-0{d} {h:02d}:00:00", i, "x", a, b) for i, (d, h, a, b) in enumerate([(1, 0, "To Do", "In Progress"), (2, 12, "In Progress", "Ready QA"), (3, 0, "Ready QA", "In QA")])]
    changelog = spark.createDataFrame(rows, "issue_key string, a string, ord int, author string, from_status string, to_status string").withColumn("at", F.col("a").cast("timestamp"))
    issues = spark.createDataFrame([("K", "2026-01-04 00:00:00")], "issue_key string, r string").withColumn("resolved", F.col("r").cast("timestamp"))
    got = {r.status: r.hours for r in flow.status_durations(changelog, issues).collect()}
    assert got == {"In Progress": 36.0, "Ready QA": 12.0, "In QA": 24.0}


def test_threads_pointer_jumping(spark):
    chain = [("r", 1, i, i - 1 if i > 1 else 0) for i in range(1, 41)] + [("r", 1, 99, 0)]
    got = flow.deep_threads(spark.createDataFrame(chain, "repo string, pr_number long, id long, in_reply_to long")).first()
    assert (got.inline, got.deep) == (41, 1)


def test_threads_of_any_depth(spark):
    chain = [("r", 1, i, i - 1 if i > 1 else 0) for i in range(1, 301)] + [("r", 2, 7, 6), ("r", 2, 8, 7), ("r", 2, 6, 8)]
    got = {r.pr_number: (r.inline, r.deep) for r in flow.deep_threads(spark.createDataFrame(chain, "repo string, pr_number long, id long, in_reply_to long")).collect()}
    assert got[1] == (300, 1) and got[2][0] == 3


def test_a_thread_of_a_hundred_thousand_replies_ends(spark):
    rows = spark.range(1, 100_001).select(F.lit("r").alias("repo"), F.lit(1).cast("long").alias("pr_number"), "id", (F.col("id") - 1).alias("in_reply_to"))
    few = rows.where("id <= 4")
    sizes = [len(flow.deep_threads(x)._jdf.queryExecution().optimizedPlan().toString()) for x in (few, rows)]
    assert abs(sizes[0] - sizes[1]) < 200  # the plan does not grow with the thread
    assert tuple(flow.deep_threads(rows.unionByName(few.withColumn("id", F.col("id") + 200_000).withColumn("in_reply_to", F.lit(0).cast("long")))).first())[2:] == (100_004, 1)


def test_ticket_flow_in_one_pass(spark):
    moves = [("K", 1, 0, "To Do", "In Progress"), (("K"), 10, 1, "In Progress", "In QA"), ("K", 20, 2, "In QA", "In Progress"), ("K", 21, 3, "In Progress", "Code Review"), ("K", 22, 4, "Code Review", "In Progress"), ("K", 30, 5, "In Progress", "In QA")]
    at = lambda h: F.timestamp_seconds(F.col(h) * 3600)
    changelog = spark.createDataFrame(moves, "issue_key string, h long, ord int, from_status string, to_status string").withColumn("at", at("h"))
    commits = spark.createDataFrame([("K", 20), ("K", 22), ("Z", 5), ("", 6), (None, 7)], "issue_key string, h long").withColumn("committed", at("h"))
    comments = spark.createDataFrame([("K", 0), ("K", 1), ("K", 9)], "issue_key string, h long").withColumn("at", at("h"))
    issues = spark.createDataFrame([("K", 40)], "issue_key string, h long").withColumn("resolved", at("h"))
    got = flow.ticket_flow(changelog, commits, issues, comments).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.active_hours, r.cycle_hours, r.status_flips, r.rework, r.pre_code_comments) == (9 + 1 + 1 + 8, 39.0, 3, 2, 1)


def test_aliases_are_unique(spark):
    existing = spark.createDataFrame([("x", "Person 3"), ("y", "Someone")], "name string, alias string")
    names = spark.createDataFrame([(f"n{i}",) for i in range(600)] + [("x",), ("",), ("unknown",)], "name string")
    got = {r.name: r.alias for r in people.mint_aliases(names, existing).collect()}
    assert got["x"] == "Person 3" and len(got) == 602 and len(set(got.values())) == 602 and "" not in got
    words = {r.name: r.alias for r in people.mint_aliases(names, existing, pools=(["A", "B", "C"], ["D", "E"])).collect()}
    assert len(set(words.values())) == 602 and "A D" not in words.values() and words["x"] == "Person 3"


def test_comparison_windows():
    from datetime import date

    assert cal.comparison_windows(date(2000, 7, 1), date(2000, 12, 1)) == [
        ("current", "2000-07-01", "2001-01-01"), ("prior", "2000-01-01", "2000-07-01"), ("yoy", "1999-07-01", "2000-01-01"), ("qoq", "2000-04-01", "2000-10-01"),
        ("2000-Q4", "2000-10-01", "2001-01-01"), ("2000-Q3", "2000-07-01", "2000-10-01"), ("2000-Q2", "2000-04-01", "2000-07-01"), ("2000-Q1", "2000-01-01", "2000-04-01"),
    ]


def test_period_close(spark):
    rows = spark.createDataFrame([("2024-P01",), ("2020-P53",), ("2020-P51",)], "period string").select(F.date_format(cal.period_close("period"), "yyyy-MM-dd").alias("d")).collect()
    assert [r.d for r in rows] == ["2024-01-15", "2021-01-04", "2020-12-28"]


def test_only_completed_periods_count(spark):
    rows = spark.createDataFrame([("l", p, d, s) for p in ("2024-P01", "2024-P03", "2024-P05") for d, s in (("a", 0.8), ("b", 0.2))], "league string, period string, dev string, outcome double")
    got = elo.advance(rows, None, None, now=F.lit("2024-02-01"), first_period="2024-P03").toPandas()
    assert set(got["period"]) == {"2024-P03"}


def _walk_pairwise(outcomes):
    """The recurrence by loops over pairs: {(period, dev): (kind, rating)}."""
    rating, played, idle, out = {}, {}, {}, {}
    for period in sorted({p for p, _, _ in outcomes}):
        now = {d: o for p, d, o in outcomes if p == period}
        before = {d: rating.get(d, 1000.0) for d in now}
        raw = {}
        for d, o in now.items():
            odds = [1 / (1 + 10 ** ((before[x] - before[d]) / 400)) for x in now if x != d]
            n = played.get(d, 0)
            k = 32.0 if n < 4 else 28.0 if n < 17 else 30.0
            raw[d] = k * (o - (sum(odds) / len(odds) if odds else 0.5))
        delta = {d: x * 0.5 if x < 0 and played.get(d, 0) < 12 else x for d, x in raw.items()}
        given, gained = sum(delta[d] - raw[d] for d in raw), sum(x for x in raw.values() if x > 0)
        if given > 0 and gained > 0:
            delta = {d: x - given * x / gained if x > 0 else delta[d] for d, x in raw.items()}
        mean = sum(before.values()) / len(before)
        for d in list(rating):
            if d not in now:
                idle[d] += 1
                if idle[d] > 3:
                    step = max(-8.0, min(8.0, mean - rating[d]))
                    rating[d] += step
                    if step:
                        out[period, d] = ("decay", rating[d])
        for d, x in delta.items():
            rating[d], played[d], idle[d] = before[d] + x, played.get(d, 0) + 1, 0
            out[period, d] = ("played", rating[d])
    return out


def test_walk_against_loops_over_pairs(spark):
    rng = __import__("random").Random(3)
    rows = [(f"2024-P{2 * p + 1:02d}", f"d{d}", rng.random()) for p in range(20) for d in range(8) if rng.random() < (0.3 if d < 3 else 0.9)]
    want = _walk_pairwise(rows)
    df = spark.createDataFrame(rows, "period string, dev string, outcome double").withColumn("league", F.lit("l"))
    got = {(r.period, r.dev): (r.kind, r.rating) for r in elo.rating_walk(df).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_rich_text_of_any_depth():
    deep = '{"type":"text","text":"x"}'
    for _ in range(400):
        deep = '{"type":"paragraph","content":[' + deep + "]}"
    marked = '{"type":"doc","content":[{"type":"text","text":"see","marks":[{"type":"link","attrs":null},{"type":"link","attrs":{"href":"http://a.b"}}]},{"type":"hardBreak"},{"type":"emoji","attrs":{"shortName":":x:"}}]}'
    assert decode.plain_text(deep)[0] == "x" and decode.plain_text(marked) == ("see\n:x:", ["http://a.b"])
    assert decode.plain_text("{") == ("", []) and decode.plain_text("[" * 200_000) == ("", []) and decode.plain_text(None) == ("", [])


def test_attachments_and_versions(spark):
    raw = spark.createDataFrame([('{"key":"A-1","fields":{"attachment":[{"filename":"f","mimeType":"m","size":3}],"fixVersions":[{"name":"v1"},{"name":"v2"}]}}',), ('{"key":"A-2","fields":{}}',)], "raw string")
    assert [tuple(r) for r in decode.decode_attachments(raw).collect()] == [("A-1", 0, "f", "m", 3)]
    assert {r.issue_key: r.fix_versions for r in decode.fix_versions(raw).collect()} == {"A-1": ["v1", "v2"], "A-2": []}


def test_import_and_export(spark, tmp_path):
    import json
    import os

    for scope, month, rows in (("P", "2024-01", [{"key": "A", "links": [{"k": 1}, {"k": 2}]}, {"key": "B", "links": None}]), ("P", "2024-02", [])):
        os.makedirs(f"{tmp_path}/in/issues/{scope}", exist_ok=True)
        with open(f"{tmp_path}/in/issues/{scope}/{month}.json", "w") as f:
            json.dump(rows, f)
    sources = {"issues": ("key string, links array<struct<k:int>>", ("key",), ("links",))}
    for _ in range(2):
        tallies = corpus_files.json_to_columnar(spark, f"{tmp_path}/in", f"{tmp_path}/out", sources)
        assert [tuple(r) for r in tallies.collect()] == [("issues", "P", "2024-01", 2)]
        assert sorted((r.key, r.ord, r.k) for r in spark.read.parquet(f"{tmp_path}/out/issues_links").collect()) == [("A", 0, 1), ("A", 1, 2)]
    corpus_files.export_scores(spark.createDataFrame([("B", 2), ("A", 1)], "ticket string, points int"), f"{tmp_path}/scores")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/scores").select("ticket", "points").orderBy("ticket").collect()] == [("A", 1), ("B", 2)]


def test_upsert_by_scorer_fills_dates(spark):
    old = spark.createDataFrame([("A", "me", 3, "auto", "h", True, None), ("A", "you", 5, "human", "g", False, "d0")], "ticket string, scorer string, points int, source string, hash string, posted boolean, resolved string")
    new = spark.createDataFrame([("A", "me", 8, "h", "d1"), ("A", "you", 8, "x", "d2"), ("B", "me", 1, "k", "d3")], "ticket string, scorer string, points int, hash string, resolved string")
    got = {(r.ticket, r.scorer): (r.points, r.outcome, r.posted, r.resolved) for r in tickets.upsert(old, new, ("ticket", "scorer"), ("resolved",)).collect()}
    assert got == {("A", "me"): (3, "skipped", True, "d1"), ("A", "you"): (5, "preserved", False, "d0"), ("B", "me"): (1, "inserted", False, "d3")}


def test_reship(spark):
    prs = spark.createDataFrame([("r", 1, "2024-01-01"), ("r", 2, "2024-01-02"), ("q", 3, "2024-01-03")], "repo string, pr_number long, merged string")
    commits = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "a"), ("r", 2, "b"), ("q", 3, "a")], "repo string, pr_number long, sha string")
    assert {r.pr_number: r.reship for r in integration.reship(prs, commits).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def _outcomes(n_periods=3, n=4, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for p in range(n_periods):
        s = r.random(n)
        rows += [(f"2024-P{2 * p + 1:02d}", f"d{i}", float(x)) for i, x in enumerate(s + 0.5 - s.mean())]
    return pd.DataFrame(rows, columns=["period", "dev", "outcome"])


EMPTY = pd.DataFrame({"dev": [], "rating": [], "periods_played": [], "idle_streak": []})


def test_elo_is_zero_sum():
    got = elo.walk(_outcomes(), EMPTY)
    assert abs(got.groupby("period")["delta"].sum()).max() < 1e-9


def test_elo_solo_draws_and_idle_decays():
    solo = pd.DataFrame([("2024-P01", "a", 0.5)], columns=["period", "dev", "outcome"])
    assert elo.walk(solo, EMPTY)["delta"].tolist() == [0.0]
    state = pd.DataFrame([("z", 1200.0, 5, 3)], columns=["dev", "rating", "periods_played", "idle_streak"])
    got = elo.walk(_outcomes(1), state)
    decay = got[got.kind == "decay"]
    assert decay["delta"].tolist() == [-Elo().idle_step] and decay["idle_streak"].tolist() == [4]


def test_elo_resumed_equals_whole(spark):
    rows = spark.createDataFrame(_outcomes(4).assign(league="l"))
    whole = elo.rating_walk(rows).toPandas()
    first = elo.rating_fold(rows.where("period <= '2024-P03'"))
    more = elo.advance(rows, elo.state_of(first), "2024-P03").toPandas()
    both = pd.concat([first.where("kind <> 'state'").toPandas(), more]).sort_values(["period", "dev"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(both, whole.sort_values(["period", "dev"]).reset_index(drop=True))


def _with_idlers(n_periods=9):
    """Outcomes in which people come, pause for one to six periods and come back."""
    away = {"a": set(range(1, 7)), "b": {2, 3}, "c": {4}, "d": set(range(3, n_periods)), "e": set()}
    rows = [(f"2024-P{2 * p + 1:02d}", d, 0.2 + 0.1 * ((p * 7 + ord(d)) % 7)) for p in range(n_periods) for d in "abcde" if p not in away[d]]
    return pd.DataFrame(rows, columns=["period", "dev", "outcome"])


def test_elo_every_split_equals_the_whole():
    rows = _with_idlers()
    periods = sorted(set(rows.period))
    whole = elo.walk(rows, EMPTY, hand_on=True)
    assert (whole.kind == "decay").sum() > 3

    def parts(cuts):
        state, out = EMPTY, []
        for lo, hi in zip([0, *cuts], [*cuts, len(periods)]):
            got = elo.walk(rows[rows.period.isin(periods[lo:hi])], state, hand_on=True)
            state = got[got.kind == "state"][EMPTY.columns]
            out.append(got[got.kind != "state"])
        return pd.concat([*out, got[got.kind == "state"]]).reset_index(drop=True)

    for cuts in [(c,) for c in range(1, len(periods))] + [tuple(range(1, len(periods)))]:
        pd.testing.assert_frame_equal(parts(cuts), whole, check_dtype=False)


def test_elo_by_runs_of_periods_equals_the_whole(spark):
    rows = spark.createDataFrame(pd.concat([_with_idlers().assign(league="l"), _outcomes(4).assign(league="m")]))
    assert [len(elo.spans(rows, n)) for n in (1, 10, 1000)] == [9, 4, 1]
    order = ["league", "kind", "period", "dev"]
    want = elo.rating_fold(rows).toPandas().sort_values(order).reset_index(drop=True)
    for n in (1, 10):
        pd.testing.assert_frame_equal(elo.rating_fold(rows, at_once=n).toPandas().sort_values(order).reset_index(drop=True), want)
    later = elo.advance_fold(rows, elo.state_of(elo.rating_fold(rows.where("period <= '2024-P05'"))), "2024-P05")
    state = lambda df: sorted(tuple(r) for r in elo.state_of(df).collect())
    assert state(later) == state(elo.rating_fold(rows))


def test_expectations_do_not_hang_on_the_block():
    r = np.random.default_rng(3).normal(1000, 200, 57)
    odds = 1 / (1 + 10 ** ((r[None, :] - r[:, None]) / 400))
    want = [(odds[i].sum() - 0.5) / 56 for i in range(57)]
    for block in (1, 10, 57, None):
        np.testing.assert_allclose(elo.expectations(r, block), want, rtol=1e-12)


def test_momentum_hot(spark):
    weeks = spark.createDataFrame([("E", 100, 0, 0.0, 2, 500, 0), ("E", 99, 0, 0.0, 1, 100, 0), ("E", 95, 0, 0.0, 3, 150, 0)], "epic_key string, week long, issues long, story_points double, prs long, loc long, commits long")
    got = epics.momentum(weeks).first()
    assert got.momentum == 4.0 and got.state == "hot" and got.recent == 3 and got.peak_week == 95


def test_snap(spark):
    def points(x):
        rows = spark.range(1).select(F.lit(x).cast("double").alias("raw"))
        return tickets.snap(rows, (1, 2, 3, 5, 8, 13), 0.15).select("points", "band", "straddles").first()

    assert tuple(points(0.2)) == (1, "1", False)
    assert tuple(points(4.0)) == (5, "3–5", True)
    assert tuple(points(3.2)) == (3, "3", False)
    assert tuple(points(20.0)) == (13, "13", False)
    assert [tuple(points(x)) for x in (-2.0, 1.0, 13.0, None)] == [(1, "1", False), (1, "1", False), (13, "13", False), (1, "1", False)]


def test_upsert_twice_is_a_no_op(spark):
    new = spark.createDataFrame([("A", 3, "h1"), ("B", 5, "h2")], "ticket string, points int, hash string")
    empty = spark.createDataFrame([], "ticket string, points int, source string, hash string, posted boolean")
    first = tickets.upsert(empty, new)
    assert {r.outcome for r in first.collect()} == {"inserted"}
    assert {r.outcome for r in tickets.upsert(first, new).collect()} == {"skipped"}
    human = first.withColumn("source", F.lit("human"))
    changed = new.withColumn("hash", F.lit("x")).withColumn("points", F.lit(13))
    assert {(r.ticket, r.points, r.outcome) for r in tickets.upsert(human, changed).collect()} == {("A", 3, "preserved"), ("B", 5, "preserved")}


def test_expectations(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("z", 2)], "k string, v int")
    diff = audit.diff_snapshots(a, b, "k", "v")
    assert {r.k: r.change for r in diff.collect()} == {"x": "moved", "y": "dropped", "z": "new"}
    wanted = spark.createDataFrame([("x", "up"), ("y", "up")], "k string, direction string")
    assert {r.k: r.passed for r in audit.check_expectations(diff, wanted, "k").collect()} == {"x": True, "y": False}


def test_code_impact(spark):
    assert one(spark, rollup.code_impact(F.lit(4.0), F.lit(10.0), F.lit(1.0))) == pytest.approx(math.sqrt(11))
    assert one(spark, rollup.code_impact(F.lit(0.0), F.lit(-3.0), F.lit(0.0))) == 0


def test_rich_text():
    tree = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"see https://a.b/c."},{"type":"hardBreak"},{"type":"mention","attrs":{"text":"@me"}}]},{"type":"inlineCard","attrs":{"url":"https://x.y"}}]}'
    assert decode.plain_text(tree) == ("see https://a.b/c.\n@me\nhttps://x.y", ["https://a.b/c", "https://x.y"])
    assert decode.plain_text("{bad") == ("", []) and decode.plain_text(None) == ("", [])


def test_cells_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("P", "2024-01", "a"), ("P", "2024-02", "b"), ("Q", "2024-01", "c")], "scope string, month string, k string")
    corpus_files.write_cells(rows, f"{tmp_path}/c")
    corpus_files.write_cells(spark.createDataFrame([("P", "2024-01", "z")], "scope string, month string, k string"), f"{tmp_path}/c")
    assert sorted(r.k for r in corpus_files.load_corpus(spark, f"{tmp_path}/c", "2024-01", "2024-02").collect()) == ["b", "c", "z"]
    with pytest.raises(ValueError):
        corpus_files.load_corpus(spark, f"{tmp_path}/c", "2024-02", "2024-01")


def test_json_corpus(spark, tmp_path):
    cell = tmp_path / "issues" / "P"
    cell.mkdir(parents=True)
    (cell / "2024-01.json").write_text('[{"key":"A-1","labels":["x"]},{"key":"A-2","labels":null}]')
    got = corpus_files.read_corpus_json(spark, str(tmp_path), "issues", "key string, labels array<string>")
    assert {(r.key, r.scope, r.month) for r in got.collect()} == {("A-1", "P", "2024-01"), ("A-2", "P", "2024-01")}
    corpus_files.write_results(got, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_merged_only_pull_requests_count(spark):
    outcomes = elo.active_cohort(spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 0, 0, 1, 0)], "dev string, prs_created int, prs_merged int, reviewed int, commits int"))
    assert [r.dev for r in outcomes.collect()] == ["b"]


def test_field_mappings_and_their_fallbacks(spark):
    found = spark.createDataFrame([("a", 10, 4), ("b", 10, 9), ("d", 10, 2), ("e", 10, 7)], "field_id string, sampled long, populated long")
    catalog = spark.createDataFrame([("a", "Story Points", 1), ("b", "story point estimate", 2), ("d", "Description", 3), ("e", "Release description", 4), ("k", " Epic Link", 5)], "field_id string, name string, ord int")
    settable = spark.createDataFrame([("a", "Story Points", 3), ("b", "story point estimate", 8), ("e", "Release description", 9)], "field_id string, name string, n long")
    got = lambda c, s, f=found: {r.role: (r.field_id, r.populated, r.settable, r.warning) for r in fields.mappings(f, c, s).collect()}
    assert got(catalog, settable) == {"story_points": ("b", 9, 8, False), "epic_link": ("k", 0, 0, False), "description": ("e", 7, 9, False)}
    assert got(catalog, settable.where("n > 100")) == {"story_points": ("a", 4, 0, True), "epic_link": ("k", 0, 0, False), "description": ("e", 7, 0, False)}
    few = catalog.where("field_id = 'd'")
    assert got(few, settable.where("n > 100"), found.where("field_id = 'a'")) == {"epic_link": ("parent", 0, 0, False), "description": ("d", 0, 0, False)}
    assert got(catalog.where("ord > 9"), settable.where("n > 100")) == {"epic_link": ("parent", 0, 0, False)}


def test_sketches_merge_over_windows(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("d"), F.col("id") % 2).alias("dev"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id % 90)").alias("ts"), F.when(F.col("id") % 2 == 0, F.col("id") % 20_011).otherwise(F.col("id") % 37).cast("string").alias("path"))
    windows = cal.windows_frame(spark, [("all", "2024-01-01", "2025-01-01"), ("march", "2024-03-01", "2024-04-01"), ("none", "2030-01-01", "2031-01-01")])
    exact = {(r.dev, r.window): r.n for r in rollup.keys_in_windows(rows, "ts", "path", windows, "n").collect()}
    sketches = rollup.daily_sketches(rows, "ts", "path")
    got = {(r.dev, r.window): r.n for r in rollup.sketched_in_windows(sketches, windows, "n").collect()}
    assert set(got) == set(exact) and len(got) == 4
    assert all(abs(got[k] - exact[k]) <= max(0.05 * exact[k], 0) for k in exact)  # three standard errors
    assert got[("d1", "all")] == exact[("d1", "all")] == 37  # small sets are exact


def test_pair_sums_by_cells():
    g = np.random.default_rng(5)
    for score in (g.normal(size=700), g.integers(0, 9, 700).astype(float), g.standard_cauchy(700), np.r_[np.zeros(300), 1.0], np.array([1.0, 2.0])):
        d, sd, n = score[:, None] - score[None, :], score.std(), len(score)
        beyond = np.clip(np.sign(d) * (np.abs(d) - 0.75 * sd) / (0.5 * sd), -700, 700)
        want = (np.where(np.abs(d) <= 0.75 * sd, 0.5, 1 / (1 + np.exp(-beyond))).sum(axis=1) - 0.5) / (n - 1)
        for block in (7, None):
            np.testing.assert_allclose(elo.outcomes(score, block=block), want, atol=1e-12)
        r = 1000 + 100 * score
        odds = 1 / (1 + 10 ** np.clip((r[None, :] - r[:, None]) / 400, -300, 300))
        np.testing.assert_allclose(elo.expectations(r), (odds.sum(axis=1) - 0.5) / (n - 1), atol=1e-12)


def test_ratings_of_many_people_end():
    """A period of 200,000 people has 4e10 pairs."""
    score = np.random.default_rng(6).normal(size=200_000)
    assert abs(elo.outcomes(score).mean() - 0.5) < 1e-9
    rows = pd.DataFrame({"period": "2024-P01", "dev": [f"d{i:06d}" for i in range(len(score))], "outcome": elo.outcomes(score)})
    got = elo.walk(rows, EMPTY, hand_on=True)
    assert len(got) == 2 * len(score) and abs(got[got.kind == "played"].delta.sum()) < 1e-3
