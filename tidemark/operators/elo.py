"""Round-robin ratings over periods: outcomes per period, the recurrence in one grouped helper per league.

Only the recurrence is sequential, and leagues run apart; its input has one row per person and
period.  Sums over all pairs are taken from the sorted values by cells (``_logistic_below``), not pair
by pair; each period is done with vectors, long histories in runs of periods with the state in a table
between them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Elo
from tidemark.functions.calendar import period_close
from tidemark.operators import ranking
from tidemark.sources.staging import staged

#: Rows of one league that a task takes at once, values of which sums are taken at once, and the kind of rows that hand on the state.
AT_ONCE, BLOCK, STATE = 1 << 21, 1 << 16, "state"
#: Nodes of a cell (an interpolation of tanh(x / 2) by 14 of them over a width of 1 is exact to 1e-15), how many cells away
#: tanh(x / 2) is 1 in doubles, the nodes and the matrix from Chebyshev polynomials to weights of nodes.
NODES, FAR = 14, 40
_COS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_AT = (_COS + 1) / 2
_TO_NODES = chebvander(_COS, NODES - 1).T * np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] / NODES
HISTORY = "league string, dev string, period string, kind string, outcome double, delta double, rating double, periods_played long, idle_streak long"


def dev_keys(roster: DataFrame, logins: DataFrame) -> DataFrame:
    """(dev, dev_key): the account, else the first login with a mark; those with neither drop out."""
    first = logins.groupBy("dev").agg(F.min("login").alias("_login"))
    key = F.coalesce(F.nullif(F.col("account"), F.lit("")), F.concat(F.lit("gh:"), "_login"))
    return roster.select("dev", "account").join(first, "dev", "left").select("dev", key.alias("dev_key")).where("dev_key IS NOT NULL")


def period_scores(periods: DataFrame) -> DataFrame:
    """(period, dev, score): composites of the active people of each period; files, impact and points play no part here."""
    none = {c: F.lit(0.0) for c in ("unique_files", "code_impact", "story_points", "scored")}
    rows = staged(active_cohort(periods), "periods").withColumns({**none, "multiplier": F.lit(1.0)})
    return ranking.scores(ranking.metrics(rows, ["period"]), ["period"])


def active_cohort(periods: DataFrame) -> DataFrame:
    """Only code-side activity makes a person play."""
    return periods.where(F.col("prs_created") + F.col("prs_merged") + F.col("reviewed") + F.col("commits") > 0)


def _spread(x: np.ndarray) -> np.ndarray:
    """The weight of each node for each place within a cell: what a value counts for at the nodes, or is read from them by."""
    return chebvander(2 * x - 1, NODES - 1) @ _TO_NODES


def _logistic_below(at: np.ndarray, values: np.ndarray, scale: float, block: int | None = None) -> np.ndarray:
    """For each of ``at`` the sum over the values v below it of 1 / (1 + exp(-(at - v) / scale)) - 1/2, to rounding.

    The values are sorted into cells as wide as ``scale`` and stand at the nodes of theirs by weights.  Of the cell that ``at``
    lies in, running sums of weights give those below it; of the cells further down, the sums at the nodes of its cell, which
    ``at`` is read from; those ``FAR`` cells down count a half each.  Work and memory are in proportion to the values."""
    values = np.sort(values)
    place = (values - values[0]) / scale
    cell = np.floor(place).astype(np.int64)
    upto = np.zeros((len(values) + 1, NODES))
    for lo in range(0, len(values), BLOCK):
        upto[lo + 1 : lo + BLOCK + 1] = _spread((place - cell)[lo : lo + BLOCK])
    np.cumsum(upto, axis=0, out=upto)
    cells, first = np.unique(cell, return_index=True)
    held = np.diff(upto[np.append(first, len(values))], axis=0)
    to = (at - values[0]) / scale
    own = np.floor(to).astype(np.int64)
    asked, inverse = np.unique(own, return_inverse=True)
    below = np.full((len(asked), NODES), 0.5) * np.searchsorted(cell, asked - FAR)[:, None]
    for k in range(1, FAR + 1):
        found = np.minimum(np.searchsorted(cells, asked - k), len(cells) - 1)
        hit = cells[found] == asked - k
        below[hit] += held[found[hit]] @ np.tanh((k + _AT[None, :] - _AT[:, None]) / 2) / 2
    out, block = np.empty(len(at)), block or BLOCK
    for lo in range(0, len(at), block):
        part = slice(lo, lo + block)
        x = to[part] - own[part]
        near = upto[np.searchsorted(values, at[part])] - upto[np.searchsorted(cell, own[part])]
        out[part] = (near * np.tanh((x[:, None] - _AT) / 2) / 2).sum(axis=1) + (_spread(x) * below[inverse[part]]).sum(axis=1)
    return out


def outcomes(score: np.ndarray, knobs: Elo = Elo(), block: int | None = None) -> np.ndarray:
    """Each one's mean result against all others: near scores draw.  No pair is formed."""
    n, sd = len(score), float(score.std())
    if n < 2 or sd < 1e-12:
        return np.full(n, 0.5)
    if not np.isfinite(sd):
        return np.full(n, np.nan)
    zone, scale = knobs.deadzone * sd, knobs.scale * sd
    won = _logistic_below(score - zone, score, scale, block) - _logistic_below(-score - zone, -score, scale, block)
    return 0.5 + won / (n - 1)  # a draw with everyone, and what is above it; oneself lies in the zone


def round_robin(scores: DataFrame, knobs: Elo = Elo()) -> DataFrame:
    """(league, period, dev, outcome) of everyone's mean result in a period.

    A period's scores are one vector per league; no pair becomes a row or a cell of a matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["league", "period", "dev"]].assign(outcome=outcomes(pdf["score"].to_numpy(dtype=float), knobs))

    return scores.select("league", "period", "dev", "score").groupBy("league", "period").applyInPandas(one, "league string, period string, dev string, outcome double")


def k_factor(played: np.ndarray, knobs: Elo) -> np.ndarray:
    starts = np.array([t for t, _ in knobs.tiers])
    ks = np.array([k for _, k in knobs.tiers])
    at = np.searchsorted(starts, played, side="right") - 1
    return np.where(at >= 0, ks[np.maximum(at, 0)], knobs.fallback_k)


def expectations(ratings: np.ndarray, block: int | None = None) -> np.ndarray:
    """Each one's mean expected result against all others; alone, a draw."""
    n, scale = len(ratings), 400 / np.log(10)
    if n < 2:
        return np.full(n, 0.5)
    if not np.isfinite(ratings).all():
        return np.full(n, np.nan)
    return 0.5 + (_logistic_below(ratings, ratings, scale, block) - _logistic_below(-ratings, -ratings, scale, block)) / (n - 1)


def walk(outcomes: pd.DataFrame, state: pd.DataFrame, knobs: Elo = Elo(), hand_on: bool = False) -> pd.DataFrame:
    """One league's history from its outcomes (period, dev, outcome) and its people's state (dev, rating, periods_played, idle_streak).

    With ``hand_on``, the state of everyone known follows as rows of kind ``state``: a streak too short to decay has no row of
    history, so the last of those rows don't tell it."""
    people = pd.Index(sorted({*state["dev"], *outcomes["dev"]}), dtype=object)
    rating, played, streak = np.full(len(people), float(knobs.start)), np.zeros(len(people), dtype=np.int64), np.zeros(len(people), dtype=np.int64)
    known = people.get_indexer(state["dev"])
    rating[known], played[known], streak[known] = state["rating"].astype(float), state["periods_played"].astype(np.int64), state["idle_streak"].astype(np.int64)
    parts = []

    def add(kind: str, period: str | None, who: np.ndarray, outcome, delta) -> None:
        cols = {"_at": who, "period": period, "kind": kind, "outcome": outcome, "delta": delta, "rating": rating[who], "periods_played": played[who], "idle_streak": streak[who]}
        parts.append(pd.DataFrame(cols, index=range(len(who))))

    for period, group in outcomes.sort_values(["period", "dev"]).groupby("period", sort=True):
        who, s = people.get_indexer(group["dev"]), group["outcome"].to_numpy(dtype=float)
        r = rating[who]
        raw = k_factor(played[who], knobs) * (s - expectations(r))
        soft = (played[who] < knobs.provisional) & (raw < 0)
        delta = np.where(soft, raw * knobs.provisional_loss, raw)
        forgiven, gained = (delta - raw).sum(), raw[raw > 0].sum()
        if gained > 0 and forgiven > 0:
            delta = np.where(raw > 0, raw - forgiven * raw / gained, delta)
        rating[who], played[who], streak[who] = r + delta, played[who] + 1, 0
        add("played", period, who, s, delta)
        away = played > 0
        away[who] = False
        streak[away] += 1
        step = np.where(away & (streak > knobs.idle_after), np.clip(r.mean() - rating, -knobs.idle_step, knobs.idle_step), 0.0)
        rating += step
        moved = np.flatnonzero(step)
        if len(moved):
            add("decay", period, moved, np.nan, step[moved])
    if hand_on:
        add(STATE, None, np.arange(len(people)), np.nan, 0.0)
    columns = ["dev", "period", "kind", "outcome", "delta", "rating", "periods_played", "idle_streak"]
    if not parts:
        return pd.DataFrame([], columns=columns)
    rows = pd.concat(parts, ignore_index=True)
    rows["dev"] = people.take(rows.pop("_at"))
    return rows[columns]


def _fold(outcomes: DataFrame, state: DataFrame | None, knobs: Elo) -> DataFrame:
    names = [c.split()[0] for c in HISTORY.split(", ")]
    empty = pd.DataFrame({"dev": [], "rating": [], "periods_played": [], "idle_streak": []})

    def one(key, left, right=empty) -> pd.DataFrame:
        out = walk(left, right, knobs, hand_on=True)
        out.insert(0, "league", key[0])
        return out[names]

    if state is None:
        return outcomes.groupBy("league").applyInPandas(lambda key, pdf: one(key, pdf), HISTORY)
    fresh = state.toDF(*state.columns)  # it may come from the same table as the outcomes
    return outcomes.groupBy("league").cogroup(fresh.groupBy("league")).applyInPandas(one, HISTORY)


def spans(outcomes: DataFrame, at_once: int = AT_ONCE) -> list[tuple[str, str]]:
    """Runs of periods, first and last, in which no league has more than ``at_once`` rows, or of one period."""
    sizes = outcomes.groupBy("league", "period").agg(F.count("*").alias("n")).groupBy("period").agg(F.max("n").alias("n"))
    out, held = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r.period):  # a row for each period
        if out and held + r.n <= at_once:
            out[-1], held = (out[-1][0], r.period), held + r.n
        else:
            out.append((r.period, r.period))
            held = r.n
    return out


def rating_fold(outcomes: DataFrame, state: DataFrame | None = None, knobs: Elo = Elo(), at_once: int = AT_ONCE) -> DataFrame:
    """History rows of every league and rows of kind ``state`` (no period) of everyone known at the end.

    The outcomes are written once; a task holds one league's rows of one run of periods (``spans``) and its people; between
    runs the state is a written table."""
    rows = staged(outcomes.select("league", "period", "dev", "outcome"), "outcomes")
    runs = spans(rows, at_once)
    if len(runs) < 2:
        return _fold(rows, state, knobs)
    done = []
    for first, last in runs:
        part = staged(_fold(rows.where(F.col("period").between(first, last)), state, knobs), "ratings")
        done.append(part.where(F.col("kind") != STATE))
        state = state_of(part)
    ended = done[0].sparkSession.createDataFrame([], HISTORY).unionByName(state, allowMissingColumns=True).withColumns({"kind": F.lit(STATE), "delta": F.lit(0.0)})
    return reduce(DataFrame.unionByName, done, ended.select(*done[0].columns))


def rating_walk(outcomes: DataFrame, state: DataFrame | None = None, knobs: Elo = Elo(), at_once: int = AT_ONCE) -> DataFrame:
    """History rows of every league: (league, dev, period, kind, outcome, delta, rating, periods_played, idle_streak)."""
    return rating_fold(outcomes, state, knobs, at_once).where(F.col("kind") != STATE)


def state_of(folded: DataFrame) -> DataFrame:
    """(league, dev, rating, periods_played, idle_streak) of everyone known at the end of ``rating_fold``: what a later walk begins from."""
    return folded.where(F.col("kind") == STATE).select("league", "dev", "rating", "periods_played", "idle_streak")


def advance_fold(outcomes: DataFrame, state: DataFrame | None, last_period: str | None, knobs: Elo = Elo(), now=None, first_period: str | None = None) -> DataFrame:
    """History and state (as ``rating_fold``) of the periods after ``last_period`` that are over by the day ``now`` (all without
    one), none before ``first_period``; without a last period, all from an empty state."""
    rows = outcomes if now is None else outcomes.where(period_close("period") <= F.to_date(now))
    rows = rows if first_period is None else rows.where(F.col("period") >= first_period)
    if last_period is None:
        return rating_fold(rows, None, knobs)
    return rating_fold(rows.where(F.col("period") > last_period), state, knobs)


def advance(outcomes: DataFrame, state: DataFrame | None, last_period: str | None, knobs: Elo = Elo(), now=None, first_period: str | None = None) -> DataFrame:
    """The history alone of ``advance_fold``."""
    return advance_fold(outcomes, state, last_period, knobs, now, first_period).where(F.col("kind") != STATE)


def attach(roster: DataFrame, history: DataFrame, knobs: Elo = Elo(), league: str | None = None) -> DataFrame:
    """(dev, rating, delta, provisional) or, with a ``league`` column on both sides, so per league: the start rating for
    those who never played."""
    keys = ["dev"] if league is None else [league, "dev"]
    order = W.partitionBy(*keys).orderBy(F.desc("period"))
    last = history.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    out = roster.select(*keys).join(last.select(*keys, "rating", "delta", "periods_played"), keys, "left")
    return out.select(*keys, F.coalesce("rating", F.lit(knobs.start)).alias("rating"), F.coalesce("delta", F.lit(0.0)).alias("delta"), (F.coalesce("periods_played", F.lit(0)) < knobs.provisional).alias("provisional"))


def histories(history: DataFrame, first=None, last=None) -> DataFrame:
    """(league, dev, history): each person's rows in order with the day each period closed, clipped to a range of such days."""
    rows = history.withColumn("closed", period_close("period"))
    rows = rows if first is None else rows.where(F.col("closed") >= first)
    rows = rows if last is None else rows.where(F.col("closed") <= last)
    return rows.groupBy("league", "dev").agg(F.array_sort(F.collect_list(F.struct("closed", "period", "kind", "rating", "delta"))).alias("history"))
