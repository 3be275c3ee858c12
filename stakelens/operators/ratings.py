"""Elo ratings before each game.

A rating depends on every earlier game of both teams, so no window expresses it.
Leagues are independent. Two exact ways:

* ``fold``: leagues up to a checked size are streamed in date order through one
  task each; the only state is the rating of each team of the current league.
* ``relax``: larger leagues are solved by fixed-point sweeps. Given trial ratings
  all game updates are known, and a team's rating is then a running sum of its
  own updates (season regression is a known factor), computed in time blocks.
  Early games settle first, so sweeps stop when nothing moves any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.operators.ordered import blocked_running_total
from stakelens.session import checkpointed

K = 20.0
HOME_EDGE = 24.0
KEEP = 2.0 / 3.0
BASE = 1500.0
SETTLED = 1e-9

_GAME = ["league", "season", "game_date", "game_pk", "home_team", "away_team", "home_win", "known"]


def _prepare(games: DataFrame) -> DataFrame:
    won = (F.col("home_score") > F.col("away_score")).cast("int")
    return games.withColumns({"home_win": won, "known": F.lit(None).cast("double")}).select(*_GAME)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Play the rows in order. A row with a known rating seeds its team; every league ends
    with one row per team holding the rating to carry on from."""
    league, season, rating = None, None, {}

    def standings() -> pd.DataFrame:
        return pd.DataFrame(
            {"league": league, "game_pk": None, "season": season, "team": list(rating), "rating": list(rating.values()),
             "elo_home_pre": None, "elo_away_pre": None}
        )

    for batch in batches:
        keys, home_pre, away_pre = [], [], []
        columns = [batch[c] for c in ("league", "season", "game_pk", "home_team", "away_team", "home_win", "known")]
        for lg, yr, pk, home, away, won, known in zip(*columns):
            if lg != league:
                if rating:
                    yield standings()
                league, season, rating = lg, yr, {}
            if known == known and known is not None:
                rating[home] = known
                continue
            if yr != season:
                season = yr
                rating = {t: BASE + KEEP * (r - BASE) for t, r in rating.items()}
            h, a = rating.get(home, BASE), rating.get(away, BASE)
            keys.append((lg, pk, yr))
            home_pre.append(h)
            away_pre.append(a)
            step = K * (won - 1.0 / (1.0 + 10.0 ** ((a - h - HOME_EDGE) / 400.0)))
            rating[home], rating[away] = h + step, a - step
        if keys:
            played = pd.DataFrame(keys, columns=["league", "game_pk", "season"])
            yield played.assign(team=None, rating=None, elo_home_pre=home_pre, elo_away_pre=away_pre)
    if rating:
        yield standings()


_WALKED = (
    "league bigint, game_pk bigint, season int, team bigint, rating double, elo_home_pre double, elo_away_pre double"
)


def advance(games: DataFrame, standings: DataFrame | None = None) -> DataFrame:
    """Play games on top of earlier standings (league, season, team, rating); returns game rows
    (team NULL) and the new standings (game_pk NULL)."""
    rows = _prepare(games)
    if standings is not None:
        seeds = standings.select(
            "league", "season", F.lit(None).cast("date").alias("game_date"), F.lit(None).cast("long").alias("game_pk"),
            F.col("team").alias("home_team"), F.lit(None).cast("long").alias("away_team"),
            F.lit(None).cast("int").alias("home_win"), F.col("rating").alias("known"),
        )
        rows = seeds.unionByName(rows)
    # seeds carry no date and so sort before the league's games
    ordered = rows.repartition("league").sortWithinPartitions("league", "game_date", "game_pk")
    return ordered.mapInPandas(_walk, _WALKED)


def fold(games: DataFrame) -> DataFrame:
    """Date-ordered pass, one task per league, rows streamed in Arrow batches."""
    played = advance(games).where(F.col("team").isNull())
    return played.select("league", "game_pk", "elo_home_pre", "elo_away_pre")


def _step(home: Column, away: Column) -> Column:
    expected = F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (away - home - HOME_EDGE) / 400.0))
    return F.lit(K) * (F.col("home_win") - expected)


def relax(games: DataFrame, block: str = "month") -> DataFrame:
    """Fixed-point sweeps until nothing moves; every stage is spread by (team, time block).

    Each sweep settles at least the earliest game of every team not settled yet, so the sweeps end.
    """
    base = _prepare(games).drop("known")
    seasons = base.select("league", "season").distinct()
    order = W.partitionBy("league").orderBy("season")
    seasons = seasons.withColumn("age", F.row_number().over(order) - 1)
    state = checkpointed(
        base.join(seasons, ["league", "season"])
        .withColumn("block", F.date_trunc(block, F.col("game_date").cast("timestamp")))
        .withColumns({"h": F.lit(BASE), "a": F.lit(BASE)})
    )
    while True:
        step = _step(F.col("h"), F.col("a"))
        team_rows = state.select(
            "league", "game_pk", "game_date", "block", "age",
            F.inline(F.array(
                F.struct(F.col("home_team").alias("team"), F.lit(True).alias("home"), step.alias("d")),
                F.struct(F.col("away_team").alias("team"), F.lit(False).alias("home"), (-step).alias("d")),
            )),
        )
        scaled = F.col("d") * F.pow(F.lit(1.0 / KEEP), F.col("age"))
        summed = blocked_running_total(
            team_rows, ["league", "team"], "block", ["game_date", "game_pk"], scaled, "total"
        )
        rated = summed.withColumn("r", F.lit(BASE) + F.pow(F.lit(KEEP), F.col("age")) * F.col("total"))
        fresh = rated.groupBy("league", "game_pk").agg(
            F.max(F.when(F.col("home"), F.col("r"))).alias("h2"),
            F.max(F.when(~F.col("home"), F.col("r"))).alias("a2"),
        )
        moved = F.greatest(F.abs(F.col("h2") - F.col("h")), F.abs(F.col("a2") - F.col("a")))
        state = checkpointed(
            state.join(fresh, ["league", "game_pk"]).withColumn("moved", moved)
            .withColumns({"h": F.col("h2"), "a": F.col("a2")}).drop("h2", "a2")
        )
        if (state.agg(F.max("moved")).first()[0] or 0.0) < SETTLED:
            return state.select("league", "game_pk", F.col("h").alias("elo_home_pre"), F.col("a").alias("elo_away_pre"))
        state = state.drop("moved")


def elo_ratings(games: DataFrame, max_fold_games: int = 2_000_000) -> DataFrame:
    """Pre-game ratings of both teams and the home-adjusted difference."""
    sizes = games.groupBy("league").agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= max_fold_games:
        rated = fold(games)
    else:
        large = sizes.where(F.col("_n") > max_fold_games)
        rated = fold(games.join(large, "league", "left_anti")).unionByName(
            relax(games.join(large, "league", "left_semi"))
        )
    return rated.withColumn("elo_diff", F.col("elo_home_pre") + HOME_EDGE - F.col("elo_away_pre"))
