"""Point-in-time features: only what was known before the row's own game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.functions.typing import innings_to_outs, try_double
from stakelens.operators.gamelog import relievers, starters
from stakelens.operators.ordered import look_back


def last_n_form(games: DataFrame, n: int = 10, default: int | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """Wins and games of each team's previous ``n`` games, home and away together.

    Games become two team rows; the window ends one row before the current game.
    Without history the win count is ``default`` (NULL unless given).
    """
    home_won = (F.col("home_score") > F.col("away_score")).cast("int")
    team_rows = games.select(
        "game_pk",
        "game_date",
        F.inline(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.lit(True).alias("at_home"), home_won.alias("won")),
                F.struct(F.col("away_team").alias("team"), F.lit(False).alias("at_home"), (1 - home_won).alias("won")),
            )
        ),
    )
    rows, parts, carried = look_back(team_rows, ["team"], "game_date", ["game_date", "game_pk"], n, hot_rows)
    w = W.partitionBy(*parts).orderBy("game_date", "game_pk").rowsBetween(-n, -1)
    wins = F.sum("won").over(w)
    wins = wins if default is None else F.coalesce(wins, F.lit(default))
    form = rows.withColumns({"_wins": wins, "_games": F.count("won").over(w)}).where(~F.col(carried))

    def side(col: str, at_home: bool):
        return F.max(F.when(F.col("at_home") == at_home, F.col(col)))

    return form.groupBy("game_pk").agg(
        side("_wins", True).alias("l10_home_wins"),
        side("_games", True).alias("l10_home_games"),
        side("_wins", False).alias("l10_away_wins"),
        side("_games", False).alias("l10_away_games"),
    )


def earned_run_rates(box: DataFrame, windows: Sequence[int] = (3, 5, 8), hot_rows: int = 1_000_000) -> DataFrame:
    """Earned runs per nine innings over exactly the previous w starts; NULL until w starts exist."""
    starts = starters(box).where(
        try_double("innings_pitched").isNotNull() & try_double("pitcher_earned_runs").isNotNull()
    )
    rows = starts.select(
        "player_id", "game_pk", "game_date", "team_id", "slot", "entry_key", "entry_ref",
        innings_to_outs("innings_pitched").alias("outs"),
        F.col("pitcher_earned_runs").try_cast("int").alias("earned"),
    )
    order = ["game_date", "game_pk", "slot", "entry_key", "entry_ref"]
    rows, parts, carried = look_back(rows, ["player_id"], "game_date", order, max(windows), hot_rows)
    base = W.partitionBy(*parts).orderBy(*order)
    rates = {}
    for k in windows:
        w = base.rowsBetween(-k, -1)
        outs = F.sum("outs").over(w)
        rate = F.round(F.try_divide(F.sum("earned").over(w) * F.lit(27.0), outs), 3)
        rates[f"ra9_l{k}"] = F.when((F.count("outs").over(w) == k) & (outs > 0), rate)
    return rows.withColumns(rates).where(~F.col(carried)).drop(carried, "_block")


def relief_workload(box: DataFrame, days: int = 2) -> DataFrame:
    """Relief outs of each team over the previous calendar days, on days it used relief."""
    daily = (
        relievers(box)
        .where(F.col("innings_pitched").isNotNull())
        .groupBy("team_id", "game_date")
        .agg(F.sum(innings_to_outs("innings_pitched")).alias("outs"))
    )
    return trailing_days(daily, "team_id", "game_date", "outs", days, "fatigue")


def trailing_days(daily: DataFrame, key: str, day: str, value: str, days: int, name: str) -> DataFrame:
    """Sum over the ``days`` calendar days before each day; the input has one row per (key, day)."""
    w = W.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    return daily.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def with_fatigue(games: DataFrame, workload: DataFrame, home: str, away: str) -> DataFrame:
    """Both teams' trailing workload; a team without an entry that day counts zero."""
    out = games
    for side, team in (("home", home), ("away", away)):
        entry = workload.select(
            F.col("team_id").alias(team), "game_date", F.col("fatigue").alias(f"{side}_fatigue")
        )
        out = out.join(entry, [team, "game_date"], "left")
    return out.fillna(0, subset=["home_fatigue", "away_fatigue"])


def opposing_starters(box: DataFrame) -> DataFrame:
    """Starting pitchers of both sides per game (lowest id if several are listed)."""
    s = starters(box)
    both = s.groupBy("game_pk").agg(
        F.min(F.when(F.col("is_home"), F.col("player_id"))).alias("home_starter_id"),
        F.min(F.when(~F.col("is_home"), F.col("player_id"))).alias("away_starter_id"),
    )
    return both.na.drop()


def pitcher_matchups(starters_by_game: DataFrame, rates: DataFrame, runs: DataFrame) -> DataFrame:
    """Both starters' point-in-time rates, both teams' runs and the result."""
    from stakelens.operators.grading import first_per_key

    ra9 = [c for c in rates.columns if c.startswith("ra9_")]
    first = first_per_key(
        rates.select("game_pk", "player_id", "game_date", "team_id", "slot", "entry_key", "entry_ref", *ra9),
        ["game_pk", "player_id"], ["slot", "entry_key", "entry_ref"],
    )
    out = starters_by_game
    for side in ("home", "away"):
        start = first.select(
            "game_pk",
            F.col("player_id").alias(f"{side}_starter_id"),
            F.col("team_id").alias(f"{side}_team_id"),
            *([F.col("game_date")] if side == "home" else []),
            *[F.col(c).alias(f"{side}_{c}") for c in ra9],
        )
        score = runs.select(
            "game_pk", F.col("team_id").alias(f"{side}_team_id"), F.col("team_runs").alias(f"{side}_score")
        )
        out = out.join(start, ["game_pk", f"{side}_starter_id"]).join(score, ["game_pk", f"{side}_team_id"])
    return out.withColumn("home_win", (F.col("home_score") > F.col("away_score")).cast("int"))
