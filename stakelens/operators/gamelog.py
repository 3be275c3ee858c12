"""Team-level facts built from player lines and line-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: position types that bat
BATTERS = ("Catcher", "Hitter", "Infielder", "Outfielder")


def batters(box: DataFrame) -> DataFrame:
    return box.where(F.col("position_type").isin(*BATTERS))


def starters(box: DataFrame) -> DataFrame:
    return box.where((F.col("position_type") == "Pitcher") & F.col("is_starter"))


def relievers(box: DataFrame) -> DataFrame:
    return box.where((F.col("position_type") == "Pitcher") & ~F.col("is_starter"))


def team_runs(box: DataFrame) -> DataFrame:
    """Runs per (game, team); teams whose runs are all unknown are dropped."""
    runs = batters(box).groupBy("game_pk", "team_id").agg(F.sum("runs_scored").alias("team_runs"))
    return runs.where(F.col("team_runs").isNotNull())


def side_votes(lineups: DataFrame, bridge: DataFrame, box: DataFrame) -> DataFrame:
    """Team per (game, side) by majority of listed players; ties go to the lower team id."""
    keyed = lineups.join(bridge, "event_id").withColumn("game_pk", F.col("game_pk").try_cast("long"))
    votes = (
        keyed.join(box.select("game_pk", "player_id", "team_id"), ["game_pk", "player_id"])
        .groupBy("game_pk", "team_side", "team_id")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    top = F.max_by(F.struct("team_id", "votes"), F.struct(F.col("votes"), -F.col("team_id"))).alias("_w")
    return votes.groupBy("game_pk", "team_side").agg(top).select("game_pk", "team_side", "_w.team_id", "_w.votes")


def home_away(votes: DataFrame) -> DataFrame:
    """Side rows to one row per game holding both teams."""
    wide = votes.groupBy("game_pk").agg(
        F.max(F.when(F.col("team_side") == "home", F.col("team_id"))).alias("home_team_id"),
        F.max(F.when(F.col("team_side") == "away", F.col("team_id"))).alias("away_team_id"),
    )
    return wide.na.drop(subset=["home_team_id", "away_team_id"])


def game_log(box: DataFrame, sides: DataFrame) -> DataFrame:
    """Date, both teams and both scores of every game that has them all."""
    return log_of(box.select("game_pk", "game_date").distinct(), team_runs(box), sides)


def log_of(dates: DataFrame, runs: DataFrame, sides: DataFrame) -> DataFrame:
    """The game log from the games' dates, the runs of their teams and which team is on which side."""
    side_rows = sides.join(runs, "game_pk").groupBy("game_pk", "home_team_id", "away_team_id").agg(
        F.max(F.when(F.col("team_id") == F.col("home_team_id"), F.col("team_runs"))).alias("home_runs"),
        F.max(F.when(F.col("team_id") == F.col("away_team_id"), F.col("team_runs"))).alias("away_runs"),
    )
    return dates.join(side_rows.na.drop(subset=["home_runs", "away_runs"]), "game_pk")


def folded_runs(lines: DataFrame, games: DataFrame) -> DataFrame:
    """Games (game_pk, game_date, home_team, away_team) that have player lines, with the batters' runs of each side.

    Lines (with ``is_home``) fold to one row a game before the games are met.
    """
    runs = F.when(F.col("position_type").isin(*BATTERS), F.col("runs_scored"))
    folded = lines.groupBy("game_pk").agg(
        F.sum(F.when(F.col("is_home"), runs)).alias("home_sum"), F.sum(F.when(~F.col("is_home"), runs)).alias("away_sum")
    )
    return games.join(folded, "game_pk")


def _by_team(home, away, name: str):
    """Both sides of a game as rows (team_id, name)."""
    pairs = ((F.col("home_team"), home), (F.col("away_team"), away))
    return F.inline(F.array(*[F.struct(team.alias("team_id"), value.alias(name)) for team, value in pairs]))


def team_runs_of(folded: DataFrame) -> DataFrame:
    """``team_runs`` from folded games."""
    sides = folded.select("game_pk", _by_team(F.col("home_sum"), F.col("away_sum"), "runs"))
    runs = sides.groupBy("game_pk", "team_id").agg(F.sum("runs").alias("team_runs"))
    return runs.where(F.col("team_runs").isNotNull())


def side_votes_of(lineups: DataFrame, bridge: DataFrame, lines: DataFrame, games: DataFrame) -> DataFrame:
    """``side_votes`` from player lines that say home or away only: votes fold by game before the teams are looked up."""
    keyed = lineups.join(bridge.withColumn("game_pk", F.col("game_pk").try_cast("long")).where("game_pk IS NOT NULL"), "event_id")
    met = keyed.join(lines.select("game_pk", "player_id", "is_home"), ["game_pk", "player_id"])
    counts = met.groupBy("game_pk", "team_side").agg(
        F.count_if("is_home").alias("home_n"), F.count_if(~F.col("is_home")).alias("away_n")
    )
    teams = games.select("game_pk", "home_team", "away_team").join(counts, "game_pk")
    rows = teams.select("game_pk", "team_side", _by_team(F.col("home_n"), F.col("away_n"), "n")).where("n > 0")
    votes = rows.groupBy("game_pk", "team_side", "team_id").agg(F.sum("n").alias("votes"))
    top = F.max_by(F.struct("team_id", "votes"), F.struct(F.col("votes"), -F.col("team_id"))).alias("_w")
    return votes.groupBy("game_pk", "team_side").agg(top).select("game_pk", "team_side", "_w.team_id", "_w.votes")
