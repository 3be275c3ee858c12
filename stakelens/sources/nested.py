"""Landed JSON documents to flat rows with declared schemas (no inference pass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE_RESPONSE = (
    "struct<error:string,data:struct<commence_time:string,bookmakers:array<struct<key:string,markets:array<struct<"
    "key:string,outcomes:array<struct<name:string,description:string,point:double,price:double>>>>>>>>"
)
QUOTE_DOC = (
    "event_id string, game_pk bigint, game_date string, snapshot_iso string, response " + QUOTE_RESPONSE
)
_PLAYER = (
    "struct<person:struct<id:bigint,fullName:string>,position:struct<type:string>,battingOrder:string,"
    "stats:struct<batting:struct<hits:int,homeRuns:int,totalBases:int,rbi:int,runs:int>,"
    "pitching:struct<gamesStarted:int,numberOfPitches:int,pitchesThrown:int,inningsPitched:string,strikeOuts:int,"
    "earnedRuns:int>>>"
)
_SIDE = f"struct<team:struct<id:bigint>,players:map<string,{_PLAYER}>>"
BOX_DOC = f"game_pk bigint, game_date string, teams struct<home:{_SIDE},away:{_SIDE}>"
_TEAM_NAME = "struct<team:struct<name:string>>"
SCHEDULE_DOC = (
    "dates array<struct<date:string,games:array<struct<gamePk:bigint,gameType:string,gameDate:string,"
    f"teams:struct<home:{_TEAM_NAME},away:{_TEAM_NAME}>>>>>"
)


def parse(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed once per document: a generator keeps the parse out of later filters and fields."""
    return docs.select(F.inline(F.array(F.from_json(column, schema))))


def usable_quotes(docs: DataFrame) -> DataFrame:
    """Drop failed or empty responses."""
    books = F.col("response.data.bookmakers")
    return docs.where(F.col("response.error").isNull() & (F.coalesce(F.size(books), F.lit(0)) > 0))


def flatten_quotes(docs: DataFrame, market_key: str | None = None) -> DataFrame:
    """event -> bookmakers[] -> markets[] -> outcomes[]: one row per quoted outcome."""
    books = usable_quotes(docs).select(
        "event_id", "game_pk", "game_date", F.inline("response.data.bookmakers").alias("book", "markets")
    )
    markets = books.select("event_id", "game_pk", "game_date", "book", F.inline("markets").alias("market_key", "outcomes"))
    if market_key is not None:
        markets = markets.where(F.col("market_key") == market_key)
    rows = markets.select(
        "event_id", "game_pk", "game_date", "book", "market_key",
        F.inline("outcomes").alias("side", "player_name", "point", "price"),
    )
    return rows.na.drop(subset=["player_name", "point", "price"]).withColumn("side", F.lower("side"))


def consensus(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Most quoted line over all books (lowest on ties) and the best price of each side at it.

    Counts and best prices fold to (key, line) first, so a key with very many quotes
    never gathers in one task.
    """
    lines = quotes.groupBy(*by, "point").agg(
        F.count(F.lit(1)).alias("quotes"),
        F.max(F.when(F.col("side") == "over", F.col("price"))).alias("best_over"),
        F.max(F.when(F.col("side") == "under", F.col("price"))).alias("best_under"),
    )
    pick = F.max_by(F.struct("point", "best_over", "best_under"), F.struct(F.col("quotes"), -F.col("point")))
    return lines.groupBy(*by).agg(pick.alias("_c")).select(
        *by, F.col("_c.point").alias("line"), "_c.best_over", "_c.best_under"
    )


def _started(batting: Column, pitching: Column, order: Column) -> Column:
    pitched = pitching.isNotNull() & (F.coalesce(pitching["gamesStarted"], F.lit(0)) == 1)
    listed = batting.isNotNull() & order.isNotNull() & (order % 100 == 0)
    return pitched | F.coalesce(listed, F.lit(False))


def flatten_boxscores(docs: DataFrame) -> DataFrame:
    """Both teams' player maps to one row per player who batted or pitched."""
    sides = F.array("teams.home", "teams.away")
    teams = docs.select("game_pk", "game_date", F.inline(sides).alias("team", "players"))
    rows = teams.select("game_pk", "game_date", F.col("team.id").alias("team_id"), F.explode("players").alias("k", "p"))
    bat, pit = F.col("p.stats.batting"), F.col("p.stats.pitching")
    order = F.col("p.battingOrder").try_cast("int")
    thrown = F.coalesce(F.nullif(pit["numberOfPitches"], F.lit(0)), pit["pitchesThrown"])
    return rows.where(bat.isNotNull() | pit.isNotNull()).select(
        F.col("p.person.id").alias("player_id"), "game_pk", F.col("game_date").try_cast("date").alias("game_date"),
        "team_id", F.col("p.person.fullName").alias("player_name"), F.col("p.position.type").alias("position_type"),
        _started(bat, pit, order).alias("is_starter"), F.floor(order / 100).cast("int").alias("batting_order_slot"),
        bat["hits"].alias("hits"), bat["homeRuns"].alias("home_runs"), bat["totalBases"].alias("total_bases"),
        bat["rbi"].alias("rbi"), bat["runs"].alias("runs_scored"), pit["inningsPitched"].alias("innings_pitched"),
        thrown.alias("pitches_thrown"), pit["strikeOuts"].alias("strikeouts"),
        pit["earnedRuns"].alias("pitcher_earned_runs"),
    )


def flatten_schedule(docs: DataFrame, game_type: str = "R") -> DataFrame:
    """dates[] -> games[] of one game type, one row per game."""
    days = docs.select(F.inline("dates").alias("game_date", "games"))
    games = days.select("game_date", F.inline("games").alias("game_pk", "game_type", "commence", "teams"))
    return (
        games.where(F.col("game_type") == game_type)
        .select(
            "game_pk", "game_date", F.col("teams.home.team.name").alias("home_team"),
            F.col("teams.away.team.name").alias("away_team"), F.col("commence").alias("commence_time_utc"),
        )
        .dropDuplicates(["game_pk"])
    )
