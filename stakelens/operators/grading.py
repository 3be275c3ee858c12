"""Raw picks and quotes to graded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.functions import typing as t
from stakelens.functions.names import name_keys
from stakelens.functions.odds import unit_profit


def graded_picks(raw: DataFrame, need_market_type: bool = True) -> DataFrame:
    """Silver projection of landed picks: typed, valid and with unit profit."""
    odds, win = t.try_int("odds"), t.truthy("hit")
    keep = t.not_flagged("is_synthetic") & t.not_flagged("voided") & F.col("hit").isNotNull() & odds.isNotNull()
    if need_market_type:
        keep = keep & F.col("market_type").isNotNull()
    return raw.where(keep).select(
        "event_id", "player_id", "book_id", "slot", "stake_ref",
        F.col("prop_type").alias("market"),
        F.lower("pick_side").alias("side"),
        odds.alias("odds"),
        t.try_int("confidence").alias("confidence"),
        t.try_double("line").alias("line"),
        (t.try_double("clv_bp") / 100.0).alias("clv"),
        win.alias("win"),
        t.try_date("game_date").alias("game_date"),
        unit_profit(win, odds).alias("profit"),
    )


def result_wins(stat: Column, line: Column, side: Column, push: str = "loss") -> Column:
    """Over/under result; a push loses both sides unless ``push='void'``. Unknown compares as a loss."""
    won = F.when(side == "over", stat > line).otherwise(stat < line)
    won = F.coalesce(won, F.lit(False))
    if push == "void":
        return F.when(stat == line, F.lit(None).cast("boolean")).otherwise(won)
    return won


def typed_quotes(quotes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Quotes joined to their game, with typed prices. Typed before they move, since numbers are shorter than their text."""
    typed = quotes.withColumns(
        {
            "season": F.col("season").try_cast("int"),
            "line": t.signed_number("line"),
            "best_over_odds": t.try_int("best_over_odds"),
            "best_under_odds": t.try_int("best_under_odds"),
        }
    )
    return typed.join(bridge.withColumn("game_pk", F.col("game_pk").try_cast("long")), "event_id")


def keyed_quotes(quotes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Typed quotes with the normalised player name. Names are keyed before the join, so the pass that looks for names of other
    scripts reads the quotes alone."""
    return typed_quotes(name_keys(quotes, "player_name"), bridge)


def both_sides(df: DataFrame, stat: str, over: str = "best_over_odds", under: str = "best_under_odds") -> DataFrame:
    """One quote -> an under row and an over row with own price and result; unpriced sides drop."""
    sides = F.array(
        F.struct(F.lit("under").alias("side"), F.col(under).alias("odds")),
        F.struct(F.lit("over").alias("side"), F.col(over).alias("odds")),
    )
    out = df.withColumn("_s", F.explode(sides)).select(*df.columns, "_s.side", "_s.odds")
    out = out.where(F.col("odds").isNotNull())
    win = result_wins(F.col(stat), F.col("line"), F.col("side"))
    return out.withColumn("win", win).withColumn("profit", unit_profit("win", "odds"))


def main_line(df: DataFrame, keys: list[str], price: str, ties: list[str]) -> DataFrame:
    """Per key the quote whose price is nearest even money, then the lowest line.

    A min over one struct, the rank before what only comes along, so it combines on the map side, needs no sort and carries no column twice.
    """
    from stakelens.functions.odds import implied_prob

    rest = [c for c in df.columns if c not in keys]
    rank = [
        F.coalesce(F.abs(implied_prob(price) - 0.5), F.lit(9.0)).alias("_dist"),
        F.col("line").isNull().alias("_none"),
        *dict.fromkeys(["line", *ties, *rest]),
    ]
    best = df.groupBy(*keys).agg(F.min(F.struct(*rank)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the first in the given total order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
