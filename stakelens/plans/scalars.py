"""Typing rules and scalar functions applied over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakelens.functions import names, odds
from stakelens.functions import typing as t
from stakelens.plans.adapters import boxscore, games, picks, picks_raw, with_tables
from stakelens.plans.registry import query
from stakelens.session import table

_RAW = with_tables("picks_raw")
_KEY = "event_id, player_id, book_id, slot, stake_ref"
_KEYS = ["event_id", "player_id", "book_id", "slot", "stake_ref"]


@query(
    "lenient_cast",
    _RAW + f"SELECT {_KEY}, TRY_CAST(odds AS INT) AS odds, TRY_CAST(confidence AS INT) AS confidence, "
    "TRY_CAST(line AS DOUBLE) AS line, TRY_CAST(game_date AS DATE) AS game_date, "
    "TRY_CAST(unit_profit AS DOUBLE) AS unit_profit FROM picks_raw",
)
def q_lenient_cast(spark, sf):
    return picks_raw(spark, sf).select(
        *_KEYS,
        t.try_int("odds").alias("odds"),
        t.try_int("confidence").alias("confidence"),
        t.try_double("line").alias("line"),
        t.try_date("game_date").alias("game_date"),
        t.try_double("unit_profit").alias("unit_profit"),
    )


@query(
    "lenient_bool",
    _RAW + "SELECT lower(hit) IN ('true', 't', '1') AS win, "
    "lower(coalesce(voided, 'false')) IN ('true', 't', '1') AS is_void, count(*) AS n FROM picks_raw GROUP BY 1, 2",
)
def q_lenient_bool(spark, sf):
    typed = picks_raw(spark, sf).select(t.truthy("hit").alias("win"), (~t.not_flagged("voided")).alias("is_void"))
    return typed.groupBy("win", "is_void").agg(F.count(F.lit(1)).alias("n"))


@query(
    "notnull_any",
    with_tables("picks") + "SELECT market, count(*) AS n, count(score_tax) AS with_tax, "
    "count(score_price) AS with_price FROM picks WHERE (score_tax IS NOT NULL OR score_price IS NOT NULL) "
    "AND clv IS NOT NULL GROUP BY market",
)
def q_notnull_any(spark, sf):
    rows = picks(spark, sf).na.drop(how="all", subset=["score_tax", "score_price"]).na.drop(subset=["clv"])
    return rows.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score_tax").alias("with_tax"),
        F.count("score_price").alias("with_price"),
    )


@query(
    "clean_signed_number",
    _RAW + f"SELECT {_KEY}, TRY_CAST(replace(handicap, '+', '') AS DOUBLE) AS handicap FROM picks_raw",
)
def q_clean_signed_number(spark, sf):
    return picks_raw(spark, sf).select(*_KEYS, t.signed_number("handicap").alias("handicap"))


@query(
    "unit_profit",
    _RAW + f"SELECT {_KEY}, TRY_CAST(odds AS INT) AS odds, lower(hit) IN ('true', 't', '1') AS win, "
    "coalesce(TRY_CAST(unit_profit AS DOUBLE), CASE WHEN hit IS NULL OR TRY_CAST(odds AS INT) IS NULL THEN NULL "
    "WHEN lower(hit) NOT IN ('true', 't', '1') THEN -1e0 WHEN TRY_CAST(odds AS INT) > 0 "
    "THEN TRY_CAST(odds AS INT) / 100e0 ELSE 100e0 / abs(TRY_CAST(odds AS INT)) END) AS profit FROM picks_raw",
)
def q_unit_profit(spark, sf):
    price, win = t.try_int("odds"), t.truthy("hit")
    return picks_raw(spark, sf).select(
        *_KEYS,
        price.alias("odds"),
        win.alias("win"),
        F.coalesce(t.try_double("unit_profit"), odds.unit_profit(win, price)).alias("profit"),
    )


def _implied(o: str) -> str:
    return f"(CASE WHEN {o} > 0 THEN 100e0 / ({o} + 100e0) ELSE -{o} / (-{o} + 100e0) END)"


@query("implied_prob", with_tables("picks") + f"SELECT {_KEY}, odds, {_implied('odds')} AS prob FROM picks")
def q_implied_prob(spark, sf):
    return picks(spark, sf).select(*_KEYS, "odds", odds.implied_prob("odds").alias("prob"))


@query(
    "decimal_to_american",
    "SELECT price, american, count(*) AS n FROM (SELECT price, CAST(CASE WHEN price <= 1 THEN NULL WHEN price >= 2 "
    "THEN round_even((price - 1) * 100, 0) ELSE round_even(-100e0 / (price - 1), 0) END AS INT) AS american "
    "FROM (SELECT 0.875e0 + l_quantity / 16e0 AS price FROM lineitem)) GROUP BY price, american",
)
def q_decimal_to_american(spark, sf):
    prices = table(spark, sf, "lineitem").select((F.lit(0.875) + F.col("l_quantity") / 16.0).alias("price"))
    graded = prices.withColumn("american", odds.decimal_to_american("price"))
    return graded.groupBy("price", "american").agg(F.count(F.lit(1)).alias("n"))


@query(
    "devig_prob",
    with_tables("games", extra="p AS (SELECT game_pk, "
    f"{_implied('home_close_ml')} AS ph, {_implied('away_close_ml')} AS pa FROM games "
    "WHERE home_close_ml IS NOT NULL AND away_close_ml IS NOT NULL)")
    + "SELECT game_pk, ph + pa - 1 AS vig, ph / (ph + pa) AS fair_home FROM p",
)
def q_devig_prob(spark, sf):
    priced = games(spark, sf).na.drop(subset=["home_close_ml", "away_close_ml"])
    return priced.select(
        "game_pk",
        odds.overround("home_close_ml", "away_close_ml").alias("vig"),
        odds.fair_prob("home_close_ml", "away_close_ml").alias("fair_home"),
    )


@query(
    "norm_name",
    "SELECT doc_id, lower(strip_accents(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) "
    "AS name_norm FROM documents",
)
def q_norm_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.norm_name("text").alias("name_norm"))


_LAST_FIRST = (
    "CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN 'Núñez ' || p_brand || ', ' || p_name "
    "ELSE p_type || ',José' END"
)


@query(
    "norm_last_first",
    f"SELECT p_partkey, lower(strip_accents(trim(CASE WHEN contains(nm, ',') THEN "
    "trim(substr(nm, instr(nm, ',') + 1)) || ' ' || trim(substr(nm, 1, instr(nm, ',') - 1)) ELSE nm END))) AS folded, "
    "lower(trim(CASE WHEN contains(nm, ',') THEN trim(substr(nm, instr(nm, ',') + 1)) || ' ' || "
    "trim(substr(nm, 1, instr(nm, ',') - 1)) ELSE nm END)) AS plain "
    f"FROM (SELECT p_partkey, {_LAST_FIRST} AS nm FROM part)",
)
def q_norm_last_first(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey", f"{_LAST_FIRST} AS nm")
    return part.select(
        "p_partkey",
        names.norm_last_first("nm").alias("folded"),
        names.norm_last_first("nm", fold_accents=False).alias("plain"),
    )


@query(
    "innings_to_outs",
    with_tables("boxscore", extra="o AS (SELECT innings_pitched, CASE WHEN innings_pitched IS NULL THEN 0 ELSE "
    "CAST(split_part(innings_pitched, '.', 1) AS INT) * 3 + (CASE split_part(innings_pitched, '.', 2) "
    "WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 0 END) END AS outs FROM boxscore)")
    + "SELECT innings_pitched, CAST(outs AS INT) AS outs, outs / 3e0 AS innings, count(*) AS n FROM o GROUP BY ALL",
)
def q_innings_to_outs(spark, sf):
    typed = boxscore(spark, sf).select(
        "innings_pitched",
        t.innings_to_outs("innings_pitched").alias("outs"),
        t.innings_decimal("innings_pitched").alias("innings"),
    )
    return typed.groupBy("innings_pitched", "outs", "innings").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_time",
    "SELECT event_id, strftime(ts - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS snapshot_iso, "
    "CAST(CAST(strftime(ts - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS DATE) AS snapshot_day, "
    "CAST(year(ts) AS INT) AS season, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day_no "
    "FROM events",
)
def q_snapshot_time(spark, sf):
    snap = F.col("ts") - F.expr("INTERVAL 30 MINUTES")
    iso = F.date_format(snap, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select(
        "event_id",
        iso.alias("snapshot_iso"),
        F.to_date(F.regexp_replace(iso, "Z$", "").cast("timestamp_ntz")).alias("snapshot_day"),
        F.year("ts").alias("season"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_no"),
    )
