"""Domain tables derived from the driver's parquet tables.

The derivations are plain arithmetic on existing columns, written once as
dialect-neutral projections so that the same text feeds Spark and the checking
SQL. Nothing is generated or sampled: every source row yields its domain row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.session import table

# fixed values: market names by line position, and the catalogue a report must cover
MARKET_OF_LINE = {
    1: "hits", 2: "total_bases", 3: "rbis", 4: "home_runs", 5: "runs_scored", 6: "totals", 7: "spreads",
}
MARKETS = (
    "pitcher_strikeouts", "hits", "total_bases", "rbis", "home_runs",
    "runs_scored", "spreads", "h2h", "totals", "pitcher_outs",
)

_MARKET = "CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MARKET_OF_LINE.items()) + " END"

_ODDS = (
    "CAST(CASE WHEN (l_partkey + l_suppkey) % 5 < 3 "
    "THEN -(101 + (l_partkey * 7 + l_linenumber * 13) % 399) "
    "ELSE 100 + (l_partkey * 11 + l_suppkey * 3) % 900 END AS INT)"
)

# step 1: price and confidence; step 2: outcome; step 3: profit
_PICK_STEPS = (
    [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        f"{_MARKET} AS market",
        "CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side",
        f"{_ODDS} AS odds",
        "CAST(40 + l_quantity AS INT) AS confidence",
        "l_partkey % 3 + 0.5e0 AS line",
        "CAST(l_shipdate AS DATE) AS game_date",
    ],
    [
        "l_orderkey AS event_id", "l_partkey AS player_id", "l_suppkey AS book_id",
        "l_linenumber AS slot", "l_extendedprice AS stake_ref", "market", "side", "odds", "confidence",
        "line", "game_date",
        "CAST(year(game_date) AS INT) AS season",
        "CASE l_returnflag WHEN 'A' THEN 'backtest' WHEN 'R' THEN 'production' ELSE 'archive' END AS source",
        "CASE WHEN l_discount >= 0.04e0 THEN l_discount * 97.3e0 - l_tax * 61.7e0 + l_quantity * 0.00137e0 - 3.1127e0 END AS clv",
        "(l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 < CAST(floor("
        "(CASE WHEN odds > 0 THEN 100e0 / (odds + 100e0) ELSE -odds / (-odds + 100e0) END)"
        " * (760 + (confidence - 40) * 6 + (confidence % 5) * 5)) AS INT) AS win",
        "l_discount AS score_discount",
        "CASE WHEN l_suppkey % 7 > 0 THEN l_tax END AS score_tax",
        "l_quantity * (1e0 + CAST(l_partkey % 4 AS DOUBLE)) AS score_volume",
        "CASE WHEN l_partkey % 6 > 0 THEN l_extendedprice / 1000e0 END AS score_price",
        "CASE WHEN l_orderkey % 50 = 0 THEN 1e0 + l_tax END AS score_sparse",
        "CAST(confidence % 5 AS DOUBLE) AS score_form",
    ],
    [
        "event_id", "player_id", "book_id", "slot", "stake_ref", "market", "side", "odds", "confidence",
        "line", "game_date", "season", "source", "clv", "win",
        "CASE WHEN NOT win THEN -1e0 WHEN odds > 0 THEN odds / 100e0 ELSE 100e0 / abs(odds) END AS profit",
        "score_discount", "score_tax", "score_volume", "score_price", "score_sparse", "score_form",
    ],
)

# tie-breaking columns that identify a pick within a day
PICK_TIES = ("event_id", "player_id", "book_id", "slot", "stake_ref", "side", "confidence")

_RAW = [
    "event_id", "player_id", "book_id", "slot", "stake_ref",
    "CASE WHEN player_id % 41 = 0 THEN NULL ELSE market END AS market_type",
    "market AS prop_type",
    "CASE WHEN event_id % 2 = 0 THEN upper(side) ELSE side END AS pick_side",
    "CASE WHEN book_id % 23 = 0 THEN 'abc' WHEN book_id % 29 = 0 THEN NULL"
    " WHEN odds > 0 AND player_id % 2 = 0 THEN '+' || CAST(odds AS STRING)"
    " WHEN player_id % 9 = 0 THEN ' ' || CAST(odds AS STRING) || ' '"
    " ELSE CAST(odds AS STRING) END AS odds",
    "CAST(line AS STRING) AS line",
    "CASE WHEN event_id % 31 = 0 THEN 'n/a' ELSE CAST(confidence AS STRING) END AS confidence",
    "CASE WHEN clv IS NOT NULL THEN CAST(CAST(floor(clv * 100e0) AS INT) AS STRING) END AS clv_bp",
    "CASE WHEN event_id % 43 = 0 THEN NULL WHEN win THEN"
    " (CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'T' WHEN 2 THEN '1' ELSE 'True' END)"
    " ELSE (CASE event_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'f' ELSE '0' END) END AS hit",
    "CASE WHEN player_id % 37 = 0 THEN 'T' WHEN player_id % 3 = 0 THEN NULL ELSE 'false' END AS voided",
    "CASE WHEN book_id % 31 = 0 THEN 'true' WHEN book_id % 2 = 0 THEN NULL ELSE 'f' END AS is_synthetic",
    "CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE CAST(game_date AS STRING) END AS game_date",
    "CASE WHEN player_id % 5 = 0 THEN CAST(CASE WHEN win THEN 0.75e0 ELSE -1e0 END AS STRING) END AS unit_profit",
    "CASE WHEN slot % 2 = 0 THEN '+' || CAST(line AS STRING) ELSE '-' || CAST(line AS STRING) END AS handicap",
]

#: the pick history as landed: the raw picks with their factors as text
FACTORS = ("score_discount", "score_tax", "score_volume", "score_price", "score_sparse", "score_form")
PICK_HISTORY = [*_RAW, *[f"CAST({c} AS STRING) AS {c}" for c in FACTORS]]

_LEAGUE_SQL = "CAST(floor(o_custkey / 30e0) AS BIGINT)"

_GAME_STEPS = (
    [
        "o_orderkey AS game_pk", "o_custkey", "o_orderkey",
        f"{_LEAGUE_SQL} AS league",
        "CAST(o_orderdate AS DATE) AS game_date",
        "CAST(year(o_orderdate) AS INT) AS season",
        "o_orderpriority", "o_orderstatus", "o_totalprice",
    ],
    [
        "game_pk", "league", "game_date", "season", "o_custkey % 25 AS venue_key",
        "league * 6 + o_custkey % 6 AS home_team",
        "league * 6 + (o_custkey + 1 + o_orderkey % 5) % 6 AS away_team",
        "CAST((o_orderkey * 7 + o_custkey * 3) % 11 AS INT) AS home_score",
        "CAST((o_orderkey * 5 + o_custkey) % 10 AS INT) AS away_score",
        "CAST(CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 3 < 2"
        " THEN -(105 + (o_orderkey * 13 + o_custkey) % 120) ELSE 100 + (o_orderkey * 17) % 110 END AS INT)"
        " AS home_close_ml",
        "CAST(CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 3 < 2"
        " THEN 100 + (o_orderkey * 13 + o_custkey) % 110 ELSE -(110 + (o_orderkey * 17) % 100) END AS INT)"
        " AS away_close_ml",
        "CAST(CASE WHEN o_orderkey % 3 < 2 THEN -(102 + (o_orderkey * 11 + o_custkey) % 120)"
        " ELSE 104 + (o_orderkey * 19) % 110 END AS INT) AS home_open_ml",
        "CAST(CASE WHEN o_orderkey % 3 < 2 THEN 101 + (o_orderkey * 11 + o_custkey) % 110"
        " ELSE -(108 + (o_orderkey * 19) % 100) END AS INT) AS away_open_ml",
        "CASE WHEN o_orderkey % 3 < 2 THEN '-1.5' ELSE '+1.5' END AS home_run_line",
        "CASE WHEN o_orderkey % 3 < 2 THEN '+1.5' ELSE '-1.5' END AS away_run_line",
        "CAST(CASE WHEN o_orderkey % 2 = 0 THEN 110 + o_orderkey % 60 ELSE -(110 + o_orderkey % 60) END AS INT)"
        " AS home_run_line_odds",
        "CAST(CASE WHEN o_orderkey % 2 = 0 THEN -(110 + o_orderkey % 60) ELSE 110 + o_orderkey % 60 END AS INT)"
        " AS away_run_line_odds",
        "7e0 + (o_custkey % 7) * 0.5e0 AS open_ou_line",
        "7e0 + ((o_custkey + o_orderkey) % 7) * 0.5e0 AS close_ou_line",
        "CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE -(105 + o_orderkey % 10) END AS INT) AS close_ou_odds",
        "CAST((o_orderkey * 3 + o_custkey) % 25 AS INT) AS wind_mph",
        "CAST(40 + (o_orderkey * 7 + o_custkey) % 60 AS INT) AS temperature_f",
        "o_custkey % 25 < 4 AS is_dome",
        "o_orderstatus AS status",
        "o_totalprice AS gate_receipts",
    ],
)

# lineitem with its order's teams
_BOX_STEPS = (
    [
        "o_orderkey AS game_pk", "CAST(o_orderdate AS DATE) AS game_date",
        f"{_LEAGUE_SQL} * 6 + o_custkey % 6 AS home_team",
        f"{_LEAGUE_SQL} * 6 + (o_custkey + 1 + o_orderkey % 5) % 6 AS away_team",
        "l_partkey AS player_id", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "CAST(l_quantity AS INT) AS q",
    ],
    [
        "game_pk", "game_date", "player_id", "l_suppkey AS entry_key", "l_linenumber AS slot",
        "l_extendedprice AS entry_ref",
        "CASE WHEN l_suppkey % 2 = 0 THEN home_team ELSE away_team END AS team_id",
        "l_suppkey % 2 = 0 AS is_home",
        "CASE WHEN l_partkey % 3 = 0 THEN 'José Núñez ' WHEN l_partkey % 3 = 1 THEN 'Zoë Müller '"
        " ELSE 'Sam Hill ' END || CAST(l_partkey AS STRING) AS player_name",
        "CASE l_linenumber % 5 WHEN 0 THEN 'Pitcher' WHEN 1 THEN 'Catcher' WHEN 2 THEN 'Hitter'"
        " WHEN 3 THEN 'Infielder' ELSE 'Outfielder' END AS position_type",
        "q % 2 = 1 AS is_starter",
        "CAST(q % 4 AS INT) AS hits",
        "CAST((l_partkey + l_suppkey) % 2 AS INT) AS home_runs",
        "CAST(q % 4 + (l_partkey + l_suppkey) % 2 * 3 AS INT) AS total_bases",
        "CAST((q + l_suppkey) % 4 AS INT) AS rbi",
        "CAST(CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE (q + l_partkey) % 5 END AS INT) AS runs_scored",
        "CAST(q % 12 AS INT) AS strikeouts",
        "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(q % 7 AS STRING) || '.' || CAST(l_suppkey % 4 AS STRING)"
        " END AS innings_pitched",
        "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(CAST(q % 6 AS INT) AS STRING) END AS pitcher_earned_runs",
    ],
)

_BATTERS = "('Catcher', 'Hitter', 'Infielder', 'Outfielder')"

# closing quotes: one per (event, slot, player, book); keys are text as landed
_QUOTE_STEPS = (
    [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate",
        "CASE l_linenumber WHEN 1 THEN 'batter_hits' WHEN 2 THEN 'batter_total_bases' WHEN 3 THEN 'batter_rbis'"
        " WHEN 4 THEN 'batter_home_runs' WHEN 5 THEN 'pitcher_strikeouts' WHEN 6 THEN 'totals'"
        " ELSE (CASE WHEN l_suppkey % 2 = 0 THEN 'h2h__away' ELSE 'spreads__away' END) END AS market_key",
        f"{_ODDS} AS over_price",
        "CAST(CASE WHEN (l_partkey + l_suppkey) % 5 < 3 THEN 105 + (l_partkey * 5 + l_suppkey) % 300"
        " ELSE -(102 + (l_partkey * 3 + l_suppkey * 7) % 350) END AS INT) AS under_price",
    ],
    [
        "'ev' || CAST(l_orderkey AS STRING) AS event_id",
        "CAST(l_shipdate AS DATE) AS quote_date",
        "CAST(CAST(year(l_shipdate) AS INT) AS STRING) AS season",
        "market_key",
        "CASE WHEN l_partkey % 3 = 0 THEN 'JOSE NUNEZ ' WHEN l_partkey % 3 = 1 THEN ' Zoe Müller '"
        " ELSE 'sam hill ' END || CAST(l_partkey AS STRING) || ' ' AS player_name",
        "CASE WHEN market_key = 'totals' THEN CAST(l_partkey % 8 + 0.5e0 AS STRING)"
        " WHEN market_key = 'spreads__away' THEN '+1.5'"
        " WHEN l_partkey % 47 = 0 THEN 'n/a' ELSE CAST(l_partkey % 4 + 0.5e0 AS STRING) END AS line",
        "CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE CAST(over_price AS STRING) END AS best_over_odds",
        "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(under_price AS STRING) END AS best_under_odds",
        "l_suppkey AS book_id", "l_partkey AS quote_player", "l_linenumber AS slot",
        "l_extendedprice AS quote_ref",
    ],
)


def _apply(df: DataFrame, steps) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*step)
    return df


def _sql(source: str, steps) -> str:
    text = source
    for step in steps:
        text = f"(SELECT {', '.join(step)} FROM {text})"
    return text[1:-1]


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Typed, graded picks: one per line item."""
    return _apply(table(spark, sf, "lineitem"), _PICK_STEPS)


def picks_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The same picks as they would land: all text, mixed spellings, gaps and junk.

    The row is built in a generator so that later filters read its columns, as they
    would on a landed table, and do not drag the derivation into one huge predicate.
    """
    return picks(spark, sf).selectExpr(f"inline(array(struct({', '.join(_RAW)})))")


def pick_history(spark: SparkSession, sf: str) -> DataFrame:
    """Landed picks with their factors, all text."""
    return picks(spark, sf).selectExpr(f"inline(array(struct({', '.join(PICK_HISTORY)})))")


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One game per order; six teams per league, leagues grow with the customers."""
    return _apply(table(spark, sf, "orders"), _GAME_STEPS)


def boxscore(spark: SparkSession, sf: str) -> DataFrame:
    """One player line per line item, with the game's teams."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _apply(joined, _BOX_STEPS)


def player_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of ``boxscore`` without what the game tells (day, team): nothing is joined, so they can be folded by game first.

    Lines whose game is not known are still in, and a game that is listed twice counts once here: see ``listed_games``.
    """
    need = {"game_date", "team_id"}
    lines = table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL").selectExpr(
        "l_orderkey AS game_pk", *[step for step in _BOX_STEPS[0] if step.startswith(("l_", "CAST(l_"))]
    )
    return lines.selectExpr(*[step for step in _BOX_STEPS[1] if step.split(" AS ")[-1] not in need])


def listed_games(games: DataFrame) -> DataFrame:
    """Games with ``listed``: how often each is listed, which is how often a join by game counts each of its lines."""
    return games.withColumn("listed", F.count(F.lit(1)).over(W.partitionBy("game_pk")))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Closing quotes as landed (text prices and lines)."""
    return _apply(table(spark, sf, "lineitem"), _QUOTE_STEPS)


def event_games(spark: SparkSession, sf: str) -> DataFrame:
    """Event to game bridge; a share of events has no usable game key."""
    return table(spark, sf, "orders").selectExpr(*_EVENT_GAMES)


def lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Announced line-ups; a few players are listed on the wrong side."""
    return table(spark, sf, "lineitem").selectExpr(*_LINEUPS)


_EVENT_GAMES = [
    "'ev' || CAST(o_orderkey AS STRING) AS event_id",
    "CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS game_pk",
]
_LINEUPS = [
    "'ev' || CAST(l_orderkey AS STRING) AS event_id",
    "CASE WHEN (l_suppkey % 2 = 0) <> (l_partkey % 13 = 0) THEN 'home' ELSE 'away' END AS team_side",
    "l_partkey AS player_id",
]

def _flag_sql(column: str) -> str:
    return f"coalesce(lower({column}) IN ('true', 't', '1'), false)"


def _profit_sql(win: str, odds: str) -> str:
    """Unit profit of a bet at American odds: stake 1 wins odds / 100 above zero, 100 / |odds| below."""
    return f"if({win}, if({odds} > 0, {odds} / 100e0, 100e0 / abs({odds})), -1e0)"


def _graded_sql() -> str:
    """Landed picks, typed; those without a usable price or outcome, synthetic or void are left out."""
    keep = ["event_id", "player_id", "book_id", "slot", "stake_ref", "prop_type AS market", "lower(pick_side) AS side"]
    numbers = {"odds": "INT", "confidence": "INT", "line": "DOUBLE", "game_date": "DATE"}
    typed = [f"TRY_CAST({c} AS {kind}) AS {c}" for c, kind in numbers.items()]
    more = ["TRY_CAST(clv_bp AS DOUBLE) / 100e0 AS clv", f"{_flag_sql('hit')} AS win"]
    barred = " OR ".join(_flag_sql(c) for c in ("is_synthetic", "voided"))
    rows = f"SELECT {', '.join(keep + typed + more)} FROM picks_raw WHERE NOT ({barred}) AND market_type IS NOT NULL AND hit IS NOT NULL"
    return f"SELECT *, {_profit_sql('win', 'odds')} AS profit FROM ({rows}) WHERE odds IS NOT NULL"


CTES = {
    "picks": _sql("lineitem", _PICK_STEPS),
    "picks_raw": f"SELECT {', '.join(_RAW)} FROM picks",
    "pick_history": f"SELECT {', '.join(PICK_HISTORY)} FROM picks",
    "graded": _graded_sql(),
    "games": _sql("orders", _GAME_STEPS),
    "boxscore": _sql("(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", _BOX_STEPS),
    "quotes": _sql("lineitem", _QUOTE_STEPS),
    "event_games": f"SELECT {', '.join(_EVENT_GAMES)} FROM orders",
    "lineups": f"SELECT {', '.join(_LINEUPS)} FROM lineitem",
    "team_runs": (
        "SELECT game_pk, team_id, CAST(sum(runs_scored) AS BIGINT) AS team_runs FROM boxscore"
        f" WHERE position_type IN {_BATTERS} GROUP BY 1, 2 HAVING sum(runs_scored) IS NOT NULL"
    ),
}
_NEEDS = {"picks_raw": ("picks",), "pick_history": ("picks",), "graded": ("picks", "picks_raw"), "team_runs": ("boxscore",)}


def with_tables(*names: str, extra: str = "") -> str:
    """WITH clause defining the named domain tables (and what they need)."""
    ordered: list[str] = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in ordered:
                ordered.append(need)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " "


def round_sql(value: str, digits: int = 2) -> str:
    return f"round({value} + sign({value}) * 1e-9, {digits})"


def roi_sql(
    win: str = "win", profit: str = "profit", clv: str | None = "clv", where: str | None = None, tag: str = ""
) -> str:
    """The return statistic as SQL aggregates."""
    f = f" FILTER (WHERE {where})" if where else ""
    n = f"count(*){f}"
    mean, sd = f"avg({profit}){f}", f"stddev_samp({profit}){f}"
    ci = f"1.96e0 * {sd} / sqrt({n})"
    out = (
        f"{n} AS n{tag}, {round_sql(f'(avg(CAST({win} AS INT)){f} * 100)', 1)} AS wr{tag}, "
        f"{round_sql(f'({mean} * 100)')} AS roi{tag}, {round_sql(f'(({mean} - {ci}) * 100)')} AS roi_lo{tag}, "
        f"{round_sql(f'(({mean} + {ci}) * 100)')} AS roi_hi{tag}"
    )
    if clv:
        out += f", {round_sql(f'avg({clv}){f}')} AS clv{tag}"
    return out


def gate_sql(mode: str = "official") -> str:
    if mode == "strict":
        return "(n >= 500 AND coalesce(roi_lo > 0, false))"
    return "(CASE WHEN n >= 500 THEN coalesce(roi > 0, false) ELSE coalesce(roi_lo > 0, false) END)"
