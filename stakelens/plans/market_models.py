"""A model for every market: point-in-time features, pick history, quote documents, and refits over seeds.

Every market of the catalogue or of the table gets a row; one with too few rows gets its state and no figures. Which markets
are fitted is one small row a market on the driver; the rows stay distributed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.functions.odds import decimal_to_american, implied_prob, unit_profit
from stakelens.functions.typing import cast_prefixed, not_flagged, prefixed, truthy, try_date, try_int
from stakelens.operators import gamelog as g
from stakelens.operators import models as m
from stakelens.operators.factors import coverage
from stakelens.operators.grading import both_sides, main_line
from stakelens.operators.splits import index_split
from stakelens.operators.validation import best_passing
from stakelens.plans import adapters as a
from stakelens.plans.form import PARK_FACTORS, feature_table
from stakelens.plans.grading import game_log, graded_props, typed_quotes
from stakelens.plans.ingest import _FLAT, _american, quote_docs
from stakelens.plans.registry import query
from stakelens.session import checkpointed, stored, table
from stakelens.sources import nested as ns

PIT = ["side_code", "market_prob", "elo_diff", "l10_diff", "fatigue_diff", *PARK_FACTORS]
#: boosting rounds of the registered queries; a parameter everywhere, figures in the README
ROUNDS = 10


def catalogue(spark, names) -> DataFrame:
    """One row for each market that a report must cover."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("market"))


def market_report(rows: DataFrame, states: DataFrame, features: dict[str, list[str]], rounds: int = ROUNDS) -> DataFrame:
    """States beside the figures of each fitted market: quality, the gate without a threshold, and the best threshold.

    Each fit is a distributed job over one market's rows; a few small ones run side by side.
    """
    sizes = {r["market"]: r["n_train"] for r in states.where("state = 'fitted'").select("market", "n_train").collect()}
    ready = sorted(market for market in sizes if features.get(market))

    def fit_one(market: str):
        return m.fit(rows.where((F.col("market") == market) & (F.col("part_no") == 0)), features[market], rounds=rounds)

    fitted = m.fit_all(rows.sparkSession, fit_one, ready, max(sizes.values(), default=0))
    held = rows.where("part_no = 1")
    tests = [m.scored(model, held.where(F.col("market") == name)).select(*_SCORED) for name, model in zip(ready, fitted)]
    none = held.where(F.lit(False)).withColumn("model_prob", F.lit(0.0)).select(*_SCORED)
    report = checkpointed(m.edge_report(stored(reduce(DataFrame.unionByName, tests, none), "scored"), ["market"]))
    plain = report.where("threshold = 0").select("market", F.col("passed").alias("passed_no_filter"))
    best = best_passing(report, ["market"], "threshold").drop("n_test")
    return states.join(best.withColumnRenamed("n", "n_bets"), "market", "left").join(plain, "market", "left")


_SCORED = ("market", *m.SCORED)


# ---- point-in-time features, eight markets ----

PIT_MARKETS = (
    "batter_hits", "batter_total_bases", "batter_rbis", "batter_home_runs", "pitcher_strikeouts", "h2h", "spreads", "totals",
)
_PIT_ROW = ("market", "game_pk", "side", "tie", "odds", "win", "profit")


def game_market_sides(spark, sf) -> DataFrame:
    """Moneyline (every quote), main spread and main total of games with both teams' runs; totals have two sides."""
    quotes = typed_quotes(spark, sf).where(F.col("game_pk").isNotNull())
    ties = ["book_id", "quote_ref", "slot"]
    cols = ["market_key", "game_pk", "line", "best_over_odds", "best_under_odds", *ties]
    lined = quotes.where(F.col("market_key").isin("spreads__away", "totals")).select(*cols)
    main = main_line(lined, ["market_key", "game_pk"], "best_over_odds", ties)
    every = quotes.where("market_key = 'h2h__away'").select(*cols).unionByName(main)
    runs = game_log(spark, sf).select("game_pk", "home_runs", "away_runs")
    scored = every.join(runs, "game_pk").withColumns(
        {"tie": F.concat_ws("|", *ties), "market": F.split("market_key", "__")[0], "stat": F.col("home_runs") + F.col("away_runs")}
    )
    totals = both_sides(scored.where("market = 'totals'"), "stat").select(*_PIT_ROW)
    away = F.col("away_runs") + F.when(F.col("market") == "spreads", F.col("line")).otherwise(F.lit(0.0))
    won = F.coalesce(away > F.col("home_runs"), F.lit(False))
    sided = scored.where("market <> 'totals' AND best_over_odds IS NOT NULL").withColumns(
        {"side": F.lit("away"), "odds": F.col("best_over_odds"), "win": won}
    )
    return totals.unionByName(sided.withColumn("profit", unit_profit("win", "odds")).select(*_PIT_ROW))


def prop_sides(spark, sf) -> DataFrame:
    """Both sides of each player's main line, all player markets."""
    ties = ["book_id", "quote_ref", "slot"]
    # a market has one role, so it splits no group, and the rows are grouped where the join has put them
    props = graded_props(spark, sf).select("market_key", "game_pk", "name_norm", "role", "line", "stat", "best_over_odds", "best_under_odds", *ties)
    main = main_line(props, ["market_key", "game_pk", "name_norm", "role"], "best_over_odds", ties).drop("role", *ties)
    return both_sides(stored(main, "main", tidy=True), "stat").withColumnsRenamed({"market_key": "market", "name_norm": "tie"}).select(*_PIT_ROW)


def with_features(sides: DataFrame, spark, sf) -> DataFrame:
    # features and sides are each made and kept first, so that their shuffle files are not on disk together
    joined = sides.join(stored(feature_table(spark, sf), "features", tidy=True), "game_pk")
    side = F.when(F.col("side") == "under", 1.0).otherwise(0.0)
    return joined.withColumns({"side_code": side, "market_prob": implied_prob("odds")})


@query("ml_market_pit")
def q_ml_market_pit(spark, sf):
    """All eight markets on nine point-in-time features; the last quarter of every year is held out."""
    sides = stored(with_features(prop_sides(spark, sf).unionByName(game_market_sides(spark, sf)), spark, sf), "sides", tidy=True)
    split = index_split(sides, ["market", "season"], "game_date", ["game_pk", "side", "tie"], [0.75])
    rows = m.model_rows(split, PIT, ["market"], apart=["market", "part_no"])
    states = checkpointed(m.market_states(rows, "market", catalogue(spark, PIT_MARKETS)))
    return market_report(rows, states, dict.fromkeys(PIT_MARKETS, PIT))


# ---- pick history: landed rows, factors kept by support, first three quarters against the rest ----

_HISTORY_TIES = ("event_id", "player_id", "book_id", "slot", "stake_ref")


def typed_history(raw: DataFrame) -> DataFrame:
    """Landed picks typed leniently; synthetic, void, ungraded, unpriced and undated ones are left out."""
    kept = raw.where(not_flagged("is_synthetic") & not_flagged("voided") & F.col("hit").isNotNull())
    typed = cast_prefixed(kept, "score_").withColumns(
        {"market": F.col("prop_type"), "odds": try_int("odds"), "game_date": try_date("game_date"), "win": truthy("hit")}
    )
    return typed.where("odds IS NOT NULL AND game_date IS NOT NULL").withColumn("profit", unit_profit("win", "odds"))


def history_states(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split rows, states, and (market, factor) pairs with enough support."""
    history = typed_history(a.pick_history(spark, sf))
    factors = prefixed(history, "score_")
    split = index_split(history, ["market"], "game_date", _HISTORY_TIES, [0.75])
    rows = m.model_rows(split, factors, ["market"], apart=["market", "part_no"])
    kept = checkpointed(coverage(rows, ["market"], factors).where("keep").select("market", "factor"))
    return rows, checkpointed(m.market_states(rows, "market", catalogue(spark, a.MARKETS), least_part=0)), kept


def _history_sql() -> str:
    barred = " OR ".join(a._flag_sql(c) for c in ("is_synthetic", "voided"))
    scores = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in a.FACTORS)
    kept = " + ".join(f"CAST(count({c}) >= greatest(200e0, count(*) * 0.05e0) AS INT)" for c in a.FACTORS)
    return a.with_tables("pick_history", extra=(
        f"h AS (SELECT prop_type AS market, TRY_CAST(odds AS INT) AS odds, TRY_CAST(game_date AS DATE) AS day, "
        f"{a._flag_sql('hit')} AS win, {', '.join(_HISTORY_TIES)}, {scores} FROM pick_history WHERE NOT ({barred}) AND hit IS NOT NULL), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY day, {', '.join(_HISTORY_TIES)}) - 1 AS i, "
        "count(*) OVER (PARTITION BY market) AS size FROM h WHERE odds IS NOT NULL AND day IS NOT NULL), "
        f"s AS (SELECT market, {_part_counts('size')}, {kept} AS factors FROM r GROUP BY 1), "
        f"cat AS (SELECT unnest({list(a.MARKETS)!r}) AS market)"
    )) + _states_sql("factors", least_part=0)


def _part_counts(size: str) -> str:
    test = f"i >= floor({size} * 0.75e0)"
    return (
        f"count(*) AS n, count(*) FILTER (WHERE NOT ({test})) AS n_train, count(*) FILTER (WHERE {test}) AS n_test, "
        f"count(*) FILTER (WHERE win AND NOT ({test})) AS wins_train, count(*) FILTER (WHERE win AND {test}) AS wins_test"
    )


def _states_sql(*more: str, least_part: int = 50) -> str:
    """Sizes and state of every market of ``cat`` or of ``s``."""
    names = ("n", "n_train", "n_test", "wins_train", "wins_test", *more)
    sizes = ", ".join(f"coalesce({c}, 0) AS {c}" for c in names)
    return (
        f"SELECT *, CASE WHEN n < 500 THEN 'insufficient data' WHEN n_train < {least_part} OR n_test < {least_part} "
        "THEN 'insufficient data after split' WHEN wins_train IN (0, n_train) THEN 'one outcome only' ELSE 'fitted' END AS state "
        f"FROM (SELECT market, {sizes} FROM cat FULL JOIN s USING (market))"
    )


@query("ml_pick_history_states", _history_sql())
def q_ml_pick_history_states(spark, sf):
    """Split sizes, wins, supported factors and state of every market's pick history."""
    _, states, kept = history_states(spark, sf)
    counted = kept.groupBy("market").agg(F.count(F.lit(1)).cast("int").alias("factors"))
    return states.join(counted, "market", "left").withColumn("factors", F.coalesce("factors", F.lit(0)))


@query("ml_pick_history")
def q_ml_pick_history(spark, sf):
    """A model on the supported factors of each market's landed pick history, 75/25 by date."""
    rows, states, kept = history_states(spark, sf)
    supported: dict[str, list[str]] = {}
    for r in kept.orderBy("market", "factor").collect():
        supported.setdefault(r["market"], []).append(r["factor"])
    return market_report(rows, states, supported)


# ---- quote documents: consensus line and best price of each player, two sides, features, 75/25 by date ----

# recorded outs of a player in a game, from the same rows as the quotes
_OUTS_BOX = (
    "SELECT l_orderkey AS game_pk, 'Player ' || CAST(l_linenumber % 3 AS STRING) AS player_name, 'pitcher_outs' AS market, "
    "CAST(min(CAST(l_quantity AS INT)) % 4 AS INT) AS stat FROM {source} "
    "GROUP BY l_orderkey, l_linenumber % 3 HAVING min(l_suppkey) % 7 > 0"
)


def quote_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(quoted markets, priced sides with a result) of all quote documents."""
    flat = ns.flatten_quotes(ns.parse(quote_docs(spark, sf), "doc", ns.QUOTE_DOC)).withColumnRenamed("market_key", "market")
    best = stored(ns.consensus(flat, ["market", "event_id", "game_pk", "player_name"]), "consensus", tidy=True)
    priced = best.withColumns({f"{s}_odds": decimal_to_american(f"best_{s}") for s in ("over", "under")})
    outs = spark.sql(_OUTS_BOX.format(source="{lines}"), lines=table(spark, sf, "lineitem"))
    sides = both_sides(priced.join(outs, ["market", "game_pk", "player_name"]), "stat", "over_odds", "under_odds")
    return best.select("market").distinct(), sides.withColumn("tie", F.col("player_name")).select(*_PIT_ROW)


def quote_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    markets, sides = quote_sides(spark, sf)
    priced = stored(with_features(sides, spark, sf), "sides", tidy=True)
    split = index_split(priced, ["market"], "game_date", ["game_pk", "side", "tie"], [0.75])
    rows = m.model_rows(split, PIT, ["market"], apart=["part_no"])
    return rows, checkpointed(m.market_states(rows, "market", markets))


@query(
    "ml_quote_market_states",
    _FLAT + ", c AS (SELECT game_pk, player_name, point, count(*) AS k, max(price) FILTER (WHERE side = 'over') AS best_over, "
    "max(price) FILTER (WHERE side = 'under') AS best_under FROM flat GROUP BY 1, 2, 3), "
    "b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY game_pk, player_name ORDER BY k DESC, point) = 1), "
    f"outs AS ({_OUTS_BOX.format(source='lineitem')}), "
    f"p AS (SELECT b.*, stat, {_american('best_over')} AS over_odds, {_american('best_under')} AS under_odds FROM b "
    "JOIN outs USING (game_pk, player_name)), "
    "two AS (SELECT game_pk, player_name, 'over' AS side, over_odds AS odds, stat > point AS win FROM p UNION ALL "
    "SELECT game_pk, player_name, 'under', under_odds, stat < point FROM p), "
    "r AS (SELECT 'pitcher_outs' AS market, win, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), game_pk, side, player_name) - 1 AS i, "
    "count(*) OVER () AS size FROM two JOIN orders ON o_orderkey = game_pk WHERE odds IS NOT NULL), "
    f"s AS (SELECT market, {_part_counts('size')} FROM r GROUP BY 1), "
    "cat AS (SELECT unnest(['pitcher_outs', 'h2h']) AS market) "
    + _states_sql(),
)
def q_ml_quote_market_states(spark, sf):
    """Split sizes, wins and state of every market in the quote documents."""
    return quote_rows(spark, sf)[1]


@query("ml_quote_market")
def q_ml_quote_market(spark, sf):
    """A model of each market in the quote documents on point-in-time features."""
    rows, states = quote_rows(spark, sf)
    return market_report(rows, states, {r["market"]: PIT for r in states.select("market").collect()})


# ---- refits over seeds ----

SEEDS = (0, 1, 2, 3, 4)
# fixed values: thousandths at which a Poisson(1) count steps up
_POISSON_STEPS = (368, 736, 920, 981, 996)


def seed_weight(seed: int) -> str:
    """Resampling weight of a pick in one refit; depends on the pick and the seed alone."""
    u = f"((event_id * 7919 + player_id * 104729 + slot * 1299709 + book_id * 613 + {seed} * 15485863) % 1000)"
    return " + ".join(f"CAST({u} >= {step} AS INT)" for step in _POISSON_STEPS)


def seeded_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    """Picks split by year, their factors, and a weight column for each seed."""
    picks = a.picks(spark, sf)
    features = [*prefixed(picks, "score_"), "market_prob"]
    split = index_split(picks, ["market", "season"], "game_date", a.PICK_TIES, [0.75])
    weights = {f"weight_{s}": F.expr(seed_weight(s)) for s in SEEDS}
    rows = split.withColumn("market_prob", implied_prob("odds")).withColumns(weights)
    return m.model_rows(rows, features, ["market", *weights], apart=["part_no"]), features


@query(
    "ml_seed_weights",
    a.with_tables("picks", extra=f"r AS (SELECT *, row_number() OVER (PARTITION BY market, season ORDER BY game_date, "
    f"{', '.join(a.PICK_TIES)}) - 1 AS i, count(*) OVER (PARTITION BY market, season) AS size FROM picks)")
    + " UNION ALL ".join(
        f"SELECT {s} AS seed, count(*) AS n_train, CAST(sum({seed_weight(s)}) AS BIGINT) AS weight, "
        f"count(*) FILTER (WHERE ({seed_weight(s)}) = 0) AS left_out, CAST(sum(CASE WHEN win THEN {seed_weight(s)} ELSE 0 END) AS BIGINT) AS wins "
        "FROM r WHERE i < floor(size * 0.75e0)" for s in SEEDS),
)
def q_ml_seed_weights(spark, sf):
    """Training rows, weight and weighted wins of each refit, all seeds in one pass."""
    rows, _ = seeded_rows(spark, sf)
    sums = rows.where("part_no = 0").agg(
        F.count(F.lit(1)).alias("n_train"),
        *[F.sum(f"weight_{s}").alias(f"w_{s}") for s in SEEDS],
        *[F.count_if(F.col(f"weight_{s}") == 0).alias(f"o_{s}") for s in SEEDS],
        *[F.sum(F.when(F.col("win"), F.col(f"weight_{s}")).otherwise(0)).alias(f"y_{s}") for s in SEEDS],
    )
    entries = [
        F.struct(F.lit(s).alias("seed"), F.col(f"w_{s}").alias("weight"), F.col(f"o_{s}").alias("left_out"), F.col(f"y_{s}").alias("wins"))
        for s in SEEDS
    ]
    return sums.select("n_train", F.inline(F.array(*entries)))


@query("ml_seed_refits")
def q_ml_seed_refits(spark, sf):
    """Spread over refits: the same split, another resampling and another seed each; ``split_verdict`` tells that they disagree."""
    rows, features = seeded_rows(spark, sf)
    train, test = rows.where("part_no = 0"), rows.where("part_no = 1")
    weights = {s: f"weight_{s}" for s in SEEDS}
    # one fold for all refits: what differs between them is the weight of each cell
    inputs, n = m.inputs_of(train, features, fold=True)
    cells = m.folded(train, inputs, list(weights.values()))

    def fit_one(seed: int):
        some = m.packed(cells.where(F.col(weights[seed]) > 0), n)
        return m.Fitted(inputs, m.boosted_trees(seed, ROUNDS, weight=weights[seed]).fit(some))

    fitted = m.fit_all(spark, fit_one, SEEDS, cells.count())
    for seed, model in zip(SEEDS, fitted):
        test = m.scored(model, test, f"prob_{seed}")
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"prob_{s}").alias("model_prob")) for s in SEEDS])
    probs = [f"prob_{s}" for s in SEEDS]
    long = stored(test.select("market", "odds", "win", "profit", *probs), "scored").select("market", "odds", "win", "profit", F.inline(runs))
    report = m.edge_report(long, ["market", "seed"]).where("threshold = 0")
    spread = report.groupBy("market").agg(
        F.count(F.lit(1)).alias("runs"),
        *[f(c).alias(f"{n}_{c}") for c in ("auc", "roi") for n, f in (("min", F.min), ("max", F.max))],
        F.round(F.avg("auc"), 4).alias("avg_auc"),
        F.min("n").alias("min_bets"), F.max("n").alias("max_bets"), F.count_if("passed").alias("passes"),
    )
    return spread.withColumn("split_verdict", (F.col("passes") > 0) & (F.col("passes") < F.col("runs")))
