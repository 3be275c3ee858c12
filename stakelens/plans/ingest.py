"""Nested documents, text files, incremental loads and operations checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.functions.odds import decimal_to_american
from stakelens.sources import files as fs
from stakelens.sources import nested as ns
from stakelens.plans import adapters as a
from stakelens.plans.adapters import with_tables
from stakelens.plans.registry import query
from stakelens.session import table, work_path

# one response document per line item: a book's two-sided quote beside an unrelated market
_DOC_BASE = [
    "'ev' || CAST(l_orderkey AS STRING) AS event_id", "l_orderkey AS game_pk",
    "CAST(CAST(l_shipdate AS DATE) AS STRING) AS game_date",
    "'book_' || CAST(l_suppkey AS STRING) AS book",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE 'Player ' || CAST(l_linenumber % 3 AS STRING) END AS player",
    "l_partkey % 2 + 0.5e0 AS point",
    "CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE 1e0 + (1 + l_suppkey % 30) / 8e0 END AS over_price",
    "CASE WHEN l_partkey % 33 = 0 THEN NULL ELSE 1e0 + (1 + l_partkey % 30) / 8e0 END AS under_price",
    "CASE WHEN l_discount = 0.03e0 AND l_tax >= 0.05e0 THEN 'quota' END AS failed",
    "l_tax = 0.01e0 AS no_books", "l_extendedprice AS fetched",
]
_QUOTE_JSON = (
    "to_json(named_struct('event_id', event_id, 'game_pk', game_pk, 'game_date', game_date, 'snapshot_iso', game_date, "
    "'response', named_struct('error', failed, 'data', named_struct('commence_time', game_date, 'bookmakers', "
    "CASE WHEN no_books OR failed IS NOT NULL THEN slice(array(named_struct('key', book, 'markets', MKT)), 1, 0) "
    "ELSE array(named_struct('key', book, 'markets', MKT)) END)))) AS doc"
).replace(
    "MKT",
    "array(named_struct('key', 'pitcher_outs', 'outcomes', array("
    "named_struct('name', 'Over', 'description', player, 'point', point, 'price', over_price), "
    "named_struct('name', 'Under', 'description', player, 'point', point, 'price', under_price))), "
    "named_struct('key', 'h2h', 'outcomes', array(named_struct('name', 'Home', 'description', 'team', "
    "'point', 0e0, 'price', 1.9e0))))",
)
_FLAT = (
    f"WITH d AS (SELECT {', '.join(_DOC_BASE)} FROM lineitem), "
    "ok AS (SELECT * FROM d WHERE failed IS NULL AND NOT no_books AND player IS NOT NULL), "
    "flat AS (SELECT event_id, game_pk, book, player AS player_name, 'over' AS side, point, over_price AS price FROM ok "
    "WHERE over_price IS NOT NULL UNION ALL SELECT event_id, game_pk, book, player, 'under', point, under_price FROM ok "
    "WHERE under_price IS NOT NULL)"
)


def quote_docs(spark, sf) -> DataFrame:
    """Response documents as JSON text."""
    return table(spark, sf, "lineitem").selectExpr(*_DOC_BASE).selectExpr(_QUOTE_JSON)


def flat_quotes(spark, sf) -> DataFrame:
    return ns.flatten_quotes(ns.parse(quote_docs(spark, sf), "doc", ns.QUOTE_DOC), "pitcher_outs")


@query(
    "json_flatten_quotes",
    _FLAT + " SELECT * FROM flat",
)
def q_json_flatten_quotes(spark, sf):
    return flat_quotes(spark, sf).select("event_id", "game_pk", "book", "player_name", "side", "point", "price")


_CONSENSUS = (
    _FLAT + ", c AS (SELECT event_id, player_name, point, count(*) AS k FROM flat GROUP BY 1, 2, 3), "
    "m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_id, player_name ORDER BY k DESC, point) = 1)"
)


@query("consensus_line", _CONSENSUS + " SELECT event_id, player_name, point AS line FROM m")
def q_consensus_line(spark, sf):
    return ns.consensus(flat_quotes(spark, sf), ["event_id", "player_name"]).select("event_id", "player_name", "line")


def _american(p: str) -> str:
    return (
        f"CAST(CASE WHEN {p} IS NULL OR {p} <= 1 THEN NULL WHEN {p} >= 2 THEN round_even(({p} - 1) * 100, 0) "
        f"ELSE round_even(-100e0 / ({p} - 1), 0) END AS INT)"
    )


@query(
    "best_price",
    _CONSENSUS + ", b AS (SELECT f.event_id, f.player_name, f.point AS line, max(price) FILTER (WHERE side = 'over') "
    "AS best_over, max(price) FILTER (WHERE side = 'under') AS best_under FROM flat f JOIN m ON f.event_id = m.event_id "
    "AND f.player_name = m.player_name AND f.point = m.point GROUP BY 1, 2, 3) "
    f"SELECT *, {_american('best_over')} AS over_american, {_american('best_under')} AS under_american FROM b",
)
def q_best_price(spark, sf):
    best = ns.consensus(flat_quotes(spark, sf), ["event_id", "player_name"])
    return best.withColumns(
        {"over_american": decimal_to_american("best_over"), "under_american": decimal_to_american("best_under")}
    )


# one box-score document per line item, with the player under one of the two teams
_BOX_BASE = [
    "l_orderkey AS game_pk", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS game_date", "l_partkey AS player_id",
    "'Player ' || CAST(l_partkey AS STRING) AS full_name", "l_suppkey % 2 = 0 AS at_home",
    "CASE WHEN l_linenumber = 1 THEN 'Pitcher' ELSE 'Infielder' END AS position_type",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber * 100 + l_partkey % 2 AS STRING) END AS batting_order",
    "l_linenumber > 1 AND l_partkey % 11 > 0 AS batted", "l_linenumber = 1 AND l_partkey % 11 > 0 AS pitched",
    "CAST(CAST(l_quantity AS INT) % 4 AS INT) AS hits", "CAST(l_partkey % 2 AS INT) AS started",
    "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS INT) END AS pitches_a",
    "CAST(l_quantity AS INT) AS pitches_b", "l_suppkey AS entry_key",
]
_PLAYERS = (
    "map('ID' || CAST(player_id AS STRING), named_struct('person', named_struct('id', player_id, 'fullName', full_name), "
    "'position', named_struct('type', position_type), 'battingOrder', batting_order, 'stats', named_struct("
    "'batting', CASE WHEN batted THEN named_struct('hits', hits, 'homeRuns', 0, 'totalBases', hits, 'rbi', 1, 'runs', 0) END, "
    "'pitching', CASE WHEN pitched THEN named_struct('gamesStarted', started, 'numberOfPitches', pitches_a, "
    "'pitchesThrown', pitches_b, 'inningsPitched', '5.1', 'strikeOuts', hits, 'earnedRuns', 2) END)))"
)
_BOX_JSON = (
    "to_json(named_struct('game_pk', game_pk, 'game_date', game_date, 'teams', named_struct("
    f"'home', named_struct('team', named_struct('id', 1L), 'players', CASE WHEN at_home THEN {_PLAYERS} END), "
    f"'away', named_struct('team', named_struct('id', 2L), 'players', CASE WHEN NOT at_home THEN {_PLAYERS} END)))) AS doc"
)


@query(
    "json_map_flatten",
    f"WITH d AS (SELECT {', '.join(_BOX_BASE)} FROM lineitem) SELECT player_id, game_pk, CAST(game_date AS DATE) AS game_date, "
    "CAST(CASE WHEN at_home THEN 1 ELSE 2 END AS BIGINT) AS team_id, full_name AS player_name, position_type, "
    "(pitched AND started = 1) OR (batted AND coalesce(CAST(batting_order AS INT) % 100 = 0, false)) AS is_starter, "
    "CAST(CAST(batting_order AS INT) // 100 AS INT) AS batting_order_slot, CASE WHEN batted THEN hits END AS hits, "
    "CASE WHEN pitched THEN coalesce(nullif(pitches_a, 0), pitches_b) END AS pitches_thrown FROM d WHERE batted OR pitched",
)
def q_json_map_flatten(spark, sf):
    docs = table(spark, sf, "lineitem").selectExpr(*_BOX_BASE).selectExpr(_BOX_JSON)
    return ns.flatten_boxscores(ns.parse(docs, "doc", ns.BOX_DOC)).select(
        "player_id", "game_pk", "game_date", "team_id", "player_name", "position_type", "is_starter",
        "batting_order_slot", "hits", "pitches_thrown",
    )


_SCHEDULED = (
    "named_struct('gamePk', game_pk, 'gameType', CASE WHEN status = 'P' THEN 'S' ELSE 'R' END, 'gameDate', "
    "CAST(game_date AS STRING) || 'T23:00:00Z', 'teams', named_struct('home', named_struct('team', named_struct('name', "
    "CAST(home_team AS STRING))), 'away', named_struct('team', named_struct('name', CAST(away_team AS STRING)))))"
)
_EXHIBITION = (
    "named_struct('gamePk', -game_pk - 1, 'gameType', 'E', 'gameDate', '', 'teams', named_struct('home', "
    "named_struct('team', named_struct('name', '')), 'away', named_struct('team', named_struct('name', ''))))"
)
_SCHEDULE_JSON = (
    "to_json(named_struct('dates', array(named_struct('date', CAST(game_date AS STRING), 'games', "
    f"array({_SCHEDULED}, {_SCHEDULED}, {_EXHIBITION}))))) AS doc"
)


@query(
    "json_schedule_flatten",
    with_tables("games")
    + "SELECT game_pk, CAST(game_date AS VARCHAR) AS game_date, CAST(home_team AS VARCHAR) AS home_team, "
    "CAST(away_team AS VARCHAR) AS away_team, CAST(game_date AS VARCHAR) || 'T23:00:00Z' AS commence_time_utc "
    "FROM games WHERE status <> 'P'",
)
def q_json_schedule_flatten(spark, sf):
    docs = a.games(spark, sf).selectExpr(_SCHEDULE_JSON)
    return ns.flatten_schedule(ns.parse(docs, "doc", ns.SCHEDULE_DOC))


@query(
    "src_jsonl_docs",
    f"WITH d AS (SELECT {', '.join(_DOC_BASE)} FROM lineitem) SELECT game_date, count(*) AS docs, "
    "count(DISTINCT event_id) AS events FROM d WHERE failed IS NULL AND NOT no_books GROUP BY 1",
)
def q_src_jsonl_docs(spark, sf):
    """Documents written as JSON lines and scanned back with a declared schema."""
    path = work_path(spark, "jsonl")
    quote_docs(spark, sf).write.option("compression", "gzip").text(path)
    usable = ns.usable_quotes(fs.read_jsonl(spark, path, ns.QUOTE_DOC))
    return usable.groupBy("game_date").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("event_id").alias("events"))


@query(
    "cache_latest_per_key",
    f"WITH d AS (SELECT {', '.join(_DOC_BASE)} FROM lineitem) SELECT event_id, game_date, fetched, book FROM d "
    "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY game_date DESC, fetched DESC, book DESC) = 1",
)
def q_cache_latest_per_key(spark, sf):
    """Append-only cache reloaded as the last record per event."""
    path = work_path(spark, "cache")
    cache = table(spark, sf, "lineitem").selectExpr(*_DOC_BASE).select("event_id", "game_date", "fetched", "book")
    cache.write.json(path)
    schema = "event_id string, game_date string, fetched double, book string"
    return fs.latest_per_key(fs.read_jsonl(spark, path, schema), ["event_id"], ["game_date", "fetched", "book"])


# sectioned export: even files name the fields in another order and carry one more field
_PLAIN = ["event_id", "player_id", "pick_side", "line", "entry_odds", "confidence", "hit"]
_SHUFFLED = ["event_id", "hit", "confidence", "note", "entry_odds", "line", "pick_side", "player_id"]
_EXPORT = [
    "CAST(event_id AS STRING) AS event_id", "CAST(player_id AS STRING) AS player_id", "side AS pick_side",
    "CAST(line AS STRING) AS line", "CAST(odds AS STRING) AS entry_odds", "CAST(confidence AS STRING) AS confidence",
    "CASE WHEN win THEN 'true' ELSE 'false' END AS hit", "'\"a, quoted \"\"note\"\"\"' AS note",
    "market || '_' || CAST(season AS STRING) AS export", "season", "event_id % 8 AS part_key",
]


def _write_sections(spark, sf, path: str) -> None:
    rows = a.picks(spark, sf).selectExpr(*_EXPORT)
    odd = F.col("season") % 2 == 1

    def line(kind: str, names: list[str]):
        return F.concat_ws(",", F.lit(kind), *[F.col(n) if kind == "picks" else F.lit(n) for n in names])

    data = rows.select(
        "export", "part_key", F.lit(1).alias("n"), F.when(odd, line("picks", _PLAIN)).otherwise(line("picks", _SHUFFLED)).alias("value")
    )
    heads = rows.groupBy("export", "part_key", "season").agg(F.count(F.lit(1)).alias("n")).select(
        "export", "part_key", F.lit(0).alias("n"),
        F.explode(F.array(
            F.when(odd, line("section", _PLAIN)).otherwise(line("section", _SHUFFLED)), F.lit("summary,total,1")
        )).alias("value"),
    )
    both = data.unionByName(heads).repartition("export", "part_key")
    ordered = both.sortWithinPartitions("export", "part_key", "n", F.desc("value"))
    ordered.select("export", "part_key", "value").write.partitionBy("export", "part_key").text(path)


@query(
    "src_sectioned_csv",
    with_tables("picks", extra=f"e AS (SELECT {', '.join(_EXPORT)} FROM picks)")
    + "SELECT export, event_id, player_id, pick_side, line, entry_odds, confidence, hit, "
    "CASE WHEN season % 2 = 0 THEN 'a, quoted \"note\"' END AS note FROM e",
)
def q_src_sectioned_csv(spark, sf):
    path = work_path(spark, "sections")
    _write_sections(spark, sf, path)
    rows = fs.read_sectioned(spark, f"{path}/*/*", [*_PLAIN, "note"])
    return rows.withColumn("export", F.regexp_extract("file", "export=([^/]+)/", 1)).drop("file")


@query(
    "src_bronze_allstring",
    with_tables("quotes")
    + "SELECT CAST(season AS INT) AS season, market_key, count(*) AS n, count(TRY_CAST(best_over_odds AS INT)) AS with_over, "
    "CAST(sum(TRY_CAST(best_under_odds AS INT)) AS BIGINT) AS under_sum FROM quotes WHERE season >= '1999' GROUP BY 1, 2",
)
def q_src_bronze_allstring(spark, sf):
    """All-text landing table by season, read back with partition pruning and typed at the end."""
    path = work_path(spark, "landing")
    columns = ["event_id", "market_key", "line", "best_over_odds", "best_under_odds"]
    fs.write_landing(a.quotes(spark, sf).select(*columns, "season"), path, "season")
    landed = fs.read_landing(spark, path, columns, "season").where(F.col("season") >= "1999")
    return landed.groupBy(F.col("season").try_cast("int").alias("season"), "market_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.col("best_over_odds").try_cast("int")).alias("with_over"),
        F.sum(F.col("best_under_odds").try_cast("int")).alias("under_sum"),
    )


@query(
    "src_tagged_union",
    with_tables("games")
    + "SELECT season, count(*) AS games, CAST(sum(home_score) AS BIGINT) AS home_runs, min(game_date) AS first_day, "
    "max(game_date) AS last_day FROM games GROUP BY 1",
)
def q_src_tagged_union(spark, sf):
    """One file set per season, the season known only from its place, read as one table."""
    path = work_path(spark, "seasons")
    games = a.games(spark, sf).select("game_pk", "game_date", "home_score", "season")
    games.withColumn("yr", F.col("season")).drop("season").write.partitionBy("yr").parquet(path)
    years = [r[0] for r in games.select("season").distinct().orderBy("season").collect()]
    union = fs.read_seasons(spark, {y: f"{path}/yr={y}" for y in years})
    return union.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.sum("home_score").alias("home_runs"),
        F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"),
    )


_WATERMARK = ("2024-01-15 12:00:00", 4_000)


@query(
    "incr_keyset_pull",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, "
    "CAST(user_id AS VARCHAR) AS user_id, event_type FROM events "
    f"WHERE (ts, event_id) > (TIMESTAMP '{_WATERMARK[0]}', {_WATERMARK[1]})",
)
def q_incr_keyset_pull(spark, sf):
    events = table(spark, sf, "events")
    mark = [F.lit(_WATERMARK[0]).cast("timestamp_ntz"), F.lit(_WATERMARK[1]).cast("long")]
    fresh = fs.keyset_after(events, ["ts", "event_id"], mark)
    fresh = fresh.withColumn("created_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return fs.all_text(fresh.select("event_id", "created_at", "user_id", "event_type"))


@query("incr_antijoin_append", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1")
def q_incr_antijoin_append(spark, sf):
    """Two overlapping loads; the second appends only the keys the first did not bring."""
    path = work_path(spark, "append")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    events.where("event_type IN ('view', 'click', 'purchase')").write.parquet(path)
    fs.append_new(events.where("event_type <> 'view'"), path, ["event_id"])
    loaded = spark.read.parquet(path)
    return loaded.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("keys"))


@query(
    "compact_copy",
    "SELECT 'documents' AS tbl, count(*) AS n, 4 AS columns FROM documents UNION ALL "
    "SELECT 'pages', count(*), 2 FROM pages UNION ALL SELECT 'conversations', count(*), 3 FROM conversations",
)
def q_compact_copy(spark, sf):
    drops = {"documents": ["text"], "pages": ["html"], "conversations": ["text"]}
    root, counts = work_path(spark, "compact"), []
    for name, drop in drops.items():
        copy = fs.compact_copy(table(spark, sf, name), f"{root}/{name}", drop)
        counts.append(copy.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"), F.lit(len(copy.columns)).alias("columns")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# expected firing interval of a job, seconds; some jobs have none
_INTERVAL = "CASE WHEN user_id % 9 = 0 THEN NULL ELSE CAST(3600 * (1 + user_id % 12) AS INT) END"


def silent_jobs(beats: DataFrame, as_of) -> DataFrame:
    """Latest beat per job; silent once more than twice the expected interval has passed."""
    last = beats.groupBy("job").agg(F.max("fired_at").alias("last_fired_at"), F.max("interval_s").alias("interval_s"))
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_fired_at").cast("timestamp"))
    elapsed = F.floor(seconds / 1_000_000).cast("long")
    late = F.coalesce(seconds > F.col("interval_s").cast("long") * 2_000_000, F.lit(False))
    return last.select("job", "last_fired_at", "interval_s", elapsed.alias("elapsed_s"), late.alias("silent"))


@query(
    "heartbeat_silent",
    f"WITH b AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS job, ts, {_INTERVAL} AS interval_s FROM events), "
    "n AS (SELECT max(ts) AS as_of FROM events), l AS (SELECT job, max(ts) AS last_fired_at, max(interval_s) AS interval_s "
    "FROM b GROUP BY 1), e AS (SELECT l.*, epoch_us(as_of) - epoch_us(last_fired_at) AS us FROM l, n) "
    "SELECT job, last_fired_at, interval_s, us // 1000000 AS elapsed_s, "
    "coalesce(us > CAST(interval_s AS BIGINT) * 2000000, false) AS silent FROM e",
)
def q_heartbeat_silent(spark, sf):
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    beats = events.selectExpr(
        "event_type || '-' || CAST(user_id AS STRING) AS job", "ts AS fired_at", f"{_INTERVAL} AS interval_s"
    )
    return silent_jobs(beats, as_of)


@query(
    "ops_freshness",
    "WITH n AS (SELECT max(ts) AS as_of FROM events) SELECT event_type, count(*) AS n, max(ts) AS latest FROM events, n "
    "WHERE ts >= as_of - INTERVAL 2 DAYS GROUP BY 1",
)
def q_ops_freshness(spark, sf):
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    recent = events.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAYS"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query(
    "ops_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def q_ops_duplicates(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "market_census",
    with_tables("quotes")
    + "SELECT market_key, count(*) AS n, count(DISTINCT event_id) AS events, min(quote_date) AS first_day, "
    "max(quote_date) AS last_day FROM quotes GROUP BY 1",
)
def q_market_census(spark, sf):
    return (
        a.quotes(spark, sf)
        .groupBy("market_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("event_id").alias("events"),
            F.min("quote_date").alias("first_day"),
            F.max("quote_date").alias("last_day"),
        )
    )
