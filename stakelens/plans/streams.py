"""Streaming jobs drained over the given tables and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakelens.plans import adapters as a
from stakelens.plans.adapters import gate_sql, roi_sql, with_tables
from stakelens.plans.form import _elo_sql, _recursive
from stakelens.plans.ingest import _INTERVAL
from stakelens.plans.registry import query
from stakelens.session import work_path
from stakelens.streaming import jobs


@query("stream_dedup_ingest", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def q_stream_dedup_ingest(spark, sf):
    """The same feed delivered twice is stored once."""
    root = work_path(spark, "dedup")
    feed = jobs.file_stream(spark, f"{sf}/events.parquet")
    again = jobs.file_stream(spark, f"{sf}/events.parquet")
    jobs.dedup_ingest(feed.unionByName(again), "event_id", f"{root}/out", f"{root}/state")
    stored = spark.read.parquet(f"{root}/out")
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query(
    "stream_gate",
    with_tables("picks", extra=f"s AS (SELECT market, {roi_sql(clv=None)} FROM picks GROUP BY 1)")
    + f"SELECT *, {gate_sql()} AS passed FROM s",
)
def q_stream_gate(spark, sf):
    root = work_path(spark, "gate")
    picks = a._apply(jobs.file_stream(spark, f"{sf}/lineitem.parquet"), a._PICK_STEPS)
    jobs.running_gate(picks, ["market"], f"{root}/out", f"{root}/state")
    return jobs.newest_batch(spark, f"{root}/out")


@query(
    "stream_ratings",
    _recursive(with_tables("games", extra=_elo_sql()))
    + "SELECT game_pk, round(elo_home_pre, 6) AS elo_home_pre, round(elo_away_pre, 6) AS elo_away_pre FROM elo",
)
def q_stream_ratings(spark, sf):
    root = work_path(spark, "ratings")
    games = a._apply(jobs.file_stream(spark, f"{sf}/orders.parquet"), a._GAME_STEPS)
    jobs.ratings_stream(games, f"{root}/out", f"{root}/state")
    rated = jobs.rated_games(spark, f"{root}/out")
    return rated.select("game_pk", F.round("elo_home_pre", 6).alias("elo_home_pre"), F.round("elo_away_pre", 6).alias("elo_away_pre"))


@query(
    "stream_ledger",
    "SELECT count(*) AS loaded, max(ts) AS last_created, arg_max(event_id, (ts, event_id)) AS last_id FROM events",
)
def q_stream_ledger(spark, sf):
    root = work_path(spark, "ledger")
    jobs.ledger_stream(jobs.file_stream(spark, f"{sf}/events.parquet"), ["ts", "event_id"], f"{root}/out", f"{root}/state")
    ledger = spark.read.parquet(f"{root}/out/ledger")
    mark = F.max("watermark")
    return ledger.agg(F.sum("loaded").alias("loaded"), mark["ts"].alias("last_created"), mark["event_id"].alias("last_id"))


@query(
    "stream_silence",
    f"WITH b AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS job, ts, {_INTERVAL} AS interval_s, event_id FROM events), "
    "n AS (SELECT *, lead(ts) OVER (PARTITION BY job ORDER BY ts, interval_s, event_id) AS next_ts, max(ts) OVER () AS as_of FROM b) "
    "SELECT job, ts AS fired_at, ts + to_seconds(2 * interval_s) AS due_at FROM n WHERE interval_s IS NOT NULL AND "
    "CASE WHEN next_ts IS NULL THEN epoch_ms(as_of) > epoch_ms(ts + to_seconds(2 * interval_s)) "
    "ELSE next_ts > ts + to_seconds(2 * interval_s) END",
)
def q_stream_silence(spark, sf):
    """Silences of every job, told by a stream that keeps the last beat of each."""
    root = work_path(spark, "silence")
    beats = jobs.file_stream(spark, f"{sf}/events.parquet").selectExpr(
        "event_type || '-' || CAST(user_id AS STRING) AS job", "CAST(ts AS TIMESTAMP) AS fired_at", f"{_INTERVAL} AS interval_s"
    )
    jobs.silence_alerts(beats, f"{root}/out", f"{root}/state")
    told = spark.read.parquet(f"{root}/out")
    return told.select("job", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"), F.col("due_at").cast("timestamp_ntz").alias("due_at"))
