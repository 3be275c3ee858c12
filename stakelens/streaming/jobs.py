"""Structured Streaming versions of the incremental jobs.

Each job is a plain stream with a checkpoint and a file sink; run with
``available_now`` it drains what is there and stops, and its result equals the
batch operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.operators.ratings import advance
from stakelens.operators.stats import gate_pass, moments, stats_from_moments


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet folder (or file) as a stream; schema taken from its footer.

    The last letter is written as a pattern: a stream over a single file is only allowed by pattern.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def available_now(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state on disk, saved as the changes of each batch, for the streams started within."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup_ingest(stream: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Append each key once, however late it comes.

    The keys seen are the stream's own keyed state, without a watermark, so none is forgotten; a batch looks up its own keys and
    reads no earlier batch. Each batch writes its own numbered folder, so a retried batch overwrites itself.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _rocksdb(stream.sparkSession):
        available_now(stream.dropDuplicates([key]).writeStream.outputMode("append").foreachBatch(load), checkpoint)


def newest_batch(spark: SparkSession, out: str) -> DataFrame:
    """The last complete result of a job that publishes a whole result with each batch."""
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def running_gate(picks: DataFrame, by: list[str], out: str, checkpoint: str) -> None:
    """Keep the statistic and verdict of every group current as picks are graded."""
    running = moments(picks, by, clv=None)

    def publish(batch: DataFrame, batch_id: int) -> None:
        stats = batch.select(*by, *stats_from_moments(clv=False)).withColumn("passed", gate_pass())
        stats.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    available_now(running.writeStream.outputMode("complete").foreachBatch(publish), checkpoint)


def ratings_stream(games: DataFrame, out: str, checkpoint: str) -> None:
    """Ratings carried from batch to batch, whatever the order in which games arrive.

    Every batch leaves a version of the standings of all leagues and notes, for each league, up to which day each version that still
    holds has rated it. A batch continues each of its leagues from the last version that ends before the league's first
    game in the batch; the league's stored games of later versions are played again with it, and those versions no longer hold for
    that league. In order, that is the version of the batch before and nothing is repeated. Batch n writes only its own
    numbered folders, so a retried batch overwrites itself. ``rated_games`` reads the latest rating of each game.
    """

    def play(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def versions(kind: str, which: Iterable[int]) -> DataFrame:
            return spark.read.option("basePath", f"{out}/{kind}").parquet(*[f"{out}/{kind}/batch={i}" for i in which])

        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        rows = versions("rows", [batch_id]).drop("batch")
        first = rows.groupBy("league").agg(F.min("game_date").alias("first_day"))
        replay, known, held = rows, None, None
        if batch_id > 0:
            held = versions("held", [batch_id - 1]).drop("batch")
            start = first.join(held.where("version >= 0"), "league", "left").groupBy("league").agg(
                F.max(F.when(F.col("rated_to") < F.col("first_day"), F.col("version"))).alias("start"),
                F.max("version").alias("newest"),
            )
            start = start.withColumn("start", F.coalesce("start", F.lit(-1)))
            path = f"{out}/start/batch={batch_id}"
            start.write.mode("overwrite").parquet(path)
            start = spark.read.parquet(path)
            rewound = start.where("newest > start")
            oldest = rewound.agg(F.min("start")).first()[0]
            if oldest is not None:
                again = versions("rows", range(oldest + 1, batch_id)).join(rewound, "league").where("batch > start")
                replay = rows.unionByName(again.select(*rows.columns))
            # a league starts from its own version; leagues without games in this batch keep theirs
            current = versions("standings", [batch_id - 1]).join(start, "league", "left").where("start IS NULL OR start = batch")
            known = current.select("league", "season", "team", "rating")
            for at in [r.start for r in start.where(f"start >= 0 AND start < {batch_id - 1}").select("start").distinct().collect()]:
                older = versions("standings", [at]).join(start.where(F.col("start") == at), "league", "left_semi")
                known = known.unionByName(older.select(*known.columns))
            held = held.join(start.select("league", "start"), "league", "left").where("start IS NULL OR version <= start").drop("start")
        walked_path = f"{out}/walked/batch={batch_id}"
        advance(replay, known).write.mode("overwrite").parquet(walked_path)
        walked = spark.read.parquet(walked_path)
        standings = walked.where(F.col("team").isNotNull()).select("league", "season", "team", "rating")
        standings.write.mode("overwrite").parquet(f"{out}/standings/batch={batch_id}")
        played = walked.where(F.col("team").isNull()).select("league", "game_pk", "elo_home_pre", "elo_away_pre")
        played.write.mode("overwrite").parquet(f"{out}/games/batch={batch_id}")
        now = replay.groupBy("league").agg(F.lit(batch_id).alias("version"), F.max("game_date").alias("rated_to"))
        held = now if held is None else held.unionByName(now)
        held.write.mode("overwrite").parquet(f"{out}/held/batch={batch_id}")

    available_now(games.writeStream.outputMode("append").foreachBatch(play), checkpoint)


def rated_games(spark: SparkSession, out: str) -> DataFrame:
    """The latest rating of each game; a game that was played again counts once."""
    rated = spark.read.parquet(f"{out}/games")
    last = rated.groupBy("league", "game_pk").agg(F.max_by(F.struct("elo_home_pre", "elo_away_pre"), "batch").alias("_r"))
    return last.select("league", "game_pk", "_r.*")


def ledger_stream(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Append rows and a ledger line (rows, high watermark) per batch; retries overwrite their own folder."""

    def load(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.parquet(target)
        line = written.agg(F.count(F.lit(1)).alias("loaded"), F.max(F.struct(*keys)).alias("watermark"))
        line.write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")

    available_now(stream.writeStream.outputMode("append").foreachBatch(load), checkpoint)


def last_beats(beats: DataFrame, out: str, checkpoint: str) -> None:
    """Latest beat per job, kept current; judge it with the batch staleness rule at any moment."""
    latest = beats.groupBy("job").agg(F.max("fired_at").alias("fired_at"), F.max("interval_s").alias("interval_s"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    available_now(latest.writeStream.outputMode("complete").foreachBatch(publish), checkpoint)


def _in_turn(beats: DataFrame, known: DataFrame | None) -> DataFrame:
    """Beats (job, at, limit, told), each with the time of the next beat of its job. ``known`` holds the last beat of each job so far.

    Beats of a job older than its known one are left out; beats of one time count once, with the longest limit.
    """
    # dealt out by job once: neither the folding of equal times nor the window moves the rows again
    rows, job = beats.withColumn("told", F.lit(False)), W.partitionBy("job")
    if known is None:
        rows = rows.repartition("job")
    else:
        rows = rows.withColumn("was", F.lit(None).cast("long")).unionByName(known.withColumn("was", F.col("at"))).repartition("job")
        rows = rows.withColumn("was", F.max("was").over(job)).where("was IS NULL OR at >= was")
    once = rows.groupBy("job", "at").agg(F.max("limit").alias("limit"), F.max("told").alias("told"))
    return once.withColumn("next_at", F.lead("at").over(job.orderBy("at")))


def silence_alerts(beats: DataFrame, out: str, checkpoint: str) -> None:
    """Tell each silence once: a beat (job, fired_at, interval_s) that no other follows within twice its interval.

    An alert comes with the batch that shows the gap, or whose beats, of any job, show that the time is past, also when the silent
    job never beats again. Batches are taken in time order; a beat older than what was seen of its job changes nothing. A job without
    an interval stays silent. All jobs of a batch are judged by one window. A batch leaves the last beat of every job beside the
    checkpoint (microseconds; whether its silence was told) and the next goes on from there. It writes only its own numbered
    folders, so a retried batch overwrites itself.
    """
    timed = beats.where("fired_at IS NOT NULL").select(
        "job", F.unix_micros("fired_at").alias("at"), (F.col("interval_s").cast("long") * 2_000_000).alias("limit")
    )
    due = F.col("at") + F.col("limit")
    open_end = F.col("next_at").isNull()

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{checkpoint}-last/batch={batch_id - 1}") if batch_id > 0 else None
        gap = ~F.col("told") & (F.col("next_at") > due)
        walked_path = f"{checkpoint}-walked/batch={batch_id}"
        _in_turn(batch, known).where(open_end | gap).write.mode("overwrite").parquet(walked_path)
        walked = spark.read.parquet(walked_path)
        # the latest beat of all is the last one of its own job
        now = walked.where(open_end).agg(F.max("at")).first()[0]
        past = F.coalesce(F.floor(due / 1000) < F.floor(F.lit(now).cast("long") / 1000), F.lit(False))
        silent = walked.where(~open_end | (past & ~F.col("told")))
        alerts = silent.select("job", F.timestamp_micros("at").alias("fired_at"), F.timestamp_micros(due).alias("due_at"))
        alerts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = walked.where(open_end).select("job", "at", "limit", (F.col("told") | past).alias("told"))
        last.write.mode("overwrite").parquet(f"{checkpoint}-last/batch={batch_id}")

    available_now(timed.writeStream.outputMode("append").foreachBatch(watch), checkpoint)
