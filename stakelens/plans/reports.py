"""Report and table sinks, read back: a globally ordered report and a replaced table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakelens.operators.stats import roi_stats
from stakelens.plans import adapters as a
from stakelens.plans.adapters import roi_sql, with_tables
from stakelens.plans.registry import query
from stakelens.session import work_path
from stakelens.sources import files

_KEYS = ("market", "season", "book_id", "side")


@query(
    "ordered_report",
    with_tables("picks", extra=f"s AS (SELECT {', '.join(_KEYS)}, {roi_sql(clv=None)} FROM picks GROUP BY ALL)")
    + f"SELECT row_number() OVER (ORDER BY n DESC, {', '.join(_KEYS)}) AS place, * FROM s",
)
def q_ordered_report(spark, sf):
    """A CSV report over books, written in order of size, with each row's place as read back from the files."""
    path = work_path(spark, "report")
    stats = roi_stats(a.picks(spark, sf), _KEYS, clv=None)
    files.write_ordered(stats, path, [F.desc("n"), *_KEYS])
    return files.read_ordered(spark, path, stats.schema)


@query(
    "report_manifest",
    with_tables("picks", extra=f"s AS (SELECT {', '.join(_KEYS)}, {roi_sql(clv=None)} FROM picks GROUP BY ALL)")
    + "SELECT count(*) AS n_rows, max(n) AS first_n, min(n) AS last_n, true AS in_order FROM s",
)
def q_report_manifest(spark, sf):
    """The ordered report's files: whether each file ends before the next one begins, with the ends of the whole."""
    path = work_path(spark, "report")
    stats = roi_stats(a.picks(spark, sf), _KEYS, clv=None)
    files.write_ordered(stats, path, [F.desc("n"), *_KEYS])
    manifest = files.ordered_manifest(spark, path, stats.schema, [-F.col("n"), *[F.col(k) for k in _KEYS]])
    return manifest.agg(
        F.sum("n_rows").alias("n_rows"),
        (-F.min("first")["k0"]).alias("first_n"), (-F.max("last")["k0"]).alias("last_n"), F.every("in_order").alias("in_order"),
    )


@query(
    "overwrite_table",
    with_tables("picks") + "SELECT market, season, count(*) AS n, count(*) FILTER (WHERE win) AS wins FROM picks WHERE odds < 0 GROUP BY 1, 2",
)
def q_overwrite_table(spark, sf):
    """A written table is replaced whole; what is read back holds only the second write."""
    path = work_path(spark, "replaced")
    picks = a.picks(spark, sf).select("market", "season", "odds", "win")
    files.write_table(picks, path)
    files.write_table(picks.where("odds < 0"), path)
    return spark.read.parquet(path).groupBy("market", "season").agg(F.count(F.lit(1)).alias("n"), F.count_if("win").alias("wins"))
