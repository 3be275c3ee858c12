"""Session helpers: table access, checkpointing and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "stakelens", partitions: int = 8) -> SparkSession:
    """Session used by tests, bench and the checker; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temp folder only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive executor loss and are never recomputed."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for written tables and stream state, beside the checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/stakelens-{label}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that ends meanwhile."""
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str = "rows", rows_per_file: int = 200_000, apart: Sequence[str] = (), tidy: bool = False) -> DataFrame:
    """Rows written once as a compressed columnar table beside the checkpoints: computed once, and each later pass reads only
    the columns that it takes. For tables of many rows that are read often; ``checkpointed`` keeps whole uncompressed rows.

    Files are cut by rows, since a narrow table packs so well that a split by bytes alone would hand one task millions of rows.
    ``apart``: columns of few values whose rows are kept in a folder for each value, so that a filter on them reads no other rows.
    ``tidy``: the shuffle files of the write go as soon as it is done, not when the driver next collects its garbage; for one thread, as the
    setting is the session's.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(*apart)
    with _shuffles_dropped(spark) if tidy else nullcontext():
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
