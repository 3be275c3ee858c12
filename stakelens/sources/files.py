"""File sources and sinks: all-text landing tables, sectioned CSV, JSONL caches, ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, the landing form of a loosely typed source."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def write_landing(df: DataFrame, path: str, partition: str) -> None:
    """All-text CSV partitioned by one column, so readers can prune."""
    all_text(df).write.mode("overwrite").partitionBy(partition).option("header", True).csv(path)


def read_landing(spark: SparkSession, path: str, columns: Sequence[str], partition: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, partition)])
    return spark.read.schema(schema).option("header", True).csv(path)


def tagged_union(frames: Mapping[object, DataFrame], tag: str) -> DataFrame:
    """UNION ALL of same-kind tables, each tagged with a literal; columns may differ."""
    tagged = [df.withColumn(tag, F.lit(value)) for value, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_seasons(spark: SparkSession, paths: Mapping[int, str], tag: str = "season") -> DataFrame:
    """One parquet file set per season."""
    return tagged_union({season: spark.read.parquet(p) for season, p in paths.items()}, tag)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record per key of an append-only cache; combines on the map side."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def csv_cells(line: Column) -> Column:
    """Fields of a CSV line, however many; quotes may hold commas and doubled quotes, an empty bare field is null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), inner(c)).otherwise(F.nullif(c, F.lit(""))))


def read_sectioned(
    spark: SparkSession, path: str, columns: Sequence[str], section: str = "picks"
) -> DataFrame:
    """Rows of one section of files that mix several row kinds.

    The first field names the section; a ``section,...`` line names the fields of the
    lines after it, and its order may differ from file to file. A line takes the last
    header before it in its file: first within its own input split, else the last one
    of the splits before, so a huge file is still read by many tasks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"),
    )
    lines = lines.where(F.col("value").startswith("section,event_id") | F.col("value").startswith(f"{section},"))
    parsed = lines.select("file", "split", "pos", csv_cells(F.col("value")).alias("cells"))
    is_header = F.col("cells")[0] == "section"
    header = F.when(is_header, F.col("cells"))
    last = parsed.groupBy("file", "split").agg(F.max_by("cells", F.when(is_header, F.col("pos"))).alias("_h"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    inherited = last.select("file", "split", F.last("_h", ignorenulls=True).over(earlier).alias("_inherited"))
    within = W.partitionBy("file", "split").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = parsed.withColumn("_own", F.last(header, ignorenulls=True).over(within)).where(~is_header)
    named = placed.join(inherited, ["file", "split"]).withColumn("_names", F.coalesce("_own", "_inherited"))

    def field(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        return F.when(at > 0, F.get("cells", at - 1)).alias(name)

    return named.select("file", *[field(c) for c in columns])


def keyset_after(df: DataFrame, keys: Sequence[str], last: Sequence[Column]) -> DataFrame:
    """Rows after a high watermark in (k1, k2, ...) order; the first key alone is pushed to the scan."""
    first = F.col(keys[0])
    return df.where((first >= last[0]) & (F.struct(*keys) > F.struct(*[c.alias(k) for c, k in zip(last, keys)])))


def append_new(candidates: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only rows whose key is not in the written table yet."""
    spark = candidates.sparkSession
    done = spark.read.parquet(path).select(*keys)
    candidates.join(done, list(keys), "left_anti").write.mode("append").parquet(path)


def compact_copy(df: DataFrame, path: str, drop: Sequence[str]) -> DataFrame:
    """Copy without the named wide columns; returns the written table."""
    df.drop(*drop).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Result table as CSV with header; stays distributed."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """Result table as CSV with header in one global order: ranges of it by file number, sorted within each file."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def _placed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with file, block and position within the block."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, place: str = "place") -> DataFrame:
    """An ordered report with each row's place, from 1: blocks are numbered by file and offset, and only their sizes are summed up."""
    rows = _placed(spark, path, schema)
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    at = (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias(place)
    return rows.join(starts, ["_file", "_block"]).select(at, *schema.names)


def ordered_manifest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[Column]) -> DataFrame:
    """(file, n_rows, first, last, in_order) of an ordered report; in_order tells that the file before ends before this one begins.

    ``keys`` are ascending; one row a file goes through the window.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    sizes = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    earlier = F.lag("last").over(W.orderBy("file"))
    return sizes.withColumn("in_order", F.coalesce(earlier < F.col("first"), F.lit(True)))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
