"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.session import checkpointed, table

__all__ = ["ascii_lower", "checkpointed", "fresh", "hash_unit", "key_filter", "packed_bits", "table", "text_of", "WORD"]

#: A word is a run of anything but ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, _UPPER, _LOWER)


def fresh(taken: Sequence[str], name: str) -> str:
    """A column name that clashes with none of those taken (Spark ignores case)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def hash_unit(*cols: Column) -> Column:
    """A fixed uniform number in [0, 1) for the given values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") * F.lit(2.0**-53)


def conf_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def packed_bits(numbers: DataFrame, bits: int) -> bytes:
    """One bit for each number below 2 ** ``bits``: whether the only column of ``numbers`` (long) holds it, taken modulo 2 ** ``bits``.

    Tasks make the bits in slices; only the bits pass through the driver.
    """
    slice_bits = min(15, bits)

    def pack(rows: pa.Table) -> pa.Table:
        held = np.zeros(1 << slice_bits, np.uint8)
        held[rows["n"].to_numpy() & ((1 << slice_bits) - 1)] = 1
        return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    low = F.col(numbers.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("n")
    parts = numbers.select(low).select(F.shiftright("n", slice_bits).alias("part"), "n").groupBy("part").applyInArrow(
        pack, "part long, bits binary"
    )
    size = (1 << slice_bits) // 8
    out = bytearray((1 << bits) // 8)
    for row in parts.collect():
        out[row.part * size : (row.part + 1) * size] = row.bits
    return bytes(out)


def key_filter(keys: DataFrame, most_bits: int = 29) -> Callable[[Column], Column]:
    """Whether a hash may be among the only column of ``keys`` (64-bit hashes): true for all that are, and for few others.

    For rows that would only travel to a join to find nothing there; the exact join or grouping still has to follow. Two bits are set
    for each key, in 8 to 16 bits a key. At most 2 ** ``most_bits`` bits (64 MB): with more keys more others pass, and none is lost.
    """
    spark = keys.sparkSession
    bits = min(most_bits, max(10, (8 * keys.count()).bit_length()))
    key = F.col(keys.columns[0])
    shared = spark.sparkContext.broadcast(packed_bits(keys.select(F.explode(F.array(key, F.shiftrightunsigned(key, 28)))), bits))

    @F.arrow_udf("boolean")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, mask = np.frombuffer(shared.value, np.uint8), np.uint64((1 << bits) - 1)

        def has(n: np.ndarray) -> np.ndarray:
            n = n & mask
            return (held[n >> np.uint64(3)] << (n & np.uint64(7)).astype(np.uint8)) & 128 > 0

        for batch in batches:
            key = batch.to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.array(has(key) & has(key >> np.uint64(28)))

    return of
