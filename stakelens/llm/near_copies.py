"""Near copies by words: SimHash groups, widened by links of a word-shingle likeness of 0.8 or more.

A 64-bit SimHash within three bits finds texts that are all but equal; at a likeness of 0.8 two fingerprints differ in about ten bits,
where triangle bounds prune nothing. So the vantage-point search gives the first groups, and texts further apart are met through
min-wise samples: each text has ten samples of five shingles, and texts that share a sample are candidates. Two texts of likeness
0.8 share one with probability 0.98, of 0.9 with 0.9999. Each member of a sample's group is held against the group's first
text (smallest id, the likely original), one pair each, never all pairs; the exact likeness of the whole texts decides.

Defined cases: words and short texts as in ``simhash``; texts without words link to each other. A group whose members are alike only
in a chain that avoids every first text may stay apart. Which row of a group stays: the smallest id, null ids last, then the
smallest hash of the text; of rows alike in both, one. Columns pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, fresh, text_of
from stakelens.llm.components import components
from stakelens.llm.simhash import near_links

_PART = 4096  # shingles hashed at a time


def shingle_hashes(text: str, words_in_shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Unsigned hashes of all shingles, repeats included, a part at a time; nothing for a text without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined, size = b" ".join(words), min(words_in_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[: len(words) - size]])
    ends = ends[size - 1 :] - 1
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _PART):
        spans = zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist())
        yield np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), ">u8")


class Signer:
    """SimHash bits and min-wise samples of a text, from one pass over its shingles."""

    def __init__(self, words_in_shingle: int = 5, samples: int = 10, sample_size: int = 5, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.words, self.seed, self.shape = words_in_shingle, seed, (samples, sample_size)
        self._mask = rng.integers(0, 1 << 63, samples * sample_size, np.uint64)
        self._odd = rng.integers(0, 1 << 63, samples * sample_size, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> tuple[int, list[int]]:
        import xxhash

        ones, n, least = np.zeros(64, np.int64), 0, None
        for part in shingle_hashes(text, self.words, self.seed):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(part)
            h = np.unique(part.astype(np.uint64))
            lows = ((h[:, None] ^ self._mask) * self._odd).min(axis=0)
            least = lows if least is None else np.minimum(least, lows)
        bits = int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0
        if least is None:
            return bits, []
        return bits, [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(self.shape))]


def _signatures(text: Column, signer: Signer) -> Column:
    @F.arrow_udf("struct<bits:long,codes:array<long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            signed = [signer(t.as_py() or "") for t in batch]
            bits = np.array([b for b, _ in signed], np.uint64).view(np.int64)
            codes = [np.array(c, np.uint64).view(np.int64).tolist() for _, c in signed]
            yield pa.StructArray.from_arrays([pa.array(bits), pa.array(codes, pa.list_(pa.int64()))], ["bits", "codes"])

    return of(text)


def likeness(a: str, b: str, words_in_shingle: int = 5) -> float:
    """Shared distinct shingles over all distinct shingles; two texts without words are alike."""
    sets = [np.unique(np.concatenate([*shingle_hashes(t, words_in_shingle, 42), np.empty(0, ">u8")])) for t in (a, b)]
    shared = len(np.intersect1d(*sets, assume_unique=True))
    return shared / (len(sets[0]) + len(sets[1]) - shared) if len(sets[0]) + len(sets[1]) else 1.0


def _alike(a: Column, b: Column, least: float, words_in_shingle: int) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = zip(left, right)
            yield pa.array([likeness(x.as_py() or "", y.as_py() or "", words_in_shingle) >= least for x, y in pairs])

    return of(a, b)


def _sampled_links(firsts: DataFrame, texts: DataFrame, least: float, words_in_shingle: int) -> DataFrame:
    """(a, b): groups joined by a pair of texts that share a sample and are alike enough; ``firsts`` is (mark, first, group, codes)."""
    sampled = firsts.select("first", "mark", "group", F.posexplode("codes").alias("t", "code"))
    heads = sampled.groupBy("t", "code").agg(
        F.min(F.struct("first", "mark", "group")).alias("head"), F.count(F.lit(1)).alias("members")
    )
    met = sampled.join(heads.where("members > 1"), ["t", "code"]).where(F.col("group") != F.col("head.group"))
    pairs = met.select("mark", "group", F.col("head.mark").alias("of"), F.col("head.group").alias("of_group")).distinct()
    pairs = checkpointed(pairs)
    needed = pairs.select("mark").unionByName(pairs.select(F.col("of").alias("mark"))).distinct()
    held = checkpointed(texts.join(needed, "mark", "left_semi").groupBy("mark").agg(F.min("text").alias("text")))
    both = pairs.join(held, "mark").join(held.select(F.col("mark").alias("of"), F.col("text").alias("of_text")), "of")
    alike = both.where(_alike(F.col("text"), F.col("of_text"), least, words_in_shingle))
    return alike.select(F.col("group").alias("a"), F.col("of_group").alias("b"))


def drop_near_copies(docs: DataFrame, least: float = 0.8, words_in_shingle: int = 5, distance: int = 3, signer: Signer | None = None) -> DataFrame:
    """One document of each group of near copies."""
    signer = signer or Signer(words_in_shingle)
    marked = docs.select("doc_id", F.md5(text_of()).alias("mark"), text_of().alias("text"))
    prints = checkpointed(marked.select("doc_id", "mark", _signatures(F.col("text"), signer).alias("s")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = prints.groupBy("mark").agg(F.min(place).alias("first"), F.first("s").alias("s"))
    firsts = checkpointed(firsts.select("mark", "first", "s.bits", "s.codes"))
    roots = components(near_links(firsts, distance=distance), "a", "b").select(F.col("node").alias("bits"), "root")
    grouped = checkpointed(firsts.join(roots, "bits", "left").select("mark", "first", "codes", F.coalesce("root", "bits").alias("group")))
    wider = components(_sampled_links(grouped, marked.select("mark", "text"), least, words_in_shingle), "a", "b")
    rooted = grouped.select("first", "group").join(wider.withColumnRenamed("node", "group"), "group", "left")
    kept = rooted.groupBy(F.coalesce("root", "group").alias("r")).agg(F.min("first").alias("first")).select("first.doc_id", "first.mark")
    mark, id_, of = (fresh(docs.columns, c) for c in ("_mark", "_kept_id", "_kept_mark"))
    copies = prints.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    counted = copies.join(kept, copies["doc_id"].eqNullSafe(kept["doc_id"]) & (copies["mark"] == kept["mark"])).select(copies["*"])
    n = fresh(docs.columns, "_kept_n")
    counted = counted.select(F.col("doc_id").alias(id_), F.col("mark").alias(of), F.col("n").alias(n))
    rows = docs.withColumn(mark, F.md5(text_of()))
    found = rows.join(counted, rows["doc_id"].eqNullSafe(counted[id_]) & (rows[mark] == counted[of]))
    once = found.where(F.col(n) == 1).select(*[rows[c] for c in docs.columns])
    again = found.where(F.col(n) > 1).dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return once.unionByName(again)
