"""I-Match fingerprints over several randomised lexicon subsets.

Terms are the lower-cased words of a text. Document frequencies are counted over all documents by 64-bit hash of the term. The
lexicon is what lies in the chosen band of inverse document frequency, held as a filter of one bit for each value of the hash's lowest
bits: ``bucket_bits`` of them at least, and as many as give ``ROOM`` bits to each term of the band.
From it ``COPIES`` x ``LEVELS`` random subsets are drawn; those of a level keep each term with the same
probability, from 1/2 down to 2^-22, so that for a text of any length some subsets keep about one of its terms. For each
subset the distinct terms it keeps are sorted and hashed to three hex digits: ``000`` where it keeps none, ``fff`` where the
level keeps too many to be telling (over ``DENSE`` expected).

Likeness of two fingerprints: 1 if they are equal; else the share of equal digits among the subsets that keep a term of either, gathered
from the sparsest level on until ``ENOUGH`` subsets are seen. For subsets of about one term that share is the share
of common terms.

Defined cases: a null text counts as empty; a text without words has the all-empty fingerprint; a text with no term in the band
is fingerprinted by all its terms. Equal texts have equal fingerprints. Rows with null ids are the last in descending order;
of rows with one id the order is that of their texts. A single document is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm.common import conf_partitions, packed_bits, text_of
from stakelens.session import stored

COPIES, LEVELS, DENSE, ENOUGH = 16, 22, 8, 24
ROOM = 64
PART_BITS = 11
PARTS = 1 << PART_BITS
_FLUSH = 2_000_000  # hashed terms held by a task before they are counted and passed on
_MIX = np.random.default_rng(20).integers(0, 1 << 63, COPIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEAST = np.uint64(1) << (np.uint64(64) - np.arange(LEVELS, 0, -1, dtype=np.uint64))  # a draw below the i-th last is kept at level i
_DIGITS = np.array([f"{v:03x}".encode() for v in range(1 << 12)])
_BATCH_CHARS = 1 << 19  # texts that are fingerprinted together


def _hashes(text: str) -> np.ndarray:
    """Hashes of the distinct words of a text."""
    import xxhash

    of = xxhash.xxh64_intdigest
    words = set(text.lower().encode("utf-8", "replace").split())
    return np.fromiter(map(of, words), np.uint64, len(words))


def document_frequencies(docs: DataFrame, text: str = "text", bucket_bits: int = 24) -> DataFrame:
    """(term, n): the number of documents that hold each term, by its 64-bit hash; ``bucket_bits`` is kept for callers and unused.

    Each task counts its own terms and hands them on sorted, in one packed row for each of ``PARTS`` ranges of the hash; the rows of a
    range are added up together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            part = (term >> np.uint64(64 - PART_BITS)).astype(np.int32)
            starts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]]) if len(part) else np.zeros(1, int)
            packed = [_packed(term[a:b], n[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

        for batch in batches:
            for value in batch.column(0):
                held.append(_hashes(value.as_py() or ""))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield counted()
                    held, size = [], 0
        yield counted()

    def add(rows: pa.Table) -> pa.Table:
        pieces = [_unpacked(p.as_py()) for p in rows["packed"]]
        term, at = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in pieces])).astype(np.int64)
        return pa.table({"term": term.view(np.int64), "n": n})

    return docs.select(text).mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(add, "term long, n long")


def _packed(term: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted terms and their counts, by planes of one byte: the high bytes of neighbours are alike and pack well."""
    steps = np.diff(term, prepend=term[0]).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = int(np.nonzero(steps.any(axis=0))[0].max(initial=0)) + 1
    wide = int(n.max() > 255)
    counts = n.astype("<u4" if wide else np.uint8).tobytes()
    head = bytes([used, wide]) + len(term).to_bytes(4, "little") + int(term[0]).to_bytes(8, "little")
    return head + steps[:, :used].T.tobytes() + counts


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    used, wide, size = raw[0], raw[1], int.from_bytes(raw[2:6], "little")
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :used] = np.frombuffer(raw, np.uint8, size * used, 14).reshape(used, size).T
    term = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int.from_bytes(raw[6:14], "little"))
    return term, np.frombuffer(raw, "<u4" if wide else np.uint8, size, 14 + size * used)


def lexicon(counts: DataFrame, documents: int, bucket_bits: int, least_documents: int, most_share: float) -> bytes:
    """A bit for each bucket: whether a term of it lies in the band. At least 2 ** bucket_bits bits."""
    kept = stored(counts.where((F.col("n") >= least_documents) & (F.col("n") <= most_share * documents)).select("term"), "lexicon")
    bucket_bits = max(bucket_bits, (ROOM * kept.count() - 1).bit_length())
    return packed_bits(kept, bucket_bits)


class Fingerprinter:
    def __init__(self, bits: bytes):
        self._in = np.frombuffer(bits, np.uint8)
        self._mask = np.uint64(8 * len(self._in) - 1)

    def of(self, text: str) -> np.ndarray:
        """A number for each level and subset: 0 nothing kept, 0xFFF too dense, else a hash of what is kept."""
        return self.of_all([text])[0]

    def of_all(self, texts: list[str]) -> np.ndarray:
        """The numbers of many texts, by array work over the terms of all of them."""
        import xxhash

        hashes = [_hashes(text) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        terms = np.concatenate([np.empty(0, np.uint64), *hashes])
        bucket = terms & self._mask
        band = (self._in[bucket >> np.uint64(3)] << (bucket & np.uint64(7)).astype(np.uint8)) & 128 > 0
        band |= (np.bincount(owner[band], minlength=len(texts)) == 0)[owner]
        terms, owner = terms[band], owner[band]
        size = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), LEVELS, COPIES), np.uint16)
        dense = size[:, None] >> np.arange(1, LEVELS) > DENSE  # the sparsest level always counts
        out[:, :-1][dense] = 0xFFF
        first = dense.sum(axis=1)[owner]
        most = _LEAST[LEVELS - 1 - first]
        found = []  # of the terms drawn at the first level that counts: text, subset, number of levels, term
        for copy in range(COPIES):
            drawn = terms * _MIX[copy]
            drawn ^= drawn >> np.uint64(32)
            drawn *= np.uint64(0x9E3779B97F4A7C15)
            at = np.nonzero(drawn < most)[0]
            levels = LEVELS - np.searchsorted(_LEAST, drawn[at], side="right") - first[at]
            found.append((owner[at] * (LEVELS * COPIES) + first[at] * COPIES + copy, levels, terms[at]))
        place, levels, kept = (np.concatenate(c) for c in zip(*found))
        if not len(kept):
            return out
        ends = np.cumsum(levels)
        deeper = np.arange(ends[-1]) - np.repeat(ends - levels, levels)  # a term drawn at a level is so at all before it
        place, kept = np.repeat(place, levels) + deeper * COPIES, np.repeat(kept, levels)
        order = np.lexsort((kept, place))
        place, raw = place[order], memoryview(kept[order].tobytes())
        starts = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        cuts = [*(8 * starts).tolist(), len(raw)]
        of = xxhash.xxh32_intdigest
        told = np.fromiter((of(raw[a:b]) for a, b in zip(cuts, cuts[1:])), np.uint32, len(starts))
        out.reshape(-1)[place[starts]] = told % 0xFFE + 1
        return out


def as_texts(prints: np.ndarray) -> list[str]:
    """Three hex digits for each number, a text for each fingerprint."""
    digits = _DIGITS[prints.reshape(len(prints), -1)]
    return [row.tobytes().decode("ascii") for row in digits]


def as_text(print_: np.ndarray) -> str:
    return as_texts(print_[None])[0]


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of each fingerprint of ``a`` to that of ``b``, 0 to 1."""
    usable = ((a != 0) | (b != 0)) & (a != 0xFFF) & (b != 0xFFF)
    seen = usable.sum(axis=2)[:, ::-1].cumsum(axis=1)
    equal = (usable & (a == b)).sum(axis=2)[:, ::-1].cumsum(axis=1)
    at = np.minimum((seen < ENOUGH).sum(axis=1), LEVELS - 1)[:, None]
    seen, equal = np.take_along_axis(seen, at, 1)[:, 0], np.take_along_axis(equal, at, 1)[:, 0]
    return np.where((a == b).all(axis=(1, 2)), 1.0, equal / np.maximum(seen, 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    return float(likenesses(a[None], b[None])[0])


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(docs: DataFrame) -> DataFrame:
    """(deal, lends, doc_id, text), sorted within partitions: runs of documents in descending id, each closed by the first row of the next run.

    Runs are cut at quantiles of the id. Only the first ids of the runs, as many as four for each partition, pass
    through the driver.
    """
    spark = docs.sparkSession
    runs = 4 * conf_partitions(spark)
    least = -(1 << 63)
    rows = docs.select("doc_id", text_of("text").alias("text"), F.coalesce("doc_id", F.lit(least)).alias("key"))
    ids = docs.select(F.coalesce("doc_id", F.lit(least)).alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / runs for i in range(1, runs)], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    deal = F.lit(len(cuts)) - F.aggregate(
        F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("array()").cast("array<bigint>"),
        F.lit(0), lambda n, c: n + F.when(F.col("key") >= c, 1).otherwise(0),
    )
    firsts = ids.withColumn("deal", deal).groupBy("deal").agg(F.max("key").alias("key")).orderBy("deal").collect()
    lent = [(firsts[i].key, firsts[i - 1].deal) for i in range(len(firsts))]  # the first run closes the last
    lent = spark.createDataFrame(lent, "key long, to int")
    own = rows.withColumn("deal", deal)
    out = own.join(F.broadcast(lent), "key", "left").withColumn(
        "place",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("deal").alias("deal"), F.lit(False).alias("lends")),
                    F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("deal"), F.lit(True).alias("lends"))),
                )
            )
        ),
    )
    return (
        out.select("place.deal", "place.lends", "doc_id", "key", "text")
        .repartition(conf_partitions(spark), "deal")
        .sortWithinPartitions("deal", "lends", F.desc("key"), "text")
        .drop("key")
    )


def fingerprint_documents(
    docs: DataFrame, bucket_bits: int = 24, least_documents: int = 2, most_share: float = 0.05
) -> DataFrame:
    """Fingerprints of all documents (doc_id, text) and of their edited texts, and how alike they are.

    The band: terms in at least ``least_documents`` documents and at most ``most_share`` of all.
    """
    spark = docs.sparkSession
    counts = document_frequencies(docs, bucket_bits=bucket_bits)
    bits = lexicon(counts, docs.count(), bucket_bits, least_documents, most_share)
    shared = spark.sparkContext.broadcast(bits)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shared.value)
        rows = chain.from_iterable(zip(*(batch.column(i) for i in range(4))) for batch in batches)
        ids: list[int | None] = []
        texts: list[str] = []
        firsts: list[int] = []  # places of the documents whose next one stands behind them
        known = np.empty((0, LEVELS, COPIES), np.uint16)  # fingerprint of the text carried over
        size, waits = 0, None  # waits: the run of the row whose next one is still to come

        def compared() -> pa.RecordBatch:
            nonlocal known
            changed = [edited(texts[i], texts[i + 1]) for i in firsts]
            made = maker.of_all(texts[len(known) :] + changed)
            prints, after = np.concatenate([known, made[: len(texts) - len(known)]]), made[len(texts) - len(known) :]
            known, before = prints[-1:], prints[firsts]
            columns = (
                [ids[i] for i in firsts], [len(texts[i]) for i in firsts],
                [hashlib.sha256(c.encode("utf-8", "replace")).hexdigest() for c in changed], as_texts(before),
                as_texts(after), likenesses(before, after), likenesses(before, prints[[i + 1 for i in firsts]]),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for row in chain(rows, [None]):
            if row is not None:
                deal, lends, doc_id, text = (v.as_py() for v in row)
                if lends and waits != deal:
                    continue  # one more row of the id that already closed this run
                if waits is not None:
                    firsts.append(len(texts) - 1)
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                waits = None if lends else deal
            if firsts and (row is None or size >= _BATCH_CHARS):
                yield compared()
                ids, texts, firsts, size = ids[-1:], texts[-1:], [], 0

    return _in_order(docs).mapInArrow(walk, schema)
