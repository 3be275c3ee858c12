"""Substring dedup by sliding sentence spans.

A text is cut into sentences (ended by a stop mark before white space, by a stop of a script without blanks, or by a line end); a
sentence of over ``LONG`` words, such as a passage without stops, is cut further after words whose hash says so, so that equal
stretches are cut alike wherever they stand. In scripts without blanks each character counts as a word. From every sentence on the
shortest run of sentences that has both ``SPAN`` sentences and ``LEAST_WORDS`` words is hashed (96 bits, over lower-cased words), so
short lines make longer runs and none is passed over. Runs whose hash occurs more than once anywhere are repeats; the first by document id and place stays, and each sentence that another occurrence covers
is removed. Spans are judged on the texts as they came.

Spans move once: they are ranked by document and place within their hash, and all but the first are repeats. A hash that fills over a
ten-thousandth of a 64th of the documents is dealt out further, by document, and its first places are compared afterwards, so that a span
which stands in a third of all documents is no task of its own; which hashes those are changes no result.

Defined cases: a null text stays null and an empty one empty, without sentences; a text of fewer than ``SPAN`` sentences or
``LEAST_WORDS`` words has no span; of documents with one id those with different texts are different documents, ordered by a hash of the text, and
rows alike in both are one (each keeps what that one keeps); null ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, fresh
from stakelens.session import work_path

SPAN, LEAST_WORDS, LONG, CUT_EVERY = 3, 10, 16, 3
#: Letters of scripts written without blanks: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_END = re.compile(r"(?:[.!?…]+[\"'»”)\]]*(?=\s|\Z)|[。！？｡]+[\"'»”)\]」』）】》]*|\n)\s*")
_WORD = re.compile(rf"(?:[{_UNSPACED}]|[^\s{_UNSPACED}]+)\s*")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_ROWS = 512


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence; together they cover the text."""
    import xxhash

    out, at = [], 0
    blanks = _ANY_UNSPACED.search(text) is None
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        if end <= at:
            continue
        words = text[at:end].lower().split() if blanks else [m[0].strip().lower() for m in _WORD.finditer(text, at, end)]
        if len(words) <= LONG:
            out.append((at, end, words))
        else:
            start, held = at, []
            for m in _WORD.finditer(text, at, end):
                word = m[0].strip().lower()
                held.append(word)
                if xxhash.xxh32_intdigest(word) % CUT_EVERY == 0 and len(held) >= 2:
                    out.append((start, m.end(), held))
                    start, held = m.end(), []
            if start < end:
                out.append((start, end, held))
        at = end
    return out


def span_ends(n_words: list[int]) -> np.ndarray:
    """The end of the span that starts at each sentence, as far as there are spans."""
    before = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
    ends = np.maximum(np.arange(len(n_words)) + SPAN, np.searchsorted(before, before[:-1] + LEAST_WORDS))
    return ends[ends <= len(n_words)]  # they never fall, so those that fit come first


def span_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, hash, rest of the hash) of each span."""
    import xxhash

    parts = sentences(text)
    digests = [xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")) for _, _, words in parts]
    ends = span_ends([len(words) for _, _, words in parts])
    raw = b"".join([xxhash.xxh3_128_digest(b"".join(digests[a:b])) for a, b in enumerate(ends.tolist())])
    words = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return np.arange(len(ends), dtype=np.int32), words[:, 0], words[:, 1].astype(np.int32)


def _spans_column(text: Column) -> Column:
    @F.arrow_udf("array<struct<at:int,h:long,g:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), _ROWS):
                found = [span_hashes(t.as_py() or "") for t in batch.slice(start, _ROWS)]
                offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                columns = [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)]
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["at", "h", "g"]))

    return spans(text)


def _without_column(text: Column, spans: Column) -> Column:
    @F.arrow_udf("struct<text:string,n:int,removed:int>")
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removals in batches:
            for start in range(0, len(texts), _ROWS):
                out = []
                for text_, firsts in zip(texts.slice(start, _ROWS).to_pylist(), removals.slice(start, _ROWS).to_pylist()):
                    parts = sentences(text_ or "")
                    ends = span_ends([len(words) for _, _, words in parts]) if firsts else ()
                    gone = {k for at in firsts or () for k in range(at, ends[at])}
                    kept = text_ if not gone else "".join([text_[a:b] for i, (a, b, _) in enumerate(parts) if i not in gone])
                    out.append({"text": kept, "n": len(parts), "removed": len(gone)})
                kind = pa.struct([("text", pa.string()), ("n", pa.int32()), ("removed", pa.int32())])
                yield pa.array(out, kind)

    return without(text, spans)


def repeated_spans(docs: DataFrame, text: str = "text", deal: int = 64, most_hot: int = 10_000) -> DataFrame:
    """(doc_id, mark, at): first sentence of the spans that repeat an earlier one; mark is a hash of the text.

    Spans of one hash meet in one task, unless they are many: at most ``most_hot`` hashes, those that stand out in one of ``deal``
    parts of the documents, are dealt out to ``deal`` tasks.
    """
    texts = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def spans(frame: DataFrame) -> DataFrame:
        exploded = frame.select("doc_id", "mark", F.explode(_spans_column(F.col("text"))).alias("s"))
        return exploded.select("doc_id", "mark", "s.at", "s.h", "s.g")

    part = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(deal))
    counted = checkpointed(spans(texts.where(part == 0)).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") >= max(256, total / most_hot)).select("h", "g", F.lit(True).alias("hot"))
    place = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("at")]
    dealt = spans(texts).join(F.broadcast(hot), ["h", "g"], "left")  # at most most_hot rows
    own = W.partitionBy("h", "g", F.when(F.col("hot"), part).otherwise(0)).orderBy(*place)
    kept = dealt.withColumn("nth", F.rank().over(own)).where("nth > 1 OR hot")
    path = work_path(docs.sparkSession, "spans")
    kept.select("doc_id", "mark", "at", (F.col("nth") > 1).alias("later"), *[F.when(F.col("hot") & (F.col("nth") == 1), F.col(c)).alias(c) for c in ("h", "g")]).write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    ends = kept.where("NOT later")  # the first places of the parts of a hot hash
    first = ends.groupBy("h", "g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "at")).alias("first"))
    again = ends.join(F.broadcast(first), ["h", "g"]).where(
        ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark")) & (F.col("first.at") == F.col("at")))
    )
    return kept.where("later").select("doc_id", "mark", "at").unionByName(again.select("doc_id", "mark", "at"))


def drop_repeated_sentences(docs: DataFrame, text: str = "text", figures: bool = False) -> DataFrame:
    """``docs`` with repeated sentences taken out of the text; with ``figures`` also n_sentences and n_removed."""
    later = repeated_spans(docs, text)
    id_, mark, cut = (fresh(docs.columns, c) for c in ("_cut_id", "_mark", "_cut"))
    cuts = later.groupBy(F.col("doc_id").alias(id_), "mark").agg(F.collect_set("at").alias(cut))
    cuts = cuts.withColumnRenamed("mark", f"{mark}_")
    marked = docs.withColumn(mark, F.xxhash64(text))
    joined = marked.join(cuts, marked["doc_id"].eqNullSafe(cuts[id_]) & (marked[mark] == cuts[f"{mark}_"]), "left")
    done = fresh(docs.columns, "_done")
    out = joined.withColumn(done, _without_column(F.col(text), F.col(cut)))
    columns = [F.col(f"{done}.text").alias(text) if c == text else marked[c] for c in docs.columns]
    if figures:
        columns += [F.col(f"{done}.n").alias("n_sentences"), F.col(f"{done}.removed").alias("n_removed")]
    return out.select(*columns)
