"""Hidden Markov language model: Baum-Welch over partitions, scaled forward recursion for exact likelihoods.

Tokens are the lower-cased (A-Z) words of a text and one end. The ``frequent`` most common tokens of the training texts are symbols of their
own; all others share ``classes`` symbols by hash. A state emits a symbol, and a class emits its words in proportion to
count + 1 (one more share for all unseen words), so every token of any text has a probability. What a task must hold
is thus bounded (symbols x states), while counts of all other words stay in a table and meet the texts in a join.

Training: each pass of Baum-Welch sums the expected counts of states, moves and emissions over partitions, combined per task and added up by symbol.
Texts are turned into symbols once and written, for training and for scoring; each of the ``passes`` reads all training texts, and one without tokens
leaves the model as it is. In training
texts are cut into stretches of ``_STRETCH`` tokens, each read with ``_OVERLAP`` more on either side that are not counted, so that a
stretch has the states around it, moves across cuts count once and only the text's own start is a start; scoring runs over whole texts.

Defined cases: a null text is empty and consists of its end; rows that repeat are scored each; null ids count as training rows. Without
training rows every token is unseen. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, table, text_of  # noqa: F401
from stakelens.session import work_path

END = b""
_STRETCH, _OVERLAP, _CELLS, _DOCS, _FLUSH = 1024, 64, 200_000, 2048, 400_000


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), END]


def word_class(word: bytes, classes: int) -> int:
    """The class of an infrequent word; SQL: pmod(xxhash64(word), classes)."""
    import xxhash

    h = xxhash.xxh64_intdigest(word, 42)
    return (h - (1 << 64) if h >> 63 else h) % classes


def is_held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over a one-column frame of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"]
            )

        for batch in batches:
            for value in batch.column(0):
                held.update(tokens(value.as_py() or ""))
                if len(held) > _FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Symbols:
    """Frequent tokens and their training counts, most common first; n and v: training tokens, all and distinct."""

    frequent: tuple[tuple[bytes, int], ...]
    classes: int
    n: int
    v: int

    def lookup(self) -> dict[bytes, int]:
        return {w: i for i, (w, _) in enumerate(self.frequent)}


class Hmm:
    """start (S), move (S x S), emit (symbols x S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def beginning(unigram: np.ndarray, states: int, seed: int = 3) -> Hmm:
        """States that last, each with its own random leaning towards symbols."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0, 0.7, (len(unigram), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each sequence of symbols, by the forward recursion scaled at each step."""
        order = np.argsort([-len(r) for r in rows], kind="stable")
        sizes = np.array([len(rows[i]) for i in order])
        flat = np.concatenate([rows[i] for i in order])
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        total, alpha, ones = np.zeros(len(rows)), None, np.ones((len(self.start), 1))
        for t, a in enumerate(live.tolist()):
            alpha = self.start if alpha is None else alpha[:a] @ self.move
            alpha = alpha * self.emit[flat[offsets[:a] + t]]
            scale = alpha @ ones
            alpha /= scale
            total[:a] += np.log(scale[:, 0])
        out = np.empty(len(rows))
        out[order] = total
        return out

    def expected(
        self, rows: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray], counted: list[tuple[int, int]] | None = None
    ) -> None:
        """Add the expected counts of starts, moves and emissions over sequences of like length to ``into``.

        ``counted``: of each sequence the tokens (from, to) that count, with the moves into them; from 0 it is a start.
        """
        sizes = np.array([len(r) for r in rows])
        steps, n, s = sizes.max(), len(rows), len(self.start)
        there = np.arange(steps)[:, None] < sizes[None, :]
        symbols = np.zeros((steps, n), np.int64)
        symbols.T[there.T] = np.concatenate(rows)
        emit = self.emit[symbols]
        emit[~there] = 1.0
        alpha, scale, ones = np.empty((steps, n, s)), np.empty((steps, n, 1)), np.ones((s, 1))
        for t in range(steps):
            now = (self.start if t == 0 else alpha[t - 1] @ self.move) * emit[t]
            np.matmul(now, ones, out=scale[t])
            np.divide(now, scale[t], out=alpha[t])
        ahead = emit  # becomes emission x backward / scale, as seen from the step before
        ahead /= scale
        beta, back = np.empty((steps, n, s)), np.ascontiguousarray(self.move.T)
        beta[-1] = 1.0
        for t in range(steps - 1, 0, -1):
            ahead[t] *= beta[t]
            np.matmul(ahead[t], back, out=beta[t - 1])
            beta[t - 1][~there[t]] = 1.0  # a sequence that has not begun (from behind)
        gamma = np.multiply(alpha, beta, out=beta)
        gamma /= gamma @ ones
        counts = there
        if counted is not None:
            span, at = np.array(counted), np.arange(steps)[:, None]
            counts = there & (at >= span[:, 0]) & (at < span[:, 1])
        gamma[~counts] = 0.0
        ahead[~counts] = 0.0
        starts, moves, emissions = into
        starts += gamma[0].sum(axis=0)
        if steps > 1:
            moves += self.move * (alpha[:-1].reshape(-1, s).T @ ahead[1:].reshape(-1, s))
        for z in range(s):
            emissions[:, z] += np.bincount(symbols.ravel(), gamma[:, :, z].ravel(), len(emissions))

    @staticmethod
    def from_counts(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray) -> Hmm:
        """The next model; each state's emissions are mixed with the unigram distribution (Witten-Bell).

        The share of the latter is distinct / (distinct + tokens), a symbol expected less than once counting in part.
        """
        total = emissions.sum(axis=0)
        kinds = np.minimum(emissions, 1.0).sum(axis=0) + 1e-9
        share = kinds / (kinds + total)
        known = np.where(total > 0, emissions / np.maximum(total, 1e-300), unigram[:, None])
        move = moves + 0.1
        start = starts + 0.1
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), (1 - share) * known + share * unigram[:, None])


def _symbol_rows(words: list[bytes], of: dict[bytes, int], classes: int) -> np.ndarray:
    m = len(of)
    return np.array([i if (i := of.get(w)) is not None else m + word_class(w, classes) for w in words], np.int64)


def stretches(row: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """A text's stretches with their surroundings, and which of the tokens count."""
    for at in range(0, len(row), _STRETCH):
        begin = max(0, at - _OVERLAP)
        yield row[begin : at + _STRETCH + _OVERLAP], (at - begin, min(at + _STRETCH, len(row)) - begin)


_RARE = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))
_WRITTEN = "doc_id long, learns boolean, symbols array<int>, n_known long, base double, rare array<struct<word:binary,tf:int>>"


def _written(docs: DataFrame, symbols: Symbols, learns: Column) -> DataFrame:
    """(row, doc_id, learns, symbols, n_known, base, rare) of each text, written once for all passes and for scoring.

    n_known and base are those of its frequent tokens; rare holds the others. Row numbers given here are the same for whoever reads them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    each = float(np.log10(symbols.n + symbols.v + 1))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        of, m = known.lookup(), len(known.frequent)
        log_count = np.log10(np.array([c for _, c in known.frequent] + [0.0]) + 1)
        for batch in batches:
            for at in range(0, len(batch), _DOCS):
                some = batch.slice(at, _DOCS)
                rows, rare, known_, base = [], [], [], []
                for text in some.column(2):
                    words = tokens(text.as_py() or "")
                    row = _symbol_rows(words, of, known.classes)
                    others = Counter([words[i] for i in np.nonzero(row >= m)[0].tolist()])
                    frequent = row[row < m]
                    rows.append(row.astype(np.int32))
                    rare.append([{"word": w, "tf": tf} for w, tf in others.items()])
                    known_.append(len(frequent))
                    base.append(log_count[frequent].sum() - each * len(row))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), lists, pa.array(known_, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, _RARE)],
                    ["doc_id", "learns", "symbols", "n_known", "base", "rare"],
                )

    path = work_path(docs.sparkSession, "symbols")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), text_of().alias("text"))
    texts.mapInArrow(look_up, _WRITTEN).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _pass(texts: DataFrame, symbols: Symbols, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over a one-column frame of symbol lists."""
    spark, states = texts.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names = [f"s{z}" for z in range(states)]
    size = len(symbols.frequent) + symbols.classes

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        counts = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        waiting: list[tuple[np.ndarray, tuple[int, int]]] = []
        held = 0

        def work(least: int) -> None:
            """Longest first, sequences of like length together, up to a number of cells."""
            nonlocal waiting, held
            waiting.sort(key=lambda w: len(w[0]))
            while held > least:
                n = max(1, _CELLS // len(waiting[-1][0]))
                some, waiting = waiting[-n:], waiting[:-n]
                held -= sum(len(w[0]) for w in some)
                now.expected([w[0] for w in some], counts, [w[1] for w in some])

        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                for piece in stretches(flat[a:b]):
                    waiting.append(piece)
                    held += len(piece[0])
                if held >= 4 * _CELLS:
                    work(_CELLS)
        work(0)
        # starts and moves travel as symbols below zero
        starts, moves, emissions = counts
        used = np.nonzero(emissions.sum(axis=1))[0]
        key = np.concatenate([[-1], -2 - np.arange(states), used])
        rows = np.concatenate([starts[None, :], moves, emissions[used]])
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(rows[:, z]) for z in range(states)]], ["symbol", *names])

    schema = ", ".join(["symbol long", *[f"{c} double" for c in names]])
    summed = texts.mapInArrow(gather, schema).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    key = summed["symbol"].to_numpy()
    rows = np.stack([summed[c].to_numpy() for c in names], axis=1) if len(key) else np.zeros((0, states))
    out = np.zeros((size + states + 1, states))
    out[key + states + 1] = rows
    return out[states], out[:states][::-1], out[states + 1 :]


@dataclass(frozen=True)
class Trained:
    symbols: Symbols
    model: Hmm
    words: DataFrame  # (word, c) of the training tokens
    class_totals: np.ndarray  # denominators of the classes


def train(docs: DataFrame, frequent: int = 65_536, classes: int = 4096, states: int = 8, passes: int = 4) -> Trained:
    """Learn from the texts of ``docs`` (doc_id, text)."""
    symbols, words, totals, unigram = _vocabulary(docs, frequent, classes)
    model = _learned(_written(docs, symbols, F.lit(True)), symbols, unigram, states, passes)
    return Trained(symbols, model, words, totals)


def train_and_score(
    docs: DataFrame, learns: Column, frequent: int = 65_536, classes: int = 4096, states: int = 8, passes: int = 4
) -> tuple[Trained, DataFrame]:
    """A model of the rows where ``learns``, and the scores of all rows; texts become symbols once for both."""
    symbols, words, totals, unigram = _vocabulary(docs.where(learns), frequent, classes)
    rows = _written(docs, symbols, learns)
    trained = Trained(symbols, _learned(rows.where("learns"), symbols, unigram, states, passes), words, totals)
    return trained, _scored(rows, trained)


def _vocabulary(docs: DataFrame, frequent: int, classes: int) -> tuple[Symbols, DataFrame, np.ndarray, np.ndarray]:
    texts = docs.select("doc_id", text_of().alias("text"))
    words = checkpointed(token_counts(texts.select("text")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("c"), "word").limit(frequent).collect()
    symbols = Symbols(tuple((bytes(r.word), r.c) for r in top), classes, n, v)
    of_class = F.pmod(F.xxhash64("word"), F.lit(classes))
    least = (symbols.frequent[-1][1], symbols.frequent[-1][0]) if symbols.frequent else (0, b"")
    rare = words.where((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("word") > F.lit(bytearray(least[1])))))
    totals = np.ones(classes)  # one share for all unseen words of a class
    for r in rare.groupBy(of_class.alias("k")).agg(F.sum(F.col("c") + 1).alias("t")).collect():
        totals[r.k] += r.t
    unigram = np.concatenate([[c + 1 for _, c in symbols.frequent], totals])
    unigram = unigram / unigram.sum()
    return symbols, words, totals, unigram


def _learned(rows: DataFrame, symbols: Symbols, unigram: np.ndarray, states: int, passes: int) -> Hmm:
    model = Hmm.beginning(unigram, states)
    for _ in range(passes):
        counts = _pass(rows.select("symbols"), symbols, model)
        if not counts[2].any():
            break  # no training tokens: there is nothing to learn from
        model = Hmm.from_counts(*counts, unigram)
    return model


def score_documents(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for all rows of ``docs`` (doc_id, text)."""
    return _scored(_written(docs, trained.symbols, F.lit(False)), trained)


def _scored(rows: DataFrame, trained: Trained) -> DataFrame:
    classes, shared = trained.symbols.classes, rows.sparkSession.sparkContext.broadcast(trained.model)
    kind = "row long, doc_id long, n_tokens long, n_known long, base double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _DOCS):
                some = batch.slice(at, _DOCS)
                lists = some.column(2)
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                texts = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.diff(ends).astype(np.int64)), some.column(3), some.column(4),
                     pa.array(shared.value.scores(texts) / np.log(10))],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score"],
                )

    scored = rows.select("row", "doc_id", "symbols", "n_known", "base").mapInArrow(score, kind)
    others = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    found = others.join(trained.words, "word", "left")
    totals = F.lit([float(t) for t in np.log10(trained.class_totals)])
    plus = F.log10(F.coalesce("c", F.lit(0)) + 1)
    within = plus - F.get(totals, F.pmod(F.xxhash64("word"), F.lit(classes)).cast("int"))
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * plus).alias("more_base"),
        F.sum(F.col("tf") * within).alias("more_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2
