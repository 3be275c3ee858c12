"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decode.

The merges of a rank file are compiled into a finite-state transducer that reads a
piece byte by byte. It rests on one property of rank-ordered merging: a token sequence is the
encoding of its bytes exactly when each neighbouring pair encodes to itself. So the encoding of
every prefix ends in the longest vocabulary suffix that fits the encoding of what stands before
it. A token is emitted once the encodings up to all positions that may still matter agree on it.

Texts are cut in two steps: into runs of non-space with at most one leading blank (a cut that the
split pattern makes too, whatever stands around), then each distinct run by the pattern itself.
Results by run are kept in a bounded table.

Defined cases: a null or empty text gives an empty id list; ids outside the vocabulary and null ids decode to
nothing; a null id list decodes to empty bytes. Rows are independent: repeated rows, ties and other columns
pass through untouched.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm.common import fresh

#: White space of the split pattern (fixed value: the Unicode White_Space property).
_WS = "\t-\r \x85\xa0  -     　"
#: Plain Latin letters (fixed value: letters of the first two Unicode blocks that hold no other signs).
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: A word of Latin letters that ends at an ASCII character or the end is a piece of the pattern by itself.
_RUNS = re.compile(f" ?[{_LATIN}]++(?=[\\x00-\\x7f]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WORD = re.compile(f" ?[{_LATIN}]+")

_START = -1
_MAX_RUNS = 300_000  # entries of each of two run tables and of the pair table: a bound on memory, not on results
_MAX_PAIRS = 300_000
_ROWS = 256
_CHUNK = 1 << 14  # ids decoded at a time
_LONG = 256  # bytes after which settled tokens are emitted


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file (a vocabulary: bounded, not data)."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(t): int(r) for t, _, r in (x.partition(" ") for x in lines) if t}


class MergeTransducer:
    """Encodes byte strings as rank-ordered merging would.

    The deterministic state is kept in two parts: the node (longest suffix that is a prefix of some token) and one
    register for each position that the node still covers, holding the last token of the encoding up to there.
    Nodes and arcs are made when first walked. An arc lists the tokens that may end at its byte, longest first; the
    first that fits the register where it starts is the last token of the new prefix.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._prefixes = {t[:n] for t in ranks for n in range(len(t) + 1)}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._nodes: list[bytes] = [b""]
        self._number: dict[bytes, int] = {b"": 0}
        self._arcs: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self._fits: dict[int, bool] = {}

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain merging by rank, stopping when ``until`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            piece = self.bytes_of[token]
            parts = self.merged(piece, 2) if len(piece) > 1 else ()
            self._halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts at one end of a token, from itself down to a byte, each with the rank that absorbs it."""
        out, absorbed = [], 1 << 60
        while True:
            out.append((self.bytes_of[token], absorbed))
            halves = self._made_of(token)
            if halves is None:
                return out
            absorbed, token = token, halves[side]

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart: no merge across their border comes before both its parts are absorbed.

        Of equal merges the leftmost goes first, hence < on the left side and <= on the right one.
        """
        heads = self._edge(right, 0)
        for tail, until in self._edge(left, 1):
            for head, until_head in heads:
                rank = self.ranks.get(tail + head)
                if rank is not None and rank < until and rank <= until_head:
                    return False
        return True

    def _arc(self, node: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        grown = self._nodes[node] + bytes((byte,))
        sizes = range(len(grown), 0, -1)
        ends = tuple((n, self.ranks[t]) for n in sizes if (t := grown[len(grown) - n :]) in self.ranks)
        if not ends or ends[-1][0] != 1:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        suffix = next(s for cut in range(len(grown) + 1) if (s := grown[cut:]) in self._prefixes)
        if suffix not in self._number:
            self._number[suffix] = len(self._nodes)
            self._nodes.append(suffix)
        arc = (self._number[suffix], ends)
        self._arcs[node << 8 | byte] = arc
        return arc

    def _back(self, last: list[int], size: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _settled(self, size: list[int], live: int) -> int:
        """The last position through which the encodings up to each of the ``live`` newest positions all pass."""
        end = len(size) - 1
        paths = {end - k for k in range(live)}
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(far - size[far])
        return paths.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last, size, node = [_START], [0], 0
        for start in range(0, len(piece), _LONG):
            node = self._read(piece[start : start + _LONG], node, last, size)
            if start + _LONG < len(piece):  # emit what no later byte can change, so that registers stay few
                done = self._settled(size, len(self._nodes[node]) + 1)
                out.extend(self._back(last, size, done))
                last, size = last[done:], [0, *size[done + 1 :]]
        return out + self._back(last, size, len(last) - 1)

    def _read(self, piece: bytes, node: int, last: list[int], size: list[int]) -> int:
        arcs, fits = self._arcs, self._fits
        here = len(last)
        for byte in piece:
            arc = arcs.get(node << 8 | byte)
            if arc is None:
                arc = self._arc(node, byte)
            node = arc[0]
            for n, token in arc[1]:
                left = last[here - n]
                if left < 0:
                    break
                fit = fits.get(left << 32 | token)
                if fit is None:
                    if len(fits) >= _MAX_PAIRS:
                        fits.clear()
                    fit = fits[left << 32 | token] = self.pair_fits(left, token)
                if fit:
                    break
            last.append(token)
            size.append(n)
            here += 1
        return node


class _Runs(dict):
    """Ids of runs as the bytes of an int32 array; what is missing is made.

    Two tables: when the newer one is full it becomes the older one, whose entries move over again as they are met. So common runs
    stay known, whatever passes by.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, run: str) -> bytes:
        ids = self._older.get(run)
        if ids is None:
            ids = self._make(run)
        if len(self) >= _MAX_RUNS:
            self._older = dict(self)
            self.clear()
        if len(run) <= 64:
            self[run] = ids
        return ids


class Encoder:
    """Cuts texts by the pattern and encodes the runs, keeping what it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self._split = regex.compile(pattern)
        self._machine = MergeTransducer(ranks)
        self._pieces = _Runs(self._piece)
        self._runs = _Runs(self._run)

    def _piece(self, piece: str) -> bytes:
        ids = self._machine.encode(piece.encode("utf-8"))
        return struct.pack(f"{len(ids)}i", *ids)

    def _run(self, run: str) -> bytes:
        if _WORD.fullmatch(run):
            return self._piece(run)
        return b"".join([self._pieces[p] for p in self._split.findall(run)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._runs.__getitem__, _RUNS.findall(text))), np.int32)


class TokenBytes:
    """Bytes by id; one entry past the vocabulary stands for every id outside it and decodes to nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        entries = [b""] * (self.size + 1)
        for token, i in ranks.items():
            entries[i] = token
        self._blob = np.frombuffer(b"".join(entries), np.uint8)
        self._length = np.array([len(e) for e in entries], np.int64)
        self._start = np.cumsum(self._length) - self._length

    def known(self, ids: Iterable[int | None]) -> np.ndarray:
        return np.array([i if i is not None and 0 <= i < self.size else self.size for i in ids], np.int32)

    def join(self, ids: np.ndarray) -> bytes:
        length = self._length[ids]
        at = np.cumsum(length)
        return self._blob[np.arange(at[-1] if len(at) else 0) + np.repeat(self._start[ids] - at + length, length)].tobytes()


class StreamDecoder:
    """Text from ids that arrive in pieces, by an incremental UTF-8 state machine: a character appears when its last byte has come.

    ``errors`` says what becomes of bytes that are no UTF-8: "replace" for reading, "surrogateescape" keeps them, so that
    encoding the text the same way gives the bytes back.
    """

    def __init__(self, table: TokenBytes, errors: str = "replace"):
        self._table = table
        self._utf8 = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: np.ndarray) -> str:
        return self._utf8.decode(self._table.join(ids))

    def close(self) -> str:
        return self._utf8.decode(b"", True)


def stream_text(table: TokenBytes, ids: np.ndarray, errors: str = "replace") -> str:
    """The whole text of a row of ids, decoded piece by piece."""
    stream = StreamDecoder(table, errors)
    return "".join([stream.feed(ids[i : i + _CHUNK]) for i in range(0, len(ids), _CHUNK)]) + stream.close()


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _shared_encoder(key: int, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker process, whatever the number of tasks."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[key, pattern]


def _digest(ranks: dict[bytes, int]) -> int:
    import xxhash

    h = xxhash.xxh64()
    for token, rank in ranks.items():
        h.update(token + b"\x00%d\x00" % rank)
    return h.intdigest()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Short runs of rows: a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for start in range(0, len(batch), _ROWS):
            yield batch.slice(start, _ROWS)


def encode_column(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Token ids (array<int>) of a text column and the bytes that the ids decode to as a stream: struct<ids, decoded>."""
    shared, key = spark.sparkContext.broadcast(ranks), _digest(ranks)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, table = _shared_encoder(key, shared.value, pattern), TokenBytes(shared.value)
        for rows in _slices(batches):
            ids = [encoder.encode(text.as_py() or "") for text in rows]
            out = [stream_text(table, row, "surrogateescape").encode("utf-8", "surrogateescape") for row in ids]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(out, pa.binary())], ["ids", "decoded"])

    return encode(text)


def decode_text_column(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """Text of a column of token ids, broken characters replaced, decoded as a stream."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TokenBytes(shared.value)
        for rows in _slices(batches):
            yield pa.array([stream_text(table, table.known(row.as_py() or [])) for row in rows], pa.string())

    return decode(ids)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the ids of each text and the bytes they decode to, in two more columns at the end: ``ids`` and ``decoded``,
    with leading underscores where ``docs`` has columns of those names."""
    spark = docs.sparkSession
    coded, ids, decoded = (fresh(docs.columns, c) for c in ("_coded", ids, decoded))
    out = docs.withColumn(coded, encode_column(spark, F.col(text), read_ranks(spark, ranks_path), pattern))
    return out.withColumns({ids: F.col(f"{coded}.ids"), decoded: F.col(f"{coded}.decoded")}).drop(coded)
