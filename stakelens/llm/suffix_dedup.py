"""Removal of bytes that a repeated string of ``LENGTH`` bytes covers, by suffix arrays.

1. Every window of ``LENGTH`` bytes is known by the smallest hash of the ``CONTEXT``-byte strings in it; equal windows share it.
   Stretches of windows with one smallest hash are runs (about one for every 70 bytes, at most ``_PIECE`` windows). Runs whose hash
   occurs nowhere else are out.
2. A run whose bytes occur as another run too is repeated as a whole. The other runs of a hash that occurs again go, each distinct one
   once, to shards by that hash.
3. In a shard windows whose hash occurs once are set aside and equal stretches of the others taken once; of these the suffix array
   is built by induced sorting: suffixes are classified, the leftmost-smaller
   substrings sorted (recursively, if their names aren't unique) and all others induced from them; permuted common prefixes then
   tell which windows equal a neighbour's for ``LENGTH`` bytes.
4. A hash with more than ``most_pieces`` distinct runs (a passage in very many surroundings) would be one long task: its windows
   are compared by a 128-bit hash in a grouping instead, which spreads over all tasks.

Strings are judged on the input; matches never cross documents. Defined cases: a null text is empty; texts below ``LENGTH`` bytes keep
everything; equal texts, repeated rows included, repeat each other and lose everything from ``LENGTH`` bytes on. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import fresh, key_filter, text_of
from stakelens.session import stored

LENGTH, CONTEXT = 400, 256
_SHARD_BYTES, _PIECE = 1 << 16, 4096
_ROWS = 256
_RNG = np.random.default_rng(8)
_BYTES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``size``-byte string of ``data``."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    base = int(_BASE[which])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * _powers(_inverse(base), n), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _powers(base, n - size + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(least hash, first window, last window, whether the hash occurs again within, hash of the run's bytes).

    A window's hash depends on its bytes alone, so a long text is taken by blocks of windows, and a run of a repetitive text
    is cut after ``_PIECE`` windows: what a task sorts at once stays bounded.
    """
    parts = [_block_runs(data[at : at + block + LENGTH - 1], at) for at in range(0, len(data) - LENGTH + 1, block)]
    nothing = [np.empty(0, kind) for kind in (np.int64, np.int32, np.int32, bool, np.int64)]
    return tuple(np.concatenate([none, *[p[i] for p in parts]]) for i, none in enumerate(nothing))


def _block_runs(data: bytes, begin: int) -> tuple[np.ndarray, ...]:
    h = rolling(np.frombuffer(data, np.uint8), CONTEXT)
    width = LENGTH - CONTEXT + 1
    least = _least(h, width)
    first = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    long = np.diff(np.append(first, len(least))) > _PIECE
    if long.any():
        ends = np.append(first[1:], len(least))
        cuts = [np.arange(x + _PIECE, y, _PIECE) for x, y in zip(first[long].tolist(), ends[long].tolist())]
        first = np.sort(np.concatenate([first, *cuts]))
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    # the hash stands at least once in a run; whether twice shows in windows one apart
    again = np.array([(h[x : y + width] == least[x]).sum() > 1 for x, y in zip(first.tolist(), last.tolist())])
    whole = [int.from_bytes(hashlib.blake2b(data[x : y + LENGTH], digest_size=8).digest(), "big", signed=True) for x, y in zip(first.tolist(), last.tolist())]
    return least[first].view(np.int64), (first + begin).astype(np.int32), (last + begin).astype(np.int32), again, np.array(whole, np.int64)


def suffix_array(s: list[int], alphabet: int) -> list[int]:
    """Order of the suffixes of ``s`` (numbers below ``alphabet``), by induced sorting."""
    n = len(s)
    if n < 2:
        return list(range(n))
    smaller = bytearray(n + 1)  # 1: the suffix is smaller than the next one; the empty suffix at n is
    smaller[n] = 1
    for i in range(n - 2, -1, -1):
        smaller[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and smaller[i + 1])
    ends = np.cumsum(np.bincount(np.array(s), minlength=alphabet))
    heads = [0, *ends[:-1].tolist()]
    tails = ends.tolist()
    lefts = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induce(order: list[int]) -> list[int]:
        out = [-1] * n
        at = tails[:]
        for i in reversed(order):
            at[s[i]] -= 1
            out[at[s[i]]] = i
        at = heads[:]
        i = n - 1  # the empty suffix comes first and induces the last one
        out[at[s[i]]] = i
        at[s[i]] += 1
        for j in out:
            if j > 0 and not smaller[j - 1]:
                c = s[j - 1]
                out[at[c]] = j - 1
                at[c] += 1
        at = tails[:]
        for k in range(n - 1, -1, -1):
            j = out[k]
            if j > 0 and smaller[j - 1]:
                c = s[j - 1]
                at[c] -= 1
                out[at[c]] = j - 1
        return out

    if len(lefts) > 1:
        rough = [i for i in induce(lefts) if smaller[i] and i and not smaller[i - 1]]
        following = dict(zip(lefts, [*lefts[1:], n - 1]))
        names, name, before = {}, -1, None
        for i in rough:
            piece = s[i : following[i] + 1] + ([-1] if following[i] == n - 1 and i == lefts[-1] else [])
            if piece != before:
                name, before = name + 1, piece
            names[i] = name
        if name + 1 < len(lefts):
            sub = suffix_array([names[i] for i in lefts], name + 1)
            lefts = [lefts[i] for i in sub]
        else:
            lefts = rough
    return induce(lefts)


def common_prefixes(s: list[int] | bytes, order: list[int], most: int) -> list[int]:
    """Permuted: for each position, the prefix (``most`` at most) it shares with the suffix before it in order."""
    n = len(s)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    out, size = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            size = 0
            continue
        while size < most and i + size < n and j + size < n and s[i + size] == s[j + size]:
            size += 1
        out[i] = size
        size = max(0, size - 1)
    return out


def _sorted_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows occur elsewhere in the pieces, by their suffix array."""
    s: list[int] = []
    starts = []
    for p in pieces:
        starts.append(len(s))
        s.extend(p)
        s.append(256)  # a match of LENGTH bytes inside a piece holds no border
    order = suffix_array(s, 257)
    prefix = common_prefixes(s, order, LENGTH)
    again = np.zeros(len(s), bool)
    for a, b in zip(order, order[1:]):
        if prefix[b] >= LENGTH:
            again[a] = again[b] = True
    return [again[x : x + max(0, len(p) - LENGTH + 1)] for x, p in zip(starts, pieces)]


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows occur elsewhere in the pieces.

    Windows whose hash occurs once cannot; the stretches of the others are sorted, equal stretches once for all.
    """
    hashes = [rolling(np.frombuffer(p, np.uint8), LENGTH) for p in pieces]
    _, back, n = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True, return_counts=True)
    often = n[back] > 1
    out, at = [], 0
    places: dict[bytes, list[tuple[int, int, int]]] = {}
    for i, (p, h) in enumerate(zip(pieces, hashes)):
        out.append(np.zeros(len(h), bool))
        for stretch in _flagged(often[at : at + len(h)]):
            x, y = stretch["x"], stretch["y"]
            places.setdefault(p[x : y + LENGTH], []).append((i, x, y))
        at += len(h)
    found = _sorted_windows(list(places))
    for where, again in zip(places.values(), found):
        for i, x, y in where:
            out[i][x : y + 1] = True if len(where) > 1 else again
    return out


def _runs_column(text: Column) -> Column:
    kind = pa.struct([("v", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("again", pa.bool_()), ("whole", pa.int64())])

    @F.arrow_udf("array<struct<v:long,a:int,b:int,again:boolean,whole:long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), _ROWS):
                found = [runs((t.as_py() or "").encode("utf-8", "replace")) for t in batch.slice(start, _ROWS)]
                offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                columns = [pa.array(np.concatenate([f[i] for f in found])) for i in range(5)]
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind)))

    return of(text)


def _flagged(offsets: np.ndarray) -> list[dict]:
    """Stretches of flagged windows."""
    at = np.nonzero(np.diff(np.concatenate([[0], offsets.astype(np.int8), [0]])))[0]
    return [{"x": int(x), "y": int(y)} for x, y in zip(at[::2], at[1::2] - 1)]


def _as_stretches(o: Column) -> Column:
    """First and last of each row of neighbours in a sorted list without repeats."""

    def of(s: Column) -> Column:
        alone = lambda x, other, gap: F.coalesce(x - other != gap, F.lit(True))
        firsts = F.filter(s, lambda x, i: alone(x, F.get(s, i - 1), 1))
        lasts = F.filter(s, lambda x, i: alone(x, F.get(s, i + 1), -1))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("x"), b.alias("y")))

    return F.get(F.transform(F.array(o), of), F.lit(0))  # bound as a variable, so the list is sorted once, not for each member


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(8)).alias("k2")]


def repeated_stretches(docs: DataFrame, text: str = "text", most_pieces: int = 500) -> DataFrame:
    """(k1, k2, x, y): stretches of windows, first to last, that occur again; k1, k2 stand for the text."""
    value = text_of(text)
    long = docs.where(F.octet_length(text) >= LENGTH)
    made = stored(long.select(*_key(value), _runs_column(value).alias("r")), "runs", 20_000)  # read twice, made once
    rows = made.select("k1", "k2", F.explode("r").alias("r")).select("k1", "k2", "r.*")
    marks = rows.groupBy("v").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1").select("v")
    # most runs stand alone and stay where they are; the few that pass by chance have one row and one kind below
    found = stored(rows.where(key_filter(stored(marks, "marks"))(F.col("v"))), "found")
    pieces = found.groupBy("v", "whole").agg(
        F.count(F.lit(1)).alias("rows"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "a", "b")).alias("p")
    )
    pieces = stored(pieces, "pieces")
    kinds = pieces.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("any"))
    mixed = stored(pieces.join(kinds.where("kinds > 1 or any"), "v").select("v", "whole", "kinds", "p.*"), "mixed")

    wanted = mixed.groupBy("k1", "k2").agg(F.collect_list(F.struct("v", "whole", "kinds", "a", "b")).alias("want"))
    texts = long.select(*_key(value), value.alias("data")).where(key_filter(mixed.select("k1").distinct())(F.col("k1")))
    texts = texts.groupBy("k1", "k2").agg(F.encode(F.first("data"), "utf-8").alias("data"))  # copies of a text travel once for each task
    cut = texts.join(wanted, ["k1", "k2"]).select("data", F.explode("want").alias("w"))
    cut = cut.select("w.v", "w.whole", "w.kinds", F.expr(f"substring(data, w.a + 1, w.b - w.a + {LENGTH})").alias("piece"))
    cut = stored(cut, "cut", 20_000)
    total = mixed.where(F.col("kinds") <= most_pieces).agg(F.sum(F.expr(f"b - a + {LENGTH}"))).first()[0] or 0
    shards = max(1, int(total // _SHARD_BYTES))

    def sort(group: pa.Table) -> pa.Table:
        found_ = repeated_windows([p.as_py() for p in group["piece"]])
        kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        return pa.table({"v": group["v"], "whole": group["whole"], "at": pa.array([_flagged(f) for f in found_], kind)})

    plain = cut.where(F.col("kinds") <= most_pieces).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    sorted_ = plain.groupBy("shard").applyInArrow(sort, "v long, whole long, at array<struct<x:int,y:int>>")

    @F.arrow_udf("array<struct<o:int,h:long,g:long>>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), _ROWS):
                pieces = [np.frombuffer(p.as_py(), np.uint8) for p in batch.slice(start, _ROWS)]
                h, g = ([rolling(a, LENGTH, i).view(np.int64) for a in pieces] for i in (0, 1))
                sizes = [len(x) for x in h]
                o = [np.arange(n, dtype=np.int32) for n in sizes]
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in (o, h, g)], ["o", "h", "g"])
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    windows = cut.where(F.col("kinds") > most_pieces).select("v", "whole", F.explode(hashes("piece")).alias("w")).select("v", "whole", "w.*")
    often = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    hot = windows.join(often, ["h", "g"]).groupBy("v", "whole").agg(_as_stretches(F.array_sort(F.collect_list("o"))).alias("at"))
    parts = sorted_.unionByName(hot).where(F.size("at") > 0)
    full = pieces.where("rows > 1").select("v", "whole", F.lit(None).cast("array<struct<x:int,y:int>>").alias("at"))
    all_ = F.array(F.struct(F.lit(0).alias("x"), (F.col("b") - F.col("a")).alias("y")))
    out = found.drop("again").join(parts.unionByName(full), ["v", "whole"])
    out = out.select("k1", "k2", "a", F.explode(F.coalesce("at", all_)).alias("s"))
    return out.select("k1", "k2", (F.col("a") + F.col("s.x")).alias("x"), (F.col("a") + F.col("s.y")).alias("y"))


def _kept_column(data: Column, stretches: Column) -> Column:
    @F.arrow_udf("struct<kept:binary,n_removed:long,n_spans:long>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
        for texts, lists in batches:
            for start in range(0, len(texts), _ROWS):
                out, some = [], lists.slice(start, _ROWS)
                first, last, ends = (some.values.field(0).to_numpy(), some.values.field(1).to_numpy() + LENGTH, some.offsets.to_pylist())
                for text, a, b in zip(texts.slice(start, _ROWS), ends, ends[1:]):
                    raw, at, kept, removed, spans = text.as_py() or b"", 0, [], 0, 0
                    reach = -1
                    for x, y in sorted(zip(first[a:b].tolist(), last[a:b].tolist())):
                        if x > reach:
                            spans += 1
                            kept.append(raw[at:x])
                            removed += y - x
                        elif y > reach:
                            removed += y - reach
                        reach = at = max(reach, y)
                    kept.append(raw[at:])
                    out.append({"kept": b"".join(kept), "n_removed": removed, "n_spans": spans})
                yield pa.array(out, kind)

    return keep(data, stretches)


def drop_repeated_bytes(docs: DataFrame, text: str = "text", most_pieces: int = 500) -> DataFrame:
    """``docs`` with kept (bytes that stay), n_bytes, n_removed and n_spans, which replace columns of those names; others pass through."""
    # a set: thousands of copies of a text tell the same stretches
    found = repeated_stretches(docs, text, most_pieces).groupBy("k1", "k2").agg(F.collect_set(F.struct("x", "y")).alias("found"))
    a1, a2, b1, b2, at, done = (fresh(docs.columns, c) for c in ("_k1", "_k2", "_f1", "_f2", "_found", "_done"))
    found = stored(found.withColumnsRenamed({"k1": b1, "k2": b2, "found": at}), "stretches")
    k1, k2 = _key(text_of(text))
    keyed = docs.withColumns({a1: k1, a2: k2})
    data = F.encode(text_of(text), "utf-8")

    def with_figures(rows: DataFrame, kept: Column, n_removed: Column, n_spans: Column) -> DataFrame:
        made = {"kept": kept, "n_bytes": F.length(data).cast("long"), "n_removed": n_removed, "n_spans": n_spans}
        return rows.select(*[c for c in docs.columns if c.lower() not in made], *[c.alias(name) for name, c in made.items()])

    # a text that surely keeps everything neither travels to the join nor goes to Python
    may = key_filter(found.select(b1))(F.col(a1))
    joined = keyed.where(may).join(found, (F.col(a1) == F.col(b1)) & (F.col(a2) == F.col(b2)), "left")
    some = F.col(at).isNotNull()
    out = joined.withColumn(done, _kept_column(F.when(some, data), F.coalesce(at, F.array())))
    cut = with_figures(out, F.when(some, F.col(f"{done}.kept")).otherwise(data), F.col(f"{done}.n_removed"), F.col(f"{done}.n_spans"))
    return cut.union(with_figures(keyed.where(~may), data, F.lit(0).cast("long"), F.lit(0).cast("long")))
