"""Mixing to target weights: iterative proportional fitting over cells, then sampling by calibrated probabilities.

Tokens are counted in cells of source, language and topic. Fitting scales the cells in turn so that the totals
of each margin meet its targets, until all do. A document is kept with the probability rate x weight of its cell, decided by a fixed hash of its
id and text, where the rate is the largest at which no probability exceeds 1 (or a given smaller one); so the kept tokens have the
target shares in expectation. Cells stay in tables throughout: the driver sees only the deviation of a round.

Default targets soften the shares that the corpus has: share ** ``temper``, scaled to sum 1. The default topic is a coarse
lexical one: three bits, each telling whether over half of the distinct longer words have that bit in their hash.

Defined cases: null source, language and topic are values of their own; a null or empty text counts one token, so that no
document weighs nothing; rows that repeat get equal results; targets for values that don't occur are left out and the others
scaled up; a value that has no target among given ones has share 0: its rows stay in the result with weight 0 and are not kept. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, fresh, hash_unit, text_of

MARGINS = ("source", "lang", "topic")
_NONE = "\u0000none"
_SMALL_BYTES = 16 << 20


def n_tokens(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.lit(1)).cast("long")


def word_hashes(text: Column, least_letters: int = 5) -> Column:
    """Hashes of the distinct longer words of a text."""
    longer = F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: F.length(w) >= least_letters)
    return F.transform(longer, lambda w: F.xxhash64(w))


def _bit(number: int):
    return lambda h: F.shiftright(h, number).bitwiseAND(F.lit(1)).cast("int")


def lexical_topic(hashes: Column, bits: int = 3) -> Column:
    """A number below 2 ** bits: the majority of each hash bit over the words."""
    total = F.lit(0)
    for b in range(bits):
        bits_b = F.transform(hashes, _bit(b))
        ones = F.aggregate(bits_b, F.lit(0), lambda acc, bit: acc + bit)
        total = total + F.when(ones * 2 > F.size(hashes), F.lit(1 << b)).otherwise(F.lit(0))
    return total.cast("string")


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(margin, target): each value's share of tokens to the power of ``temper``, scaled to sum 1."""
    totals = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("target"))
    return _scaled(totals, cells, margin)


def _scaled(targets: DataFrame, cells: DataFrame, margin: str) -> DataFrame:
    """Targets of the values that occur, scaled to sum 1; a value without a target has target 0."""
    there = cells.select(margin).distinct().join(targets, margin, "left").na.fill(0.0, ["target"])
    whole = there.agg(F.sum("target")).first()[0] or 1.0
    return there.select(margin, (F.col("target") / F.lit(float(whole))).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-5, patience: int = 8) -> tuple[DataFrame, float]:
    """``cells`` (margins, tokens) with the weight that brings every margin to its target shares, and the deviation that is left.

    The deviation is the largest relative change that the last round made to any value. Rounds end when it is at most ``tolerance``, or
    when ``patience`` rounds have not halved it (margins that contradict each other have no solution). Every round is one
    checkpoint and a look at its deviation. Values with target 0 get weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted = cells.withColumn("weight", F.lit(1.0))
    if not total:
        return fitted, 0.0
    for margin, target in targets.items():
        fitted = fitted.join(target.select(margin, F.col("target").alias(f"_to_{margin}")), margin)
    fitted, seen = checkpointed(fitted), []
    while True:
        now = fitted.drop("_moved").withColumn("_moved", F.lit(0.0))
        for margin in targets:
            sums = now.groupBy(margin).agg(F.sum(F.col("weight") * F.col("tokens")).alias("_now"))
            factor = F.when(F.col("_now") > 0, F.col(f"_to_{margin}") * float(total) / F.col("_now")).otherwise(1.0)
            now = now.join(sums, margin).withColumn("_by", factor).withColumns(
                {"weight": F.col("weight") * F.col("_by"), "_moved": F.greatest("_moved", F.abs(F.col("_by") - 1))}
            ).drop("_now", "_by")
        fitted = checkpointed(now)
        seen.append(fitted.agg(F.max(F.when(F.col("weight") > 0, F.col("_moved")))).first()[0] or 0.0)
        stuck = len(seen) > patience and seen[-1] > seen[-1 - patience] / 2
        if seen[-1] <= tolerance or stuck:
            return fitted.select(*cells.columns, "weight"), seen[-1]


def mixed(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, temper: float = 0.9, rate: float | None = None,
    topic: Column | None = None, seed: int = 4, prefix: str = "",
) -> DataFrame:
    """``docs`` with topic, n_tokens, weight, probability, deviation (of the fit) and kept (each named with ``prefix``).

    ``targets`` maps margins (source, lang, topic) to tables (margin, target).
    """
    name = {c: fresh([x for x in docs.columns], f"{prefix}{c}") for c in ("topic", "n_tokens", "weight", "probability", "deviation", "kept")}
    keys = {m: fresh(docs.columns, f"_key_{m}") for m in MARGINS}
    text = text_of()
    made = docs.withColumn(name["n_tokens"], n_tokens(text))
    if topic is None:
        hashes = fresh(made.columns, "_hashes")
        made = made.withColumn(hashes, word_hashes(text))
        made = made.withColumn(name["topic"], lexical_topic(F.col(hashes))).drop(hashes)
    else:
        made = made.withColumn(name["topic"], topic)
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(name["topic"])}
    keyed = made.withColumns({keys[m]: F.coalesce(value[m].cast("string"), F.lit(_NONE)) for m in MARGINS})
    cells = checkpointed(
        keyed.groupBy(*[F.col(keys[m]).alias(m) for m in MARGINS]).agg(F.sum(name["n_tokens"]).alias("tokens"))
    )
    given = targets or {}
    wanted = {
        m: _scaled(given[m].select(F.coalesce(F.col(m).cast("string"), F.lit(_NONE)).alias(m), "target"), cells, m)
        if m in given else tempered(cells, m, temper)
        for m in MARGINS
    }
    fitted, deviation = rake(cells, wanted)
    most = fitted.agg(F.max("weight")).first()[0] or 1.0
    step = min(rate, 1 / most) if rate is not None else 1 / most
    lookup = fitted.select(*[F.col(m).alias(f"{keys[m]}_") for m in MARGINS], F.col("weight").alias(name["weight"]))
    # the texts stay where they are as long as the cells are small enough to travel
    width = sum((F.length(f"{keys[m]}_") for m in MARGINS), F.lit(64))
    if (lookup.agg(F.sum(width)).first()[0] or 0) <= _SMALL_BYTES:
        lookup = F.broadcast(lookup)
    joined = keyed.join(lookup, [keyed[keys[m]] == lookup[f"{keys[m]}_"] for m in MARGINS])
    out = joined.withColumn(name["probability"], F.least(F.col(name["weight"]) * F.lit(step), F.lit(1.0)))
    out = out.withColumn(name["deviation"], F.lit(float(deviation)))
    out = out.withColumn(name["kept"], hash_unit(F.col("doc_id"), text, F.lit(seed)) < F.col(name["probability"]))
    return out.select(*docs.columns, *name.values())


def sample_mixed(docs: DataFrame, temper: float = 0.9, seed: int = 4) -> DataFrame:
    """The documents that the mix keeps, with their own columns."""
    out = mixed(docs, temper=temper, seed=seed, prefix="_mix_")
    return out.where(F.col(out.columns[-1])).select(*docs.columns)


def margin_totals(out: DataFrame, margins: Sequence[str] = MARGINS) -> DataFrame:
    """(margin, value, tokens, expected): what the mix does to each margin."""
    frames = [
        out.groupBy(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")).agg(
            F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")
        )
        for m in margins
    ]
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f)
    return total
