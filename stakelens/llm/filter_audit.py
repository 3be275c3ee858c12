"""Audit of how filters interact, by count-weighted decision diagrams of failure masks.

Every row becomes a mask of the filters it fails. Equal masks are counted per part before anything else, so a part of any size is at
most 2 ** filters cells. A part's cells are the terminals of an ordered decision diagram: one level for each filter, an edge for
passing and one for failing, equal subdiagrams shared, each node weighted with the counts below it. Neighbouring levels are swapped
in place, which rewrites those two levels only; 119 such swaps visit all 120 orders of five filters. In each order the path of
passing edges from the root reads off all steps: the weight across the failing edge is what the step removes, the weight down the passing edge
what it keeps.

Whether a text repeats a smaller id's is found without joining rows: distinct (id, text digest, part, mask, labels) are
counted once, the least id of each digest is grouped from those, and only the rows of that least id are looked up and taken off the count of repeats.

Defined cases: a null text is empty, a null part is the empty string's part. A null id repeats nobody and nobody repeats it, and it has
no labels. Rows alike in id and text are all kept as first. Of several labels for one id any 1 counts. Digests are SHA-256. Texts of any length
are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import checkpointed, text_of

Weights = tuple[int, ...]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions i whose swap with i + 1, one after the other, visits every order of n things once.

    The last thing wanders from end to end; at each end the others make one move of their own.
    """
    if n < 2:
        return
    down = True
    for inner in [*adjacent_swaps(n - 1), None]:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


class Diagram:
    """Ordered decision diagram over named filters; a node is (passing child, failing child) on the level below."""

    def __init__(self, names: str, cells: dict[int, Weights], width: int):
        self.order = list(names)
        zero = (0,) * width
        self.weights: list[list[Weights]] = [[] for _ in range(len(names) + 1)]
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in names]
        known: dict[Weights, int] = {}
        below = []
        for mask in range(1 << len(names)):  # the first filter is the highest bit
            w = cells.get(mask, zero)
            below.append(known.setdefault(w, len(known)))
        self.weights[-1] = list(known)
        for level in reversed(range(len(names))):
            half = len(below) // 2
            pairs = [(below[2 * i], below[2 * i + 1]) for i in range(half)]
            table: dict[tuple[int, int], int] = {}
            below = [table.setdefault(p, len(table)) for p in pairs]
            self.nodes[level] = list(table)
            self._weigh(level)

    def _weigh(self, level: int) -> None:
        w = self.weights[level + 1]
        self.weights[level] = [tuple(a + b for a, b in zip(w[lo], w[hi])) for lo, hi in self.nodes[level]]

    def swap(self, level: int) -> None:
        """Exchange a level with the one below; all other levels stay as they are."""
        table: dict[tuple[int, int], int] = {}
        old = self.nodes[level + 1]
        above = []
        for lo, hi in self.nodes[level]:
            (pp, pf), (fp, ff) = old[lo], old[hi]
            above.append((table.setdefault((pp, fp), len(table)), table.setdefault((pf, ff), len(table))))
        self.nodes[level], self.nodes[level + 1] = above, list(table)
        self._weigh(level + 1)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Weights, Weights]]:
        """Filter, weights kept and weights removed of each step, along the path of passing edges."""
        node = 0
        for level, name in enumerate(self.order):
            lo, hi = self.nodes[level][node]
            yield name, self.weights[level + 1][lo], self.weights[level + 1][hi]
            node = lo


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_steps(names: str, cells: dict[int, Weights]) -> list[tuple]:
    """One row for each order and step: order, step, kept, removed, redundant, unique, good lost, toxic lost, sum over all orders.

    Weights are (rows, good rows, toxic rows).
    """
    diagram = Diagram(names, cells, 3)
    seen = [("".join(diagram.order), list(diagram.steps()))]
    for at in adjacent_swaps(len(names)):
        diagram.swap(at)
        seen.append(("".join(diagram.order), list(diagram.steps())))
    fails, alone, total = {}, {}, dict.fromkeys(names, 0)
    for _, steps in seen:
        fails[steps[0][0]] = steps[0][2][0]  # as the first filter it removes all that fail it
        alone[steps[-1][0]] = steps[-1][2][0]  # as the last one those that fail nothing else
        for name, _, removed in steps:
            total[name] += removed[0]
    return [
        (order, at, kept[0], gone[0], fails[name] - gone[0], alone[name], gone[1], gone[2], total[name])
        for order, steps in seen
        for at, (name, kept, gone) in enumerate(steps, 1)
    ]


def audit(masks: DataFrame, names: str) -> DataFrame:
    """The steps of all orders for each part, from counted masks (part, mask, n, good, toxic); the first filter is the highest bit."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in STEPS.split(", ")]
        for batch in batches:
            for part, cells in zip(batch["part"], batch["cells"]):
                counted = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells}
                yield pd.DataFrame([(part, *row) for row in audit_steps(names, counted)], columns=columns)

    cells = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInPandas(walk, STEPS)


def filters(text: Column) -> list[Column]:
    """Whether the text fails filters A to D: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < 50,
        F.lit(100).cast("long") * distinct < F.lit(65).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted masks of filters A to E for each source: part, mask, n, good, toxic.

    ``docs`` has doc_id, source and text, ``labels`` doc_id, quality and toxic.
    """
    text = text_of()
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
        sum((F.when(f, 1 << at).otherwise(0) for f, at in zip(filters(text), (4, 3, 2, 1))), F.lit(0)).alias("mask"),
    )
    rows = checkpointed(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    one = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = rows.join(one, "doc_id", "left").na.fill(0, ["good", "toxic"])
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)

    def counted(frame: DataFrame, bit: int, sign: int) -> DataFrame:
        return frame.groupBy("part", "mask", "good", "toxic").agg((F.sum("n") * sign).alias("n")).select(
            "part", F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")
        )

    # all rows as if they repeated, then the first ones moved over
    return counted(rows, 1, 1).unionByName(counted(first, 1, -1)).unionByName(counted(first, 0, 1))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over documents, all 120 orders for each source."""
    return audit(failure_masks(docs, labels), "ABCDE")

