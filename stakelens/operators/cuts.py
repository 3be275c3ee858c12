"""Cuts and bins: every row is labelled with all the cuts it meets, then grouped once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.operators.stats import merge_moments, moments, stats_from_moments


def gate_cuts() -> list[tuple[str, Column]]:
    minus = F.col("odds") < 0
    return [
        ("all", F.lit(True)),
        ("minus-money", minus),
        ("conf>=60 minus-money", minus & (F.col("confidence") >= 60)),
    ]


_WORD = 62  # cuts to a mask column


def cut_masks(cuts: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """Mask columns, as many as the cuts need; bit i % 62 of word i // 62 is set when the row meets cut i."""
    masks: dict[str, Column] = {}
    for i, (_, cond) in enumerate(cuts):
        word = f"_mask{i // _WORD}"
        bit = F.when(cond, F.lit(1 << i % _WORD).cast("long")).otherwise(F.lit(0).cast("long"))
        masks[word] = masks[word] + bit if word in masks else bit
    return masks


def cut_cells(
    df: DataFrame, by: Sequence[str], cuts: Sequence[tuple[str, Column]], name: str = "cut", clv: str | None = "clv"
) -> DataFrame:
    """Moments per (by, cut). Rows are folded once per membership pattern; only the
    folded cells are then copied to each cut they belong to."""
    masks = cut_masks(cuts)
    cells = moments(df.withColumns(masks), [*by, *masks], clv=clv)

    def member(i: int) -> Column:
        return F.col(f"_mask{i // _WORD}").bitwiseAND(F.lit(1 << i % _WORD).cast("long")) != 0

    labels = F.array(*[F.when(member(i), F.lit(label)) for i, (label, _) in enumerate(cuts)])
    exploded = cells.withColumn(name, F.explode(labels)).where(F.col(name).isNotNull())
    return merge_moments(exploded, [*by, name])


def cut_stats(
    df: DataFrame, by: Sequence[str], cuts: Sequence[tuple[str, Column]], name: str = "cut", clv: str | None = "clv"
) -> DataFrame:
    """The return statistic of every (by, cut) from one pass over the rows."""
    return cut_cells(df, by, cuts, name, clv).select(*by, name, *stats_from_moments(clv=clv is not None))


def cut_order(cuts: Sequence[tuple[str, Column]], name: str = "cut") -> Column:
    """Position of a cut label in the catalogue."""
    order = F.lit(None).cast("int")
    for i, (label, _) in reversed(list(enumerate(cuts))):
        order = F.when(F.col(name) == label, F.lit(i)).otherwise(order)
    return order


def label_rules(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """First matching label."""
    out = F.lit(default)
    for label, cond in reversed(list(rules)):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def half_open(value: Column, edges: Sequence[tuple[float, float]], fmt: str = "[{},{})") -> Column:
    """Label of the half-open range [lo, hi) holding the value; NULL outside all ranges."""
    return label_rules([(fmt.format(lo, hi), (value >= lo) & (value < hi)) for lo, hi in edges])


def odds_bucket(odds: str = "odds") -> Column:
    o = F.col(odds)
    return label_rules(
        [("plus", o >= 100), ("-100..-149", o >= -150), ("-150..-249", o >= -250)], default="<=-250"
    )


def odds_band(odds: str = "odds") -> Column:
    """Bands of the replication sweeps; prices in (-101, 100) belong to none."""
    o = F.col(odds)
    return label_rules(
        [
            ("<=-250", o <= -250),
            ("-249..-150", (o > -250) & (o <= -150)),
            ("-149..-101", (o > -150) & (o <= -101)),
            ("plus", o >= 100),
        ]
    )


# fixed values: the plus-price bins of the fine sweep
PLUS_BINS = (
    (100, 150), (150, 200), (200, 300), (300, 400), (400, 500),
    (500, 700), (700, 1000), (1000, 1500), (1500, 3000), (3000, 999999),
)

# fixed values: the confidence floors, price filters and sides of the grid sweep
CONFIDENCE_FLOORS = (0, 50, 55, 58, 60, 62, 65, 68, 70, 72, 75, 80)
GRID_SIDES = ("both", "over", "under")


def grid_cells(df: DataFrame) -> DataFrame:
    """Coordinates that decide membership of every grid cut: price class and confidence step."""
    o, c = F.col("odds"), F.col("confidence")
    step = F.lit(0)
    for floor in CONFIDENCE_FLOORS[1:]:
        step = F.when(c >= floor, F.lit(floor)).otherwise(step)
    price = label_rules([("plus", o >= 0), ("tight", o > -200), ("edge", o == -200)], default="heavy")
    return df.withColumns({"price_class": price, "conf_step": step})


GRID_PRICES = ("all", "minus", "minus_tight(-101..-200)", "minus_heavy(<=-200)", "plus")


def explode_grid(cells: DataFrame) -> DataFrame:
    """Cells -> the number of every (confidence floor, price filter, side) cut that contains them."""
    price = F.col("price_class")
    member = {
        "all": F.lit(True),
        "minus": price != "plus",
        "minus_tight(-101..-200)": price.isin("tight", "edge"),
        "minus_heavy(<=-200)": price.isin("edge", "heavy"),
        "plus": price == "plus",
    }
    cuts = []
    for i, floor in enumerate(CONFIDENCE_FLOORS):
        for j, name in enumerate(GRID_PRICES):
            for k, side in enumerate(GRID_SIDES):
                inside = (F.col("conf_step") >= floor) & member[name]
                if side != "both":
                    inside = inside & (F.col("side") == side)
                cuts.append(F.when(inside, F.lit((i * len(GRID_PRICES) + j) * len(GRID_SIDES) + k)))
    return cells.withColumn("cut_no", F.explode(F.array(*cuts))).where(F.col("cut_no").isNotNull())


def grid_label(number: str = "cut_no") -> Column:
    labels = [f"conf>={f} {p} {s}" for f in CONFIDENCE_FLOORS for p in GRID_PRICES for s in GRID_SIDES]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(number) + 1)
