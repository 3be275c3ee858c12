"""Name normalisation used as a join key.

Two forms with one meaning (compatibility decomposition without combining characters, trimmed, lower case):

* ``norm_name``: a Column expression for letters of the basic plane, built from the character tables;
* ``name_keys``: Latin names by expression; a dictionary of the distinct names that hold anything else, folded by ``unicodedata`` in
  Arrow batches and looked up. It knows every script, and no row is folded twice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"


def _ranges(codes: Sequence[int]) -> str:
    """A regular expression class of the given code points."""
    out, last = [], None
    for code in codes:
        if last is not None and code == last[1] + 1:
            last[1] = code
        else:
            last = [code, code]
            out.append(last)
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Letters that decompose to one base letter plus marks, those that decompose to several, and the class of marks.

    Hangul is left whole here, as are letters outside the basic plane.
    """
    source, target, several = [], [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
        elif len(base) > 1:
            several[chr(code)] = base
    marks = [code for code in range(0x300, 0x110000) if unicodedata.combining(chr(code))]
    return "".join(source), "".join(target), several, _ranges(marks)


_SOURCE, _TARGET, _SEVERAL, _MARKS = _fold_tables()
_LONG = _ranges(sorted(map(ord, _SEVERAL)))


def _plain(c: Column) -> Column:
    """ASCII only: one byte for each character."""
    return F.octet_length(c) == F.length(c)


def norm_name(c: Column | str) -> Column:
    """Strip accents, trim, lower: letters by translate, loose marks by class, ligatures by lookup where any is left."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.map_from_arrays(F.lit(list(_SEVERAL)), F.lit(list(_SEVERAL.values())))
    single = F.translate(c, _SOURCE, _TARGET)
    spelled = F.array_join(F.transform(F.split(single, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    long = F.when(single.rlike(_LONG), spelled).otherwise(single)
    # most names are done after the letters; the classes are looked at only where something is left
    folded = F.when(_plain(single), single).otherwise(F.regexp_replace(long, _MARKS + "+", ""))
    return F.lower(F.btrim(F.when(_plain(c), c).otherwise(folded), F.lit(WHITESPACE)))


def fold_name(name: str | None) -> str | None:
    """The key of one name."""
    if name is None:
        return None
    return "".join(p for p in unicodedata.normalize("NFKD", name) if not unicodedata.combining(p)).strip(WHITESPACE).lower()


@F.pandas_udf(T.StringType())
def norm_name_full(names: pd.Series) -> pd.Series:
    """Keys of names in any script; Arrow batches."""
    return names.map(fold_name)


def _latin_tables() -> tuple[str, str]:
    """Latin letters and marks for ``translate``: letters with one plain base letter map to it, loose marks are dropped."""
    pairs = {s: t for s, t in zip(_SOURCE, _TARGET) if ord(s) < 0x250 and t.isascii()}
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join([*pairs, *marks]), "".join(pairs.values())


_LATIN, _LATIN_BASE = _latin_tables()


def name_keys(df: DataFrame, name: str, key: str = "name_norm") -> DataFrame:
    """Add the key of ``name``: plain and Latin names by expression, each other distinct name folded once and looked up.

    Latin names never meet the lookup, so it stays as small as the share of names in other scripts.
    """
    from stakelens.operators.ordered import lookup_join

    c = F.col(name)
    latin = F.when(_plain(c), c).otherwise(F.translate(c, _LATIN, _LATIN_BASE))
    rows = df.withColumn("_latin", latin)
    odd = ~_plain(F.col("_latin"))
    folded = rows.where(odd).select(c.alias("_name")).distinct()
    folded = folded.select("_name", norm_name_full("_name").alias("_folded"))
    looked = lookup_join(rows.withColumn("_name", F.when(odd, c)), folded, ["_name"], "left")
    return looked.withColumn(key, F.coalesce("_folded", F.lower(F.btrim("_latin", F.lit(WHITESPACE))))).drop("_name", "_folded", "_latin")


def flip_last_first(c: Column | str) -> Column:
    """'Last, First' -> 'First Last'; names without a comma pass through."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, ",", 2)
    return F.when(
        F.size(parts) == 2,
        F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0)))),
    ).otherwise(c)


def norm_last_first(c: Column | str, fold_accents: bool = True) -> Column:
    flipped = flip_last_first(c)
    return norm_name(flipped) if fold_accents else F.lower(F.trim(flipped))
