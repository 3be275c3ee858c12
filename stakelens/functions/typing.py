"""Lenient typing of text columns: bad values become NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: spellings that count as true
TRUE_WORDS = ("true", "t", "1")


def try_int(name: str) -> Column:
    return F.col(name).try_cast("int")


def try_double(name: str) -> Column:
    return F.col(name).try_cast("double")


def try_date(name: str) -> Column:
    return F.col(name).try_cast("date")


def try_timestamp(name: str) -> Column:
    return F.col(name).try_cast("timestamp")


def truthy(name: str) -> Column:
    """NULL stays NULL, every other spelling is false."""
    return F.lower(F.col(name)).isin(*TRUE_WORDS)


def not_flagged(name: str) -> Column:
    """True unless the flag column spells true; NULL counts as unflagged."""
    return ~F.lower(F.coalesce(F.col(name), F.lit("false"))).isin(*TRUE_WORDS)


def signed_number(name: str) -> Column:
    """'+1.5' -> 1.5"""
    return F.replace(F.col(name), F.lit("+"), F.lit("")).try_cast("double")


def innings_to_outs(name: str) -> Column:
    """'5.2' -> 17: whole innings times three plus the base-3 fraction digit (unknown digit or text -> 0)."""
    value = F.col(name).try_cast("double")
    whole = F.floor(value)
    digit = F.round((value - whole) * 10).cast("int")
    outs = whole * 3 + F.when(digit.isin(1, 2), digit).otherwise(F.lit(0))
    return F.coalesce(outs.cast("int"), F.lit(0))


def innings_decimal(name: str) -> Column:
    """'5.2' -> 5.666..."""
    return innings_to_outs(name) / F.lit(3.0)


def cast_prefixed(df: DataFrame, prefix: str, to: str = "double") -> DataFrame:
    """Leniently cast every column whose name starts with the prefix."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in prefixed(df, prefix)})


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
