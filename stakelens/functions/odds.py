"""Price arithmetic as Column expressions (no UDFs, stays inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_american(odds: Column | str) -> Column:
    """American prices live outside the open interval (-100, 100)."""
    return F.abs(_col(odds)) >= 100


def payout(odds: Column | str) -> Column:
    """Units won per unit staked; NULL for a zero price."""
    o = _col(odds).cast("double")
    return F.when(o > 0, o / F.lit(100.0)).otherwise(F.try_divide(F.lit(100.0), F.abs(o)))


def unit_profit(win: Column | str, odds: Column | str) -> Column:
    """Profit of a one-unit stake; NULL when result or price is unknown."""
    w, o = _col(win), _col(odds)
    return F.when(w.isNull() | o.isNull(), F.lit(None).cast("double")).when(w, payout(o)).otherwise(F.lit(-1.0))


def implied_prob(odds: Column | str) -> Column:
    o = _col(odds).cast("double")
    return F.when(o > 0, F.lit(100.0) / (o + 100.0)).otherwise(-o / (-o + 100.0))


def decimal_to_american(price: Column | str) -> Column:
    """Decimal to American price, rounding half to even; NULL at or below 1."""
    d = _col(price).cast("double")
    return (
        F.when(d.isNull() | (d <= 1.0), F.lit(None).cast("int"))
        .when(d >= 2.0, F.bround((d - 1.0) * 100.0, 0).cast("int"))
        .otherwise(F.bround(F.try_divide(F.lit(-100.0), d - 1.0), 0).cast("int"))
    )


def overround(home: Column | str, away: Column | str) -> Column:
    return implied_prob(home) + implied_prob(away) - 1.0


def fair_prob(home: Column | str, away: Column | str) -> Column:
    """Home probability with the bookmaker margin removed proportionally."""
    h, a = implied_prob(home), implied_prob(away)
    return h / (h + a)


def rating_prob(diff: Column | str) -> Column:
    """Logistic win probability of a rating difference (400-point scale)."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -_col(diff) / F.lit(400.0)))
