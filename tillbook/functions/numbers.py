"""Money arithmetic: exact sums, one recipe for ratios, null rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"
COUNT = "decimal(18,0)"


def ratio(numerator: Column, denominator: Column, scale: int, factor: float = 1.0) -> Column:
    """``round(numerator / denominator * factor, scale)``, NULL for a zero divisor.

    Sums are exact decimals. A decimal quotient of two wide operands loses
    scale, so the division runs on doubles and the rounding on a decimal, which
    keeps halves away from zero.
    """
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if factor != 1.0:
        quotient = quotient * F.lit(factor)
    return rounded(quotient, scale)


def rounded(value: Column, scale: int) -> Column:
    return F.round(value.cast("decimal(28,8)"), scale)


def weighted(value: Column, copies: Column) -> Column:
    """``value`` counted ``copies`` times, exactly."""
    return value.cast(MONEY) * copies.cast(COUNT)


def known(value: Column, copies: Column) -> Column:
    """``copies`` where ``value`` is known, else NULL: the divisor of a weighted mean."""
    return F.when(value.isNotNull(), copies)


def money_sum(value: Column) -> Column:
    return F.sum(value).cast(MONEY)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(MONEY))


def at_least(floor: int, value: Column) -> Column:
    """The larger of the two; NULL stays NULL (``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(floor), value))


def share_of(value: Column, rate: str) -> Column:
    """``value * rate`` rounded to cents, e.g. a tax."""
    return F.round(value * F.lit(Decimal(rate)), 2)
