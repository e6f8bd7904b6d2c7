"""Guarded ratios.

All rates are DOUBLE, rounded half-up to five digits, and 0.0 where the denominator is zero or missing. Money is added up as DECIMAL,
so a sum does not depend on the order in which its parts arrive, and a rate of money is rounded once, from the exact quotient.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: digits kept by every published rate.
RATE_DIGITS = 5

# One amount as it enters a sum, and a sum as it enters a rate.
AMOUNT = "decimal(18, 6)"
TOTAL = "decimal(28, 10)"


def money(total: Column) -> Column:
    """A sum of money as an exact number; from a DOUBLE its shortest decimal form. NULL where it is none (NaN, or beyond 18 digits)."""
    return total.try_cast(TOTAL)


def stable_round(value: Column) -> Column:
    """Half-up rounding of a quotient of float sums."""
    return F.round(F.round(value, 12), RATE_DIGITS)


def half_up(num: Column, den: Column) -> Column:
    """The quotient of two decimals (``den`` not zero), rounded half-up to five digits from its exact value, as DOUBLE.

    The rounded quotient is a whole number of units of the last digit, so a division without remainder gives it. Quotients too large for
    that have no such digits in a DOUBLE anyway.
    """
    units = 10**RATE_DIGITS
    n, d = F.abs(num), F.abs(den)
    whole = F.call_function("div", n * F.lit(2 * units) + d, d * F.lit(2))
    exact = (whole.cast("decimal(19, 0)") * F.lit(Decimal(1) / units)).cast("double")
    size = F.when(n.cast("double") < d.cast("double") * F.lit(1e12), exact).otherwise(n.cast("double") / d.cast("double"))
    return F.when((num < 0) != (den < 0), -size).otherwise(size)


def _guarded(numerator: Column, denominator: Column, finish) -> Column:
    den = F.coalesce(denominator.cast("double"), F.lit(0.0))
    num = F.coalesce(numerator.cast("double"), F.lit(0.0))
    return F.when(den == 0.0, F.lit(0.0)).otherwise(finish(num / den))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of counts as a rounded double; 0.0 for a zero or NULL denominator."""
    return _guarded(numerator, denominator, lambda q: F.round(q, RATE_DIGITS))


def money_ratio(numerator: Column, denominator: Column) -> Column:
    """``safe_ratio`` of a sum of money."""
    num = F.coalesce(money(numerator), F.lit(0).cast(TOTAL))
    den = F.coalesce(money(denominator), F.lit(0).cast(TOTAL))
    return F.when(den == 0, F.lit(0.0)).otherwise(half_up(num, den))


def ctr(clicks: Column, impressions: Column) -> Column:
    return safe_ratio(clicks, impressions)


def cvr(conversions: Column, clicks: Column) -> Column:
    return safe_ratio(conversions, clicks)


def rpm(gmv: Column, impressions: Column) -> Column:
    """Revenue per thousand impressions."""
    return money_ratio(money(gmv) * F.lit(1000), impressions)


def roi(gmv: Column, cost: Column) -> Column:
    return money_ratio(gmv, cost)


def growth_rate(current: Column, previous: Column) -> Column:
    """Relative change against ``previous``; NULL where there is nothing to compare with."""
    now, before = money(current), money(previous)
    return F.when(before != 0, half_up((now - before).cast(TOTAL), before))


def spend_flag(cost: Column) -> Column:
    """1 where money was spent, else 0 (a NULL cost counts as none)."""
    return F.coalesce((cost > 0).cast("int"), F.lit(0))
