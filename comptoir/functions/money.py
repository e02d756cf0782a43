"""Exact, order-free sums of amounts.

A double sum depends on the order in which partial sums meet. Each amount is therefore split into its whole part
and its millionths, both 64-bit integers, which add up exactly and fast; the two sums are put together once per
group, as a decimal. NaN counts as missing; an infinite amount raises. Thresholds on sums are decided on that decimal, doubles come last. Whole parts may add up to
9e18 and 9e12 rows may be summed before an integer overflows, and an overflow raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"
SCALE = 1_000_000


def amount(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast(MONEY)


def known(col: Column) -> Column:
    """Null instead of NaN."""
    return F.when(~F.isnan(col.cast("double")), col)


def parts(col: Column | str) -> tuple[Column, Column]:
    """Whole part and millionths of an amount."""
    col = known(F.col(col) if isinstance(col, str) else col)
    whole = col.cast("bigint")
    rest = col.cast("double") * SCALE - whole.cast("double") * SCALE
    # Halves away from zero, like a cast to a decimal.
    return whole, F.when(rest >= 0, F.floor(rest + 0.5)).otherwise(F.ceil(rest - 0.5)).cast("bigint")


def whole_amount(whole: Column, millionths: Column) -> Column:
    """The decimal amount of two integer sums."""
    return (whole.cast("decimal(20,0)") + millionths.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)


def exact_sum(col: Column | str, where: Column | None = None) -> Column:
    """Decimal sum, 0 when nothing was summed; ``where`` restricts it inside the same aggregation pass."""
    whole, millionths = parts(col)
    if where is not None:
        whole, millionths = F.when(where, whole), F.when(where, millionths)
    return F.coalesce(whole_amount(F.sum(whole), F.sum(millionths)), F.lit(0).cast(MONEY))


def total(col: Column | str, where: Column | None = None) -> Column:
    return exact_sum(col, where).cast("double")


def mean(col: Column | str, where: Column | None = None) -> Column:
    """Exact mean of the non-null values; null when there are none."""
    col = F.col(col) if isinstance(col, str) else col
    value = known(col if where is None else F.when(where, col))
    return ratio(exact_sum(value), F.count(value))


def count_if(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null when the denominator is null or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
