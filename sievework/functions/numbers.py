"""Number expressions with the policies that scores and rates need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a over b, null over nothing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def ratio_at_least_one(a: Column, b: Column) -> Column:
    """a over b, or over 1 where b is less."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def normalized(x: Column, most: Column) -> Column:
    """x as hundredths of the greatest value, between 0 and 100; 0 where there is no greatest value."""
    return F.when(most > 0, bounded(100.0 * x / most)).otherwise(F.lit(0.0))


def geometric(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(a * b, F.lit(0.0)))


def rounded(x: Column, places: int = 6) -> Column:
    """Half to even, as binary floating-point rounding does."""
    return F.bround(x, places)


def truthy(x: Column) -> Column:
    """Whether a text says yes; null says no."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y"), F.lit(False))
