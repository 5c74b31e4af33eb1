"""Numeric columns: rounding, rating scales and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemill import fixed

WHOLE_FROM = float(1 << 52)  # doubles from here on have no places


def round_stored(value: Column, places: int, tie: str = "even") -> Column:
    """Round a double by its stored binary value, not by its printed digits.

    4.005 is stored a little below the tie and becomes 4.00, 4.025 a little above and becomes 4.03;
    ``round`` works on the printed digits and gives 4.01 and 4.03. Real ties go to the even digit or up
    (away from zero). For one or two places. The fraction of a double is exact, so it is rounded in
    whole numbers and put back on the whole part; this is the same for values of any size.
    """
    power = 10**places
    size = F.abs(value)
    entire = F.floor(size)
    part = size - entire
    # A power of two that turns every bit of the fraction into a whole number, with room for the places.
    unit = F.when(size >= 0.5, 1 << 53).when(size >= 0.0625, 1 << 56).otherwise(1 << 60)
    scaled = (part * unit.cast("double")).cast("bigint") * F.lit(power)
    whole = F.call_function("div", scaled, unit)
    rest = scaled - whole * unit
    half = F.shiftright(unit, 1)
    at_tie = F.lit(True) if tie == "up" else whole % 2 == 1
    up = (rest > half) | ((rest == half) & at_tie)
    exact = (entire.cast("double") * power + whole + up.cast("bigint")) / F.lit(float(power))
    return F.when(size >= WHOLE_FROM, value).otherwise(F.signum(value) * exact)


def rescale_vote(vote: Column) -> Column:
    """A vote out of ten as a value out of five with two places; a missing vote is 0."""
    return round_stored(F.coalesce(vote, F.lit(0.0)) / 2, 2)


def half_star(value: Column) -> Column:
    """Clamp to the rating range and move to the nearest half star, ties to the even half; null stays null."""
    clamped = F.least(F.lit(fixed.RATING_MAX), F.greatest(F.lit(fixed.RATING_MIN), value))
    return F.when(value.isNotNull(), F.bround(clamped * 2) / 2)


def mean_of_tenths(sum10: Column, n: Column) -> Column:
    """ROUND(mean, 2) from a sum kept in tenths and a count, in whole numbers, so it is rounded once."""
    hundredths = F.call_function("div", sum10 * 20 + n, n * 2)
    return (hundredths.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(3,2)")


def one_place(value: Column, default: str = fixed.NO_AVERAGE_STATS) -> Column:
    """A mean as text with one place; the default text where there is none."""
    shown = round_stored(value.cast("double"), 1, tie="up").cast("decimal(18,1)").cast("string")
    return F.coalesce(shown, F.lit(default))


def average_label(average: Column) -> Column:
    """A stored average as text with one place; a label where it is missing or 0."""
    return one_place(F.nullif(average, F.lit(0).cast("decimal(3,2)")), fixed.NO_AVERAGE_LABEL)


def or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))
