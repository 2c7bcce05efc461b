"""Scalar measures: clipping, rounding, weather, seasonality and target transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regression coefficients of the heat index in degrees Celsius, by powers
# (temperature, humidity), with the temperature and humidity from which they hold.
HEAT_INDEX_TERMS = {
    (0, 0): -8.78469475556,
    (1, 0): 1.61139411,
    (0, 1): 2.33854883889,
    (1, 1): -0.14611605,
    (2, 0): -0.012308094,
    (0, 2): -0.0164248277778,
    (2, 1): 0.002211732,
    (1, 2): 0.00072546,
    (2, 2): -0.000003582,
}
HEAT_INDEX_MIN_TEMPERATURE = 27
HEAT_INDEX_MIN_HUMIDITY = 40

# The epidemic season runs from week 48 to week 17; a year has 52 weeks of phase.
SEASON_LAST_WEEK = 17
SEASON_FIRST_WEEK = 48
WEEKS_PER_CYCLE = 52

# Lower edges of the case-count buckets and their labels. A bucket is open
# to the right, so that scaled, non-integer counts fall in exactly one.
COUNT_BUCKETS = [(500, "> 500"), (200, "201-500"), (50, "51-200"), (0, "1-50")]


def clip_low(value: Column, low: float = 0.0) -> Column:
    """max(value, low) that keeps null; ``greatest`` alone would turn null into ``low``."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def heat_index(temperature: Column, humidity: Column) -> Column:
    """Felt temperature; the plain temperature outside the validity range or when null."""
    def power(value: Column, exponent: int) -> Column | None:
        return {0: None, 1: value, 2: value * value}[exponent]

    total = None
    for (i, j), coefficient in HEAT_INDEX_TERMS.items():
        term = F.lit(coefficient)
        for factor in (power(temperature, i), power(humidity, j)):
            if factor is not None:
                term = term * factor
        total = term if total is None else total + term
    hot = (temperature >= HEAT_INDEX_MIN_TEMPERATURE) & (humidity >= HEAT_INDEX_MIN_HUMIDITY)
    return F.when(hot, total).otherwise(temperature)


def season_phase(week: Column) -> tuple[Column, Column]:
    """Sine and cosine of the week's position in the year."""
    angle = F.lit(2.0) * F.pi() * week / F.lit(WEEKS_PER_CYCLE)
    return F.sin(angle), F.cos(angle)


def in_season(week: Column) -> Column:
    return ((week <= SEASON_LAST_WEEK) | (week >= SEASON_FIRST_WEEK)).cast("int")


def approximate_month(week: Column) -> Column:
    """Months of four weeks, held within 1..12."""
    month = F.floor((week - 1) / F.lit(4)) + 1
    return F.least(F.greatest(month, F.lit(1)), F.lit(12)).cast("int")


def log_target(cases: Column) -> Column:
    return F.log1p(cases)


def from_log_target(prediction: Column) -> Column:
    """Back to counts. Negative log predictions count as zero."""
    return F.expm1(clip_low(prediction))


def outbreak_weight(cases: Column) -> Column:
    """Training weight that grows with the log of the count, 1 for empty weeks."""
    return F.log1p(clip_low(cases)) + 1.0


def count_bucket(cases: Column) -> Column:
    label = F.when(cases > COUNT_BUCKETS[0][0], COUNT_BUCKETS[0][1])
    for edge, name in COUNT_BUCKETS[1:]:
        label = label.when(cases > edge, name)
    return label.when(cases == 0, "= 0")


def ladder(value: Column, steps: Sequence[tuple[Column, str]], below: str | None = None) -> Column:
    """Name of the highest threshold that ``value`` reaches; ``steps`` ascend."""
    label = F.lit(below).cast("string")
    for threshold, name in steps:
        label = F.when(value >= threshold, F.lit(name)).otherwise(label)
    return F.when(value.isNotNull(), label)
