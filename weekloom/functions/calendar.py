"""ISO week calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Monday; week indexes count ISO weeks from here.
_EPOCH_MONDAY = "1970-01-05"


def iso_year(date: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(date)).cast("int")


def iso_week(date: Column | str) -> Column:
    return F.weekofyear(_col(date)).cast("int")


def week_start(year: Column | str, week: Column | str) -> Column:
    """Monday of an ISO week. 4 January always lies in week 1."""
    anchor = F.make_date(_col(year), F.lit(1), F.lit(4))
    monday = F.date_sub(anchor, F.weekday(anchor))
    return F.date_add(monday, ((_col(week) - 1) * 7).cast("int"))


def week_index(year: Column | str, week: Column | str, weeks_per_year: int | None = None) -> Column:
    """Consecutive integer per week: ISO weeks, or years of a fixed number of weeks."""
    if weeks_per_year is None:
        days = F.datediff(week_start(year, week), F.lit(_EPOCH_MONDAY).cast("date"))
        return F.floor(days / 7).cast("int")
    return (_col(year) * weeks_per_year + _col(week) - 1).cast("int")


def year_of_index(index: Column | str, weeks_per_year: int | None = None) -> Column:
    if weeks_per_year is None:
        return iso_year(_monday(index))
    return F.floor(_col(index) / weeks_per_year).cast("int")


def week_of_index(index: Column | str, weeks_per_year: int | None = None) -> Column:
    if weeks_per_year is None:
        return iso_week(_monday(index))
    return (F.pmod(_col(index), F.lit(weeks_per_year)) + 1).cast("int")


def week_label(year: Column | str, week: Column | str) -> Column:
    """Label such as ``2024-SE07``."""
    return F.format_string("%d-SE%02d", _col(year), _col(week))


def _monday(index: Column | str) -> Column:
    return F.date_add(F.lit(_EPOCH_MONDAY).cast("date"), (_col(index) * 7).cast("int"))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
