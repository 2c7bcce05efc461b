"""Source rows to a dense case panel, daily weather to weekly weather, both to one master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.cleaning import (
    Bounds, DAILY_WEATHER_BOUNDS, MASTER_BOUNDS, YEAR_RANGE, clean_counts, clean_weeks, limit_ranges,
    map_labels, out_of_range_counts, repair_ranges, standard_formats,
)
from weekloom.operators.panel import (
    combine_sources, densify, join_weather, resolve_overlap, weekly_sum,
)
from weekloom.operators.weather import add_anomalies, derive_daily, weekly_weather

# Column order of the master table.
MASTER_ORDER = [
    "year", "epi_week", "entity_id", "cases", "temp_max_mean", "temp_min_mean", "temp_mean",
    "precipitation", "humidity_mean", "heat_index_mean", "temp_mean_anomaly",
    "precipitation_anomaly", "humidity_mean_anomaly",
]


def case_panel(sources: Sequence[DataFrame], mapping: DataFrame, entities: DataFrame | None = None,
               weeks_per_year: int | None = None, source_order: Sequence[str] | None = None,
               years: tuple[int | None, int | None] = YEAR_RANGE, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Clean and union case sources, sum by entity and week, and fill the empty weeks.

    With ``source_order`` a week that several sources cover is taken from the first of them;
    without it overlapping sources add up.
    """
    rows = clean_counts(clean_weeks(map_labels(combine_sources(sources), mapping), keys, years))
    if source_order is None:
        weekly = weekly_sum(rows, ["cases"], keys)
    else:
        by_source = weekly_sum(rows, ["cases"], keys, by=["source"])
        weekly = resolve_overlap(by_source, source_order, ["cases"], keys).drop("source")
    return densify(weekly, ["cases"], keys, entities, weeks_per_year)


def weather_weeks(days: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Range-checked daily weather, derived measures, weekly values and anomalies."""
    checked = limit_ranges(days, DAILY_WEATHER_BOUNDS)
    return add_anomalies(weekly_weather(derive_daily(checked, keys=keys), keys=keys), keys=keys)


def master_table(panel: DataFrame, weather: DataFrame, keys: Keys = DEFAULT_KEYS,
                 bounds: Bounds = MASTER_BOUNDS) -> DataFrame:
    """Panel and weather joined, repaired by range and interpolation, in standard formats.

    Both key sets are unique by construction, so the join cannot create duplicates.
    ``replaced_counts`` tells how many values ``bounds`` replaces.
    """
    joined = join_weather(panel, weather, keys)
    repaired = repair_ranges(joined, bounds, keys)
    return standard_formats(repaired, MASTER_ORDER, keys=keys)


def replaced_counts(panel: DataFrame, weather: DataFrame, keys: Keys = DEFAULT_KEYS,
                    bounds: Bounds = MASTER_BOUNDS) -> DataFrame:
    """Per column of the master table the number of values that its range check replaces."""
    return out_of_range_counts(join_weather(panel, weather, keys), bounds)
