"""Master table to the full feature table with splits and standardised columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.augment import augmented, outbreak_weeks, scaled_copies
from weekloom.operators.features import (
    WEATHER_MEASURES, add_incidence, add_indicators, add_lags, add_neighbour_means, add_season,
    add_split, add_targets, add_weather_lags, apply_scaler, fit_scaler,
)
from weekloom.operators.panel import join_population

# The columns that get a standardised twin.
NORMALISED = [
    "temp_mean", "temp_max_mean", "temp_min_mean", "precipitation", "humidity_mean",
    "heat_index_mean", "temp_mean_anomaly", "precipitation_anomaly", "humidity_mean_anomaly",
    "incidence",
    *[f"{p}_lag{k}" for p in ("cases", "incidence") for k in range(1, 5)],
    *[f"{m}_lag{k}" for m in WEATHER_MEASURES for k in range(1, 5)],
]


def base_features(master: DataFrame, population: DataFrame, edges: DataFrame,
                  weather: DataFrame | None = None, focus: int = 1, indicators: Sequence[int] = (),
                  keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Everything that does not depend on the split.

    Lags and targets share one window, so they cost one exchange and one sort together.
    """
    rated = add_incidence(join_population(master, population, keys))
    moved = add_targets(add_lags(rated, {"cases": "cases", "incidence": "incidence"}, keys=keys), keys=keys)
    near = add_neighbour_means(
        moved, edges, {"cases": "neighbour_cases", "incidence": "neighbour_incidence"}, keys=keys)
    lagged = add_weather_lags(near, keys=keys, weather=weather)
    return add_indicators(add_season(lagged, keys), indicators, focus, keys)


def feature_table(base: DataFrame, train_until: tuple[int, int], validation_until: tuple[int, int],
                  embargo: int = 0, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Add the split and columns standardised by the training rows alone."""
    split = add_split(base, train_until, validation_until, keys, embargo)
    columns = [c for c in NORMALISED if c in split.columns]
    scaler = fit_scaler(split.where(F.col("split") == "train"), columns)
    return apply_scaler(split, scaler, columns)


def augmented_train(features: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Training rows plus scaled outbreak copies, standardised by the original rows' fit."""
    train = features.where(F.col("split") == "train")
    columns = [c for c in NORMALISED if c in features.columns]
    both = augmented(train, scaled_copies(outbreak_weeks(train), keys=keys))
    return apply_scaler(both, fit_scaler(train, columns), columns)
