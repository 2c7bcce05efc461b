"""Rule-based forecasts and the routed ensemble, all on the long prediction table.

The long table has split, horizon, entity, week, model, y_real and y_pred. Every score reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.measures import clip_low
from weekloom.keys import DEFAULT_KEYS, Keys

ALL_HORIZONS = (0, 1, 2, 3, 4)


def target_of(horizon: int, count: str = "cases") -> str:
    return count if horizon == 0 else f"target_h{horizon}"


def long_predictions(features: DataFrame, model: str, predictions: Mapping[int, Column],
                     count: str = "cases", keys: Keys = DEFAULT_KEYS,
                     actuals: Mapping[int, Column] | None = None) -> DataFrame:
    """One row per week and horizon. Rows without an actual or a prediction are dropped."""
    truth = actuals or {h: F.col(target_of(h, count)) for h in predictions}
    pairs = F.array(*[
        F.struct(F.lit(h).cast("int").alias("horizon"), truth[h].cast("double").alias("y_real"),
                 p.cast("double").alias("y_pred"))
        for h, p in predictions.items()])
    split = ["split"] if "split" in features.columns else []
    exploded = features.select(*split, *keys.panel, F.explode(pairs).alias("_pair"))
    return exploded.select(
        *split, *keys.panel, "_pair.horizon", F.lit(model).alias("model"),
        "_pair.y_real", "_pair.y_pred",
    ).where(F.col("y_real").isNotNull() & F.col("y_pred").isNotNull())


def persistence(features: DataFrame, horizons: Sequence[int] = ALL_HORIZONS, count: str = "cases",
                lag: str = "cases_lag1", fill_first: bool = False, horizon_blind: bool = False,
                keys: Keys = DEFAULT_KEYS, model: str = "persistence") -> DataFrame:
    """Last week's count as the forecast for every horizon.

    A missing lag drops the row, or counts as 0 with ``fill_first``. ``horizon_blind`` scores
    every horizon against the current week instead of its own target.
    """
    guess = clip_low(F.coalesce(F.col(lag), F.lit(0)) if fill_first else F.col(lag))
    actuals = {h: F.col(count) for h in horizons} if horizon_blind else None
    return long_predictions(features, model, {h: guess for h in horizons}, count, keys, actuals)


def fit_week_means(train: DataFrame, count: str = "cases",
                   keys: Keys = DEFAULT_KEYS) -> tuple[DataFrame, DataFrame]:
    """Mean per week of the year and entity, and per week of the year."""
    return (
        train.groupBy(keys.week, keys.entity).agg(F.avg(count).alias("_mean")),
        train.groupBy(keys.week).agg(F.avg(count).alias("_week_mean")),
    )


def historical_mean(rows: DataFrame, fitted: tuple[DataFrame, DataFrame], count: str = "cases",
                    keys: Keys = DEFAULT_KEYS, model: str = "historical_mean",
                    horizon: int = 0) -> DataFrame:
    """Entity's mean of that week, else the week's mean, else 0.

    The second table has one row per week of the year and is broadcast.
    """
    by_entity, by_week = fitted
    joined = rows.join(by_entity, [keys.week, keys.entity], "left").join(
        F.broadcast(by_week), keys.week, "left")
    guess = clip_low(F.coalesce("_mean", "_week_mean", F.lit(0.0)))
    return long_predictions(joined, model, {horizon: guess}, count, keys)


def route(predictions: DataFrame, routing: DataFrame, keys: Keys = DEFAULT_KEYS,
          model: str = "ensemble") -> DataFrame:
    """Keep, per horizon and entity, the rows of the model the routing names.

    Exceptions by entity win over the default of the horizon. The source model stays in
    ``model_used``. Defaults are one row per horizon and are broadcast; the exceptions may be
    as many as entities, so Spark picks their join by size.
    """
    defaults = routing.where(F.col("entity_id").isNull()).select(
        "horizon", F.col("model").alias("_default"))
    exceptions = routing.where(F.col("entity_id").isNotNull()).select(
        "horizon", F.col("entity_id").alias(keys.entity), F.col("model").alias("_exception"))
    chosen = F.coalesce("_exception", "_default")
    return (
        predictions.join(F.broadcast(defaults), "horizon", "left")
        .join(exceptions, ["horizon", keys.entity], "left")
        .where(F.col("model") == chosen)
        .withColumn("model_used", F.col("model")).withColumn("model", F.lit(model))
        .select(*predictions.columns, "model_used")
    )


def usage_share(routed: DataFrame) -> DataFrame:
    """Predictions each model contributes, and their percentage."""
    counted = routed.groupBy("model_used").agg(F.count(F.lit(1)).alias("n"))
    # One row per model, so the total is taken on a handful of rows.
    total = F.sum("n").over(Window.partitionBy())
    return counted.select("model_used", "n", F.try_divide(F.col("n") * 100.0, total).alias("pct"))
