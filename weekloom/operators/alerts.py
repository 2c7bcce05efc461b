"""Alert levels from fitted percentiles, outbreak flags and lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.measures import ladder
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.evaluate import OUTBREAK_CASES
from weekloom.operators.ranks import exact_quantiles

# Alert levels and the percentile of training cases at which each starts.
ALERT_LEVELS = {"low": 0.50, "moderate": 0.75, "high": 0.90, "critical": 0.95}


def fit_alert_thresholds(train: DataFrame, count: str = "cases") -> DataFrame:
    """One row with the exact percentile of each level."""
    return exact_quantiles(train, count, ALERT_LEVELS)


def add_alert_level(rows: DataFrame, thresholds: DataFrame, count: str = "cases",
                    below: str = "none") -> DataFrame:
    """Highest level whose threshold the count reaches."""
    fitted = rows.withColumn("_levels", thresholds.select(F.struct(*ALERT_LEVELS)).scalar())
    steps = [(F.col(f"_levels.{name}"), name) for name in ALERT_LEVELS]
    return fitted.withColumn("alert", ladder(F.col(count), steps, below)).drop("_levels")


def add_outbreak_flag(rows: DataFrame, count: str = "cases",
                      threshold: float = OUTBREAK_CASES) -> DataFrame:
    return rows.withColumn("is_outbreak", (F.col(count) >= threshold).cast("int"))


def lead_times(rows: DataFrame, alert: str = "is_alert", outbreak: str = "is_outbreak",
               keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Weeks from the first alert to the onset of each outbreak.

    The weeks of an entity are cut after every outbreak run. A piece is the quiet time before
    one outbreak and the outbreak itself; the first alert in it counts if it is not later than
    the onset. Outbreaks without such an alert have a null lead.
    """
    order = keys.series()
    was = F.coalesce(F.lag(outbreak).over(order), F.lit(0))
    marked = rows.select(
        *keys.panel, alert, outbreak, F.row_number().over(order).alias("_no"),
        ((was == 1) & (F.col(outbreak) == 0)).cast("int").alias("_cut"))
    pieces = marked.withColumn(
        "episode", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    flagged, onset = F.col(alert) == 1, F.col(outbreak) == 1
    table = pieces.groupBy(keys.entity, "episode").agg(
        F.min(F.when(flagged, F.col("_no"))).alias("_alert"),
        F.min(F.when(onset, F.col("_no"))).alias("_onset"),
        F.min(F.when(onset, F.struct(*keys.time))).alias("_when"))
    lead = F.when(F.col("_alert") <= F.col("_onset"), F.col("_onset") - F.col("_alert"))
    return table.where(F.col("_onset").isNotNull()).select(
        keys.entity, "episode", F.col(f"_when.{keys.year}").alias("onset_year"),
        F.col(f"_when.{keys.week}").alias("onset_week"), lead.alias("lead_weeks"))
