"""Daily weather to weekly weather with anomalies, and trailing daily means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year
from weekloom.functions.measures import heat_index
from weekloom.keys import DEFAULT_KEYS, Keys

# Weekly measures whose deviation from the mean of their week is taken.
ANOMALY_MEASURES = ("temp_mean", "precipitation", "humidity_mean")


def derive_daily(days: DataFrame, date: str = "date", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Add mean humidity, ISO year and week, and the heat index to daily weather."""
    humid = days.withColumn("humidity_mean", (F.col("humidity_max") + F.col("humidity_min")) / 2)
    return humid.withColumns({
        keys.year: iso_year(date),
        keys.week: iso_week(date),
        "heat_index": heat_index(F.col("temp_mean"), F.col("humidity_mean")),
    })


def weekly_weather(days: DataFrame, date: str = "date", keys: Keys = DEFAULT_KEYS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Weekly means, total rain (0 when no day has a value), days and first date."""
    return days.groupBy(*by, *keys.time).agg(
        F.avg("temp_max").alias("temp_max_mean"),
        F.avg("temp_min").alias("temp_min_mean"),
        F.avg("temp_mean").alias("temp_mean"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("humidity_mean").alias("humidity_mean"),
        F.avg("heat_index").alias("heat_index_mean"),
        F.count(date).alias("n_days"),
        F.min(date).alias("start_date"),
    )


def add_anomalies(weeks: DataFrame, measures: Sequence[str] = ANOMALY_MEASURES,
                  keys: Keys = DEFAULT_KEYS, by: Sequence[str] = (),
                  fit_until_year: int | None = None) -> DataFrame:
    """Deviation from the mean of the same week of the year.

    A group holds one row per year. With ``fit_until_year`` the means see no later year.
    """
    same_week = Window.partitionBy(*by, keys.week)

    def usual(measure: str):
        seen = F.col(measure)
        if fit_until_year is not None:
            seen = F.when(F.col(keys.year) <= fit_until_year, seen)
        return F.avg(seen).over(same_week)

    return weeks.withColumns({f"{m}_anomaly": F.col(m) - usual(m) for m in measures})


def trailing_means(days: DataFrame, measures: Sequence[str], spans: Sequence[int] = (7, 14, 21),
                   date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Mean of each measure over the last ``span`` calendar days, the current one included.

    Works on one row per series and day, so a window group is bounded by the calendar.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    numbered = days.withColumn("_day", day)
    order = Window.partitionBy(*by).orderBy("_day")
    return numbered.withColumns({
        f"{m}_mean{span}d": F.avg(m).over(order.rangeBetween(-(span - 1), 0))
        for m in measures for span in spans
    }).drop("_day")
