"""Rolling and expanding folds by week, block periods, and scores within them.

Fold tables have one row per fold and week. They are bounded by the calendar, so they are
broadcast: rows find their folds without moving and without a row-by-row test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions.calendar import week_label
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.evaluate import safe_mae

BLOCK_SCHEMA = T.StructType([
    T.StructField("block", T.StringType(), False),
    T.StructField("block_year", T.IntegerType(), False),
    T.StructField("week_min", T.IntegerType(), False),
    T.StructField("week_max", T.IntegerType(), False),
])


def numbered_weeks(rows: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Distinct weeks with a running number from 0 and their count. One row per week."""
    ordered = Window.partitionBy().orderBy(*keys.time)
    weeks = rows.select(*keys.time).distinct()
    return weeks.select(
        *keys.time, (F.row_number().over(ordered) - 1).alias("week_no"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_weeks"))


def rolling_folds(rows: DataFrame, first: int = 26, step: int = 4, length: int = 4,
                  keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Folds of ``length`` weeks that start every ``step`` weeks from week ``first``.

    A fold must end before the last week of the data.
    """
    weeks = numbered_weeks(rows, keys)
    since = F.col("week_no") - first
    oldest = F.greatest(F.ceil((since - length + 1) / F.lit(step)), F.lit(0)).cast("int")
    newest = F.floor(since / F.lit(step)).cast("int")
    in_folds = weeks.where((since >= 0) & (oldest <= newest)).select(
        *keys.time, "n_weeks", F.explode(F.sequence(oldest, newest)).alias("_fold"))
    fits = F.col("_fold") * step + first < F.col("n_weeks") - length
    members = in_folds.where(fits)
    span = Window.partitionBy("_fold")
    week = F.struct(*keys.time)
    return members.select(
        (F.col("_fold") + 1).alias("fold"), *keys.time,
        F.min(week).over(span).alias("_from"), F.max(week).over(span).alias("_to"),
    ).select(
        "fold", *keys.time,
        week_label(F.col(f"_from.{keys.year}"), F.col(f"_from.{keys.week}")).alias("fold_label"),
        F.col(f"_from.{keys.year}").alias("from_year"), F.col(f"_from.{keys.week}").alias("from_week"),
        F.col(f"_to.{keys.year}").alias("to_year"), F.col(f"_to.{keys.week}").alias("to_week"))


def in_folds(rows: DataFrame, folds: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Rows whose week belongs to some fold."""
    return rows.join(F.broadcast(folds.select(*keys.time).distinct()), keys.time, "left_semi")


def fold_scores(predictions: DataFrame, panel: DataFrame, folds: DataFrame, count: str = "cases",
                keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """MAE per fold, model and horizon with the fold's mean cases. Folds too small are left out.

    Predictions are made once and scored by fold, so models that look back keep their history.
    """
    label = ["fold", "fold_label", "from_year", "from_week", "to_year", "to_week"]
    scored = safe_mae(predictions.join(F.broadcast(folds), keys.time), [*label, "model", "horizon"])
    means = panel.join(F.broadcast(folds.select("fold", *keys.time)), keys.time).groupBy("fold").agg(
        F.avg(count).alias("mean_cases"))
    return scored.where(F.col("mae").isNotNull()).join(F.broadcast(means), "fold")


def stability(fold_table: DataFrame) -> DataFrame:
    """Mean, sample deviation and variation (%) of the fold MAE per model and horizon."""
    table = fold_table.groupBy("model", "horizon").agg(
        F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"),
        F.count(F.lit(1)).alias("n_folds"))
    return table.withColumn("cv_pct", F.try_divide(F.col("std_mae") * 100.0, F.col("mean_mae")))


def block_table(spark: SparkSession, blocks: Sequence[tuple[str, int, int, int]]) -> DataFrame:
    """Named periods: (name, year, first week, last week)."""
    return spark.createDataFrame(list(blocks), BLOCK_SCHEMA)


def block_scores(predictions: DataFrame, panel: DataFrame, blocks: DataFrame, count: str = "cases",
                 keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """MAE per block, model and horizon with mean and largest cases. The block list is broadcast."""
    near = F.broadcast(blocks)

    def inside(rows: DataFrame) -> DataFrame:
        match = (F.col(keys.year) == F.col("block_year")) & F.col(keys.week).between(
            F.col("week_min"), F.col("week_max"))
        return rows.join(near, match)

    scored = safe_mae(inside(predictions), ["block", "model", "horizon"])
    level = inside(panel).groupBy("block").agg(
        F.avg(count).alias("mean_cases"), F.max(count).alias("max_cases"))
    return scored.where(F.col("mae").isNotNull()).join(F.broadcast(level), "block")


def expanding_folds(rows: DataFrame, n_splits: int = 5, min_train: int = 52,
                    keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Weeks by fold and role: train on all weeks before the validation weeks of the fold.

    Validation parts are equal and end with the data; folds with too short a past are dropped.
    Cutting by week, not by row, keeps time order whatever the row order is.
    """
    weeks = numbered_weeks(rows, keys)
    part = F.floor(F.col("n_weeks") / F.lit(n_splits + 1)).cast("int")
    start = F.col("n_weeks") - (F.lit(n_splits) - F.col("_fold")) * part
    by_fold = weeks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("_fold"))
    role = F.when(F.col("week_no") < start, "train").when(F.col("week_no") < start + part, "validation")
    return by_fold.where(start >= min_train).select(
        (F.col("_fold") + 1).alias("fold"), *keys.time, role.alias("role")
    ).where(F.col("role").isNotNull())


def assign_folds(rows: DataFrame, folds: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Each row once per fold it plays a role in."""
    return rows.join(F.broadcast(folds), keys.time)
