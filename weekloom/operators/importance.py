"""Feature importance tables: from models, by permutation, and rolled up by category."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.features import complete_rows
from weekloom.operators.models import Fitted, entity_domain, model_features, regressor_of
from weekloom.operators.panel import combine_sources

# Feature categories, as patterns of feature names.
CATEGORIES = [
    ("Own cases", r"^(cases|incidence)_lag[1-4](_norm)?$"),
    ("Neighbourhood", r"^neighbour_(cases|incidence)_lag1$"),
    ("Temperature", r"^temp_mean(_anomaly)?(_lag[1-4](_norm)?)?$"),
    ("Precipitation", r"^precipitation(_anomaly)?(_lag[1-4](_norm)?)?$"),
    ("Humidity and heat", r"^(humidity_mean(_anomaly)?|heat_index_mean)(_lag[1-4](_norm)?)?$"),
    ("Season", r"^(week_sin|week_cos|in_season|month)$"),
    ("Place", r"^(entity_id|is_focus|population)$"),
]
OTHER = "Other"

_MODEL_COLUMNS = ("raw_features", "features", "prediction")


def category_of(feature: Column) -> Column:
    label = F.lit(OTHER)
    for name, pattern in reversed(CATEGORIES):
        label = F.when(feature.rlike(pattern), name).otherwise(label)
    return label


def readable_name(feature: Column) -> Column:
    """``temp_mean_anomaly_lag2_norm`` becomes ``temp mean anomaly (lag 2)``."""
    plain = F.regexp_replace(feature, "_norm", "")
    parts = F.split(plain, "_lag")
    words = F.regexp_replace(F.element_at(parts, 1), "_", " ")
    return F.when(F.size(parts) > 1, F.concat(words, F.lit(" (lag "), F.get(parts, F.lit(1)), F.lit(")"))
                  ).otherwise(words)


def tree_importance(spark: SparkSession, model: PipelineModel, horizon: int) -> DataFrame:
    """Share of the total gain per feature, in percent. One row per feature."""
    return _shares(spark, model_features(model), regressor_of(model).featureImportances.toArray(), horizon)


def linear_importance(spark: SparkSession, model: PipelineModel, horizon: int = 0) -> DataFrame:
    """Absolute coefficient on standardised features, in percent of their sum."""
    coefficients = [abs(float(c)) for c in regressor_of(model).coefficients.toArray()]
    return _shares(spark, model_features(model), coefficients, horizon)


def window_importance(spark: SparkSession, model: Fitted) -> DataFrame:
    """Absolute coefficients of a linear sequence model, summed over the weeks of the window.

    Boosted sequence models give the gain instead. In percent of the total, one row per feature.
    """
    stage = regressor_of(model.pipeline)
    values = stage.coefficients if hasattr(stage, "coefficients") else stage.featureImportances
    by_step = np.abs(values.toArray()).reshape(model.length, len(model.features))
    return _shares(spark, model.features, by_step.sum(axis=0), model.horizon)


def fitted_importance(spark: SparkSession, models: Sequence[Fitted]) -> DataFrame:
    """What each model weighs its features by, in one long table with model and method.

    Gain for trees, absolute coefficients for linear models; reads the models alone.
    """
    tables = []
    for model in models:
        linear = hasattr(regressor_of(model.pipeline), "coefficients")
        if model.length:
            table = window_importance(spark, model)
        elif linear:
            table = linear_importance(spark, model.pipeline, model.horizon)
        else:
            table = tree_importance(spark, model.pipeline, model.horizon)
        tables.append(table.withColumn("model", F.lit(model.name)).withColumn("method", F.lit("coefficient" if linear else "gain")))
    return combine_sources(tables)


def entity_coefficients(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The coefficient of each entity in a linear pipeline that holds entities as a sparse vector.

    In units of the target, next to entities that the fit has not seen, whose coefficient is 0.
    """
    names, values = entity_domain(model), regressor_of(model).coefficients.toArray()
    if not names:
        raise ValueError("the pipeline holds no entities")
    rows = list(zip(names, map(float, values[len(values) - len(names):])))
    return spark.createDataFrame(rows, "entity string, coefficient double")


def _shares(spark: SparkSession, features: Sequence[str], values, horizon: int) -> DataFrame:
    numbers = [float(v) for v in values]
    total = sum(numbers) or 1.0
    rows = [(f, v / total * 100.0, horizon) for f, v in zip(features, numbers)]
    table = spark.createDataFrame(rows, "feature string, importance double, horizon int")
    return table.select("feature", F.round("importance", 3).alias("importance"), "horizon",
                        category_of(F.col("feature")).alias("category"))


def permutation_importance(model: PipelineModel, rows: DataFrame, horizon: int = 0,
                           buckets: int = 512, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Mean squared change of the prediction when one feature is taken from another row.

    Rows fall into ``buckets`` hash buckets, a fixed number whatever the size of the table, and
    stand in hash order there; a feature is taken from the next row, and by the last row from the
    first, which is a permutation of the rows. A row alone in its bucket keeps its values, so a
    small table wants fewer buckets. The one exchange is on the bucket: every row gets its donor
    in the window, and only then one copy per feature, which is scored and reduced where it is.
    """
    features = model_features(model)
    stages = PipelineModel(model.stages[1:])
    assembled = model.stages[0].getOutputCol()
    order = F.xxhash64(*[F.col(k) for k in keys.panel], F.lit("permute"))
    base = complete_rows(rows, features).select(
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.pmod(order, F.lit(buckets)).alias("bucket"), order.alias("_order"))
    circle = Window.partitionBy("bucket").orderBy("_order", "x")
    first = F.first("x").over(circle.rowsBetween(Window.unboundedPreceding, 0))
    placed = base.select("x", F.coalesce(F.lead("x", 1).over(circle), first).alias("donor"))

    def scored(table: DataFrame, column: str, name: str) -> DataFrame:
        ready = table.withColumn(assembled, array_to_vector(F.col(column)))
        return stages.transform(ready).withColumnRenamed("y_pred", name).drop(*_MODEL_COLUMNS)

    moved = scored(placed, "x", "before").select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(features)))).alias("j"))
    swapped = moved.withColumn("permuted", F.transform("x", lambda v, i: F.when(
        i + 1 == F.col("j"), F.element_at("donor", F.col("j"))).otherwise(v)))
    both = scored(swapped, "permuted", "after")
    change = (F.col("after") - F.col("before")) * (F.col("after") - F.col("before"))
    names = F.array(*[F.lit(f) for f in features])
    effect = both.groupBy(F.element_at(names, F.col("j")).alias("feature")).agg(
        F.avg(change).alias("_change"))
    # One row per feature.
    total = F.sum("_change").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(F.col("_change") * 100.0, total), F.lit(0.0))
    return effect.select("feature", F.round(share, 3).alias("importance"),
                         F.lit(horizon).alias("horizon"), category_of(F.col("feature")).alias("category"))


def by_category(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Importance per horizon and category, with its place in the horizon; apart for each of ``by``."""
    sums = importance.groupBy(*by, "horizon", "category").agg(F.sum("importance").alias("importance"))
    # One row per category: at most eight per horizon.
    place = F.row_number().over(
        Window.partitionBy(*by, "horizon").orderBy(F.desc("importance"), "category"))
    return sums.withColumn("place", place)


def top_categories(importance: DataFrame, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    return by_category(importance, by).where(F.col("place") <= k)


def dominant_changes(importance: DataFrame, pairs: Sequence[tuple[int, int]] = ((0, 4), (1, 4)),
                     by: Sequence[str] = ()) -> DataFrame:
    """Leading category at a short and at a long horizon, and whether it differs."""
    leading = by_category(importance, by).where(F.col("place") == 1).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", "category"))).alias("_lead"))
    rows = F.array(*[F.struct(
        F.lit(a).alias("short_horizon"), F.lit(b).alias("long_horizon"),
        F.try_element_at("_lead", F.lit(a)).alias("short_category"),
        F.try_element_at("_lead", F.lit(b)).alias("long_category")) for a, b in pairs])
    table = leading.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")
    return table.where(F.col("short_category").isNotNull() & F.col("long_category").isNotNull()).withColumn(
        "changed", F.col("short_category") != F.col("long_category"))


def top_features(importance: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` leading features per horizon with a readable name. Feature lists are short."""
    place = F.row_number().over(
        Window.partitionBy(*by, "horizon").orderBy(F.desc("importance"), "feature"))
    return importance.withColumn("place", place).where(F.col("place") <= k).withColumn(
        "name", readable_name(F.col("feature")))
