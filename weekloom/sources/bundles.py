"""Fitted models on disk, with all that scoring them needs besides rows.

A bundle is a folder of pipelines and a manifest: per model and horizon its features, the length
of its windows and the scaler of its features. Scoring reads no training table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.models import Fitted, model_features, regressor_of, score_fitted
from weekloom.operators.panel import combine_sources
from weekloom.sources.tables import load_model, save_model

MANIFEST_SCHEMA = T.StructType([
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("length", T.IntegerType()),
    T.StructField("scaler", T.ArrayType(T.StructType([
        T.StructField("column", T.StringType()), T.StructField("mean", T.DoubleType()), T.StructField("deviation", T.DoubleType())]))),
    T.StructField("name", T.StringType()),
    T.StructField("horizon", T.IntegerType())])


def save_bundle(spark: SparkSession, path: str, fitted: Sequence[Fitted]) -> None:
    """Add models to a bundle; one of the same name and horizon is replaced.

    The manifest is written after the pipelines, so it never names one that is not there.
    """
    for model in fitted:
        save_model(model.pipeline, _model_path(path, model.name, model.horizon))
    rows = [(list(m.features), m.length, [(c, *map(float, v)) for c, v in m.scaler.items()], m.name, m.horizon) for m in fitted]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("name", "horizon").json(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, names: Sequence[str] | None = None,
                horizons: Sequence[int] | None = None) -> list[Fitted]:
    """The models of a bundle, by name and horizon. Raises where manifest and pipeline disagree."""
    listed = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    if names is not None:
        listed = listed.where(F.col("name").isin(list(names)))
    if horizons is not None:
        listed = listed.where(F.col("horizon").isin(list(horizons)))
    out = []
    for row in listed.orderBy("name", "horizon").collect():  # one row per model
        pipeline = load_model(_model_path(path, row.name, row.horizon))
        _check(pipeline, row)
        out.append(Fitted(row.name, row.horizon, pipeline, row.features, row.length,
                          {s.column: (s.mean, s.deviation) for s in row.scaler or ()}))
    return out


def score_bundle(models: Sequence[Fitted], rows: DataFrame, by: Sequence[str] = ("split",), count: str = "cases",
                 keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Long predictions of all models of a bundle for the same rows."""
    return combine_sources([score_fitted(m, rows, by, count, keys) for m in models])


def _model_path(path: str, name: str, horizon: int) -> str:
    return f"{path}/models/{name}-h{horizon}"


def _check(pipeline: PipelineModel, row) -> None:
    if row.length:
        held, listed = regressor_of(pipeline).numFeatures, row.length * len(row.features)
        if held != listed:
            raise ValueError(f"{row.name} at horizon {row.horizon} reads {held} numbers, its manifest lists {listed}")
        missing = [f for f in row.features if f.endswith("_norm") and f.removesuffix("_norm") not in {s.column for s in row.scaler or ()}]
        if missing:
            raise ValueError(f"{row.name} at horizon {row.horizon} has no scaler for {missing}")
    elif model_features(pipeline) != row.features:
        raise ValueError(f"{row.name} at horizon {row.horizon} was fitted on other features than its manifest lists")
