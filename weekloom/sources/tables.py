"""Tables, models and routing on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.sources.delimited import read_delimited

ROUTING_SCHEMA = T.StructType([
    T.StructField("horizon", T.IntegerType(), False),
    T.StructField("entity_id", T.IntegerType(), True),
    T.StructField("model", T.StringType(), False),
])


def require_columns(table: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """Fail at plan time, before any job runs, when a column is absent."""
    missing = [name for name in required if name not in table.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return table


def read_table(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    return require_columns(spark.read.parquet(path), required, path)


def read_population(spark: SparkSession, path: str, entity: str = "comuna_id",
                    population: str = "poblacion", names: str = "barrios") -> DataFrame:
    """Population dimension: entity_id, population and the names it covers."""
    rows = read_delimited(spark, path, [entity, population])
    extra = [F.col(names).alias("names")] if names in rows.columns else []
    return rows.select(
        F.col(entity).try_cast("int").alias("entity_id"),
        F.col(population).try_cast("long").alias("population"), *extra,
    )


def read_splits(spark: SparkSession, path: str, split: str,
                augmented_path: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """One split of a feature table, or its augmented form where the caller names one."""
    if augmented_path is not None:
        return read_table(spark, augmented_path, required)
    return read_table(spark, path, required).where(F.col("split") == split)


def write_table(table: DataFrame, path: str, partition_by: Sequence[str] = (),
                csv_path: str | None = None) -> None:
    """Overwrite a parquet table and, on request, a CSV twin next to it."""
    table.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv_path is not None:
        table.write.mode("overwrite").option("header", "true").csv(csv_path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def routing_table(spark: SparkSession, rules: Mapping[int, Mapping]) -> DataFrame:
    """Rows from ``{horizon: {"default": model, "exceptions": {entity: model}}}``.

    A null entity marks the default of its horizon.
    """
    rows = []
    for horizon, rule in sorted(rules.items()):
        rows.append((int(horizon), None, rule["default"]))
        rows += [(int(horizon), int(e), m) for e, m in sorted(rule.get("exceptions", {}).items())]
    return spark.createDataFrame(rows, ROUTING_SCHEMA)


def write_routing(routing: DataFrame, path: str) -> None:
    routing.write.mode("overwrite").json(path)


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTING_SCHEMA).json(path)
