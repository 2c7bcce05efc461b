"""Landed weather payloads: one JSON document holding a column of values per variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Variable names of the weather payload, and what they become.
DAILY_VARIABLES = {
    "temperature_2m_max": "temp_max",
    "temperature_2m_min": "temp_min",
    "temperature_2m_mean": "temp_mean",
    "precipitation_sum": "precipitation",
    "relative_humidity_2m_max": "humidity_max",
    "relative_humidity_2m_min": "humidity_min",
}


def read_payloads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per landed document: file, ``daily`` (its columns of values) and ``reason``.

    The reason is null where the document can be read, else it says what is wrong: text that is
    not such a document, no days, a variable with more or fewer values than days, or a day that is
    no date. A variable that a document lacks altogether stays null on all its days.
    """
    values = ", ".join(f"{name}: array<double>" for name in DAILY_VARIABLES)
    documents = (
        spark.read.schema(f"daily struct<time: array<string>, {values}>, broken string")
        .option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(path)
        .select(F.col("_metadata.file_path").alias("file"), "daily", "broken"))
    days = F.size("daily.time")
    uneven = [F.when(F.size(f"daily.{name}") != days, F.format_string(f"{name}: %d values for %d days", F.size(f"daily.{name}"), days))
              for name in DAILY_VARIABLES]
    reason = F.coalesce(
        F.when(F.col("broken").isNotNull(), "not a document of daily values"),
        F.when(F.col("daily.time").isNull(), "no days"), *uneven,
        F.when(F.exists("daily.time", lambda d: d.try_cast("date").isNull()), "a day that is no date"))
    return documents.select("file", "daily", reason.alias("reason"))


def daily_rows(payloads: DataFrame) -> DataFrame:
    """One row per day of the documents that can be read."""
    absent = F.array_repeat(F.lit(None).cast("double"), F.size("daily.time"))
    days = payloads.where("reason is null").select(F.explode(F.arrays_zip(
        F.col("daily.time").alias("time"), *[F.coalesce(f"daily.{name}", absent).alias(name) for name in DAILY_VARIABLES]
    )).alias("day"))
    return days.select(
        F.col("day.time").try_cast("date").alias("date"),
        *[F.col(f"day.{old}").alias(new) for old, new in DAILY_VARIABLES.items()])


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """File and reason of the documents that cannot be read."""
    return payloads.where("reason is not null").select("file", "reason")


def read_daily_weather(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Turn columnar payloads into one row per day. Large sites land many files; documents that
    cannot be read are left out here and listed by ``rejected_payloads``."""
    return daily_rows(read_payloads(spark, path))


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather already written as CSV by an earlier run."""
    columns = ", ".join(f"{name} double" for name in DAILY_VARIABLES.values())
    return spark.read.schema(f"date date, {columns}").csv(path, header=True, enforceSchema=False)
