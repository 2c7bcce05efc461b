"""Case files, brought to one schema: year, epi_week, label, cases, source (all text but the tag)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.cleaning import drop_unknown_labels
from weekloom.sources.delimited import read_delimited

# Column names of the national case export, and what they become.
NATIONAL_COLUMNS = {
    "anio_min": "year",
    "sepi_min": "epi_week",
    "departamento_residencia": "label",
    "cantidad": "cases",
}
NATIONAL_REGION_COLUMN = "id_prov_indec_residencia"
NATIONAL_DISTRICT_COLUMN = "id_depto_indec_residencia"
NATIONAL_EVENT_COLUMN = "evento"
NATIONAL_REGION = 2
NATIONAL_EVENT = "DENGUE"
UNKNOWN_DISTRICT = 999

# Column names of the city case export, and what they become.
CITY_COLUMNS = {
    "ano": "year",
    "semana_epidemiologica": "epi_week",
    "departamento_residencia": "label",
    "n_confirmados": "cases",
}
UNKNOWN_LABELS = ["SIN DATO", "NAN", ""]

COMMON = ["year", "epi_week", "label", "cases", "source"]


def read_national_cases(spark: SparkSession, path: str | Sequence[str], source: str,
                        region: int = NATIONAL_REGION, event: str = NATIONAL_EVENT) -> DataFrame:
    """One region and one event of the national files, without unknown districts.

    The files of a path need not agree in separator, encoding or order of columns.
    """
    required = [*NATIONAL_COLUMNS, NATIONAL_REGION_COLUMN, NATIONAL_DISTRICT_COLUMN,
                NATIONAL_EVENT_COLUMN]
    rows = read_delimited(spark, path, required, columns=required)
    kept = keep_region_event(rows, region, event)
    return _common(kept, NATIONAL_COLUMNS, source)


def keep_region_event(rows: DataFrame, region: int, event: str,
                      region_column: str = NATIONAL_REGION_COLUMN,
                      event_column: str = NATIONAL_EVENT_COLUMN,
                      district_column: str = NATIONAL_DISTRICT_COLUMN,
                      unknown_district: int = UNKNOWN_DISTRICT) -> DataFrame:
    """Region, case-blind event, and every district but the unknown one (null stays)."""
    return (
        rows.where(_as_int(region_column) == region)
        .where(F.upper(event_column) == event.upper())
        .where(~_as_int(district_column).eqNullSafe(F.lit(unknown_district)))
    )


def read_city_cases(spark: SparkSession, path: str | Sequence[str], source: str) -> DataFrame:
    """The city file without rows whose district is unknown."""
    rows = read_delimited(spark, path, list(CITY_COLUMNS), columns=list(CITY_COLUMNS))
    known = drop_unknown_labels(rows, "departamento_residencia", UNKNOWN_LABELS)
    return _common(known, CITY_COLUMNS, source)


def _as_int(column: str) -> Column:
    return F.col(column).try_cast("int")


def _common(rows: DataFrame, names: Mapping[str, str], source: str) -> DataFrame:
    return (
        rows.select([F.col(old).alias(new) for old, new in names.items()])
        .withColumn("source", F.lit(source))
        .select(COMMON)
    )
