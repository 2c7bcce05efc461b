"""Scaled, noisy copies of outbreak rows, and reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.aggregates import share
from weekloom.functions.noise import keyed_normal
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.explore import bucket_histogram

# Cases above which a week is scaled, the factors, and the relative noise.
OUTBREAK_ABOVE = 50
FACTORS = (2.0, 3.0)
NOISE = 0.05
NOISE_FLOOR = 1e-6

# Columns on the scale of cases. Weather and calendar columns are left as they are.
CASE_COLUMNS = (
    "cases", "incidence",
    "cases_lag1", "cases_lag2", "cases_lag3", "cases_lag4",
    "incidence_lag1", "incidence_lag2", "incidence_lag3", "incidence_lag4",
    "neighbour_cases_lag1", "neighbour_incidence_lag1",
    "target_h1", "target_h2", "target_h3", "target_h4",
)


def outbreak_weeks(rows: DataFrame, count: str = "cases", above: float = OUTBREAK_ABOVE) -> DataFrame:
    return rows.where(F.col(count) > above)


def outbreak_summary(rows: DataFrame, count: str = "cases", above: float = OUTBREAK_ABOVE) -> DataFrame:
    """One row: outbreak rows, their share, mean and maximum."""
    hit = F.col(count) > above
    return rows.agg(
        F.count_if(hit).alias("n_outbreak"), F.count(F.lit(1)).alias("n"),
        (share(hit) * 100.0).alias("pct"), F.avg(F.when(hit, F.col(count))).alias("mean"),
        F.max(F.when(hit, F.col(count))).alias("max"))


def worst_entities(rows: DataFrame, k: int = 3, count: str = "cases", above: float = OUTBREAK_ABOVE,
                   keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Entities with the highest outbreak peak."""
    peaks = outbreak_weeks(rows, count, above).groupBy(keys.entity).agg(F.max(count).alias("peak"))
    return peaks.orderBy(F.desc("peak"), keys.entity).limit(k)


def scaled_copies(rows: DataFrame, factors: Sequence[float] = FACTORS, noise: float = NOISE,
                  columns: Sequence[str] = CASE_COLUMNS, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One copy of every row per factor: case columns times the factor plus relative noise.

    Noise depends on key, factor and column only, so repartitioning or a rerun task changes
    nothing. Nulls read as 0 and results stay at or above 0. Standardised ``*_norm`` columns are
    dropped: refit them from the scaled columns with ``apply_scaler``.
    """
    scaled = [c for c in columns if c in rows.columns]
    kept = [c for c in rows.columns if c not in scaled and not c.endswith("_norm")]
    copies = rows.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    identity = [F.col(k) for k in keys.panel] + [F.col("factor").cast("int")]

    def copy(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.col("factor")
        spread = F.abs(value) * F.lit(noise) + F.lit(NOISE_FLOOR)
        return F.greatest(value + keyed_normal(identity, name) * spread, F.lit(0.0)).alias(name)

    return copies.select(*kept, *[copy(c) for c in scaled], F.lit(True).alias("is_synthetic"), "factor")


def augmented(original: DataFrame, copies: DataFrame) -> DataFrame:
    """Original rows (factor 1) and synthetic rows in one table."""
    case_like = [c for c in CASE_COLUMNS if c in copies.columns]
    tagged = original.drop(*[c for c in original.columns if c.endswith("_norm")]).withColumns({
        **{c: F.col(c).cast("double") for c in case_like},
        "is_synthetic": F.lit(False), "factor": F.lit(1.0)})
    return tagged.unionByName(copies, allowMissingColumns=True)


def augmentation_report(table: DataFrame, count: str = "cases", above: float = OUTBREAK_ABOVE) -> DataFrame:
    """Rows, zero share, outbreak share and maximum, by synthetic flag."""
    return table.groupBy("is_synthetic").agg(
        F.count(F.lit(1)).alias("n"), (share(F.col(count) == 0) * 100.0).alias("pct_zero"),
        F.count_if(F.col(count) > above).alias("n_outbreak"),
        (share(F.col(count) > above) * 100.0).alias("pct_outbreak"), F.max(count).alias("max"))


def augmentation_histogram(table: DataFrame, count: str = "cases") -> DataFrame:
    return bucket_histogram(table, count, by=["is_synthetic"])
