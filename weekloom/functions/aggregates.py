"""Aggregate expressions that are safe at group edges and combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; null (not an error) when either side is constant."""
    px, py = _pairs(x, y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    constant = (F.min(px) == F.max(px)) | (F.min(py) == F.max(py))
    return F.when(~constant, F.try_divide(F.covar_pop(px, py), spread))


def slope(y: Column, x: Column) -> Column:
    px, py = _pairs(x, y)
    return F.when(F.min(px) < F.max(px), F.try_divide(F.covar_pop(px, py), F.var_pop(px)))


def intercept(y: Column, x: Column) -> Column:
    px, py = _pairs(x, y)
    return F.avg(py) - slope(y, x) * F.avg(px)


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 - SSE / SST in a single pass.

    SST comes from ``var_pop``, whose partial states merge without cancellation, so no
    second pass and no window over the whole group is needed. A constant actual gives 1
    for a perfect fit and 0 otherwise; fewer than two rows give null.
    """
    sse = F.sum((actual - predicted) * (actual - predicted))
    constant = F.when(sse == 0, 1.0).otherwise(0.0)
    return (
        F.when(F.count(actual) < 2, F.lit(None).cast("double"))
        .when(F.min(actual) == F.max(actual), constant)
        .otherwise(1.0 - F.try_divide(sse, F.count(actual) * F.var_pop(actual)))
    )


def regression_scores(actual: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE, MAPE (over non-zero actuals), R2 and row count of one group."""
    error = actual - predicted
    relative = F.when(actual != 0, F.abs(F.try_divide(error, actual)))
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(relative) * 100.0).alias("mape"),
        r_squared(actual, predicted).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    ]


def share(condition: Column) -> Column:
    """Fraction of rows for which ``condition`` holds, null counting as no."""
    return F.try_divide(F.count_if(condition), F.count(F.lit(1)))


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    complete = x.isNotNull() & y.isNotNull()
    return F.when(complete, x.cast("double")), F.when(complete, y.cast("double"))
