"""Rule-based forecasts, routing and the prediction table the scoring queries read."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import features as ops, forecast
from weekloom.operators.panel import combine_sources
from weekloom.session import settled
from weekloom.sources.tables import routing_table
from workloads.base import TRAIN_UNTIL, VALIDATION_UNTIL, neat, neat_wrap, panel, sql

# Which model serves which horizon, with one exception by entity.
ROUTING = {
    0: {"default": "historical_mean"},
    1: {"default": "persistence"},
    2: {"default": "persistence"},
    3: {"default": "lag4", "exceptions": {7: "persistence"}},
    4: {"default": "lag4"},
}


def lagged(spark, sf):
    """Dense panel with case lags, targets and split."""
    moved = ops.add_targets(ops.add_lags(panel(spark, sf), {"cases": "cases"}))
    return ops.add_split(moved, TRAIN_UNTIL, VALIDATION_UNTIL)


def predictions(spark, sf):
    """Three models: last week, four weeks ago, and the mean of the week (horizon 0 only)."""
    rows = settled(lagged(spark, sf))
    fitted = forecast.fit_week_means(rows.where("split = 'train'"))
    return combine_sources([
        forecast.persistence(rows),
        forecast.long_predictions(rows, "lag4", {h: F.col("cases_lag4") for h in forecast.ALL_HORIZONS}),
        forecast.historical_mean(rows, fitted),
    ])


def routed(spark, sf):
    return forecast.route(predictions(spark, sf), routing_table(spark, ROUTING))


def persistence_forecast(spark, sf):
    return neat(forecast.persistence(lagged(spark, sf)))


def persistence_filled(spark, sf):
    return neat(forecast.persistence(lagged(spark, sf), horizons=(0,), fill_first=True))


def persistence_blind(spark, sf):
    return neat(forecast.persistence(lagged(spark, sf), horizon_blind=True))


def historical_mean_forecast(spark, sf):
    rows = lagged(spark, sf)
    return neat(forecast.historical_mean(rows, forecast.fit_week_means(rows.where("split = 'train'"))))


def routed_forecast(spark, sf):
    return neat(routed(spark, sf))


def usage_share(spark, sf):
    return neat(forecast.usage_share(routed(spark, sf)))


QUERIES = {f.__name__: f for f in (
    persistence_forecast, persistence_filled, persistence_blind, historical_mean_forecast,
    routed_forecast, usage_share,
)}

_ROWS = f"""
    SELECT *, CASE WHEN year < {TRAIN_UNTIL[0]} OR (year = {TRAIN_UNTIL[0]} AND epi_week <= {TRAIN_UNTIL[1]}) THEN 'train'
      WHEN year < {VALIDATION_UNTIL[0]} OR (year = {VALIDATION_UNTIL[0]} AND epi_week <= {VALIDATION_UNTIL[1]}) THEN 'validation'
      ELSE 'test' END AS split,
      {', '.join(f'lag(cases, {k}) OVER w AS cases_lag{k}' for k in range(1, 5))},
      {', '.join(f'lead(cases, {h}) OVER w AS target_h{h}' for h in range(1, 5))}
    FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY year, epi_week)"""


def _long(model: str, guess: str, horizons=range(5), actual: str | None = None) -> str:
    parts = []
    for h in horizons:
        real = actual or ("cases" if h == 0 else f"target_h{h}")
        parts.append(f"SELECT split, entity_id, year, epi_week, {h}::INT AS horizon, '{model}' AS model, "
                     f"{real}::DOUBLE AS y_real, {guess}::DOUBLE AS y_pred FROM mt "
                     f"WHERE {real} IS NOT NULL AND {guess} IS NOT NULL")
    return " UNION ALL ".join(parts)


_MEANS = """
    SELECT m.*, coalesce(a.am, b.bm, 0.0) AS hist FROM mt_raw m
    LEFT JOIN (SELECT epi_week, entity_id, avg(cases) AS am FROM mt_raw WHERE split = 'train' GROUP BY ALL) a
      ON m.epi_week = a.epi_week AND m.entity_id = a.entity_id
    LEFT JOIN (SELECT epi_week, avg(cases) AS bm FROM mt_raw WHERE split = 'train' GROUP BY ALL) b ON m.epi_week = b.epi_week"""
ROWS_CTE = {"mt_raw": _ROWS, "mt": _MEANS}
PREDICTIONS_CTE = {**ROWS_CTE, "predictions": " UNION ALL ".join([
    _long("persistence", "cases_lag1"), _long("lag4", "cases_lag4"), _long("historical_mean", "hist", [0])])}
_ROUTED = """
    SELECT split, entity_id, year, epi_week, horizon, 'ensemble' AS model, y_real, y_pred, model AS model_used
    FROM predictions WHERE model = CASE WHEN horizon = 0 THEN 'historical_mean' WHEN horizon <= 2 THEN 'persistence'
      WHEN horizon = 3 AND entity_id = 7 THEN 'persistence' ELSE 'lag4' END"""
ROUTED_CTE = {**PREDICTIONS_CTE, "routed": _ROUTED}
_PAIR = ["y_real", "y_pred"]

ORACLES = {
    "persistence_forecast": sql(neat_wrap(_long("persistence", "cases_lag1"), _PAIR), "panel", extra=ROWS_CTE),
    "persistence_filled": sql(neat_wrap(_long("persistence", "coalesce(cases_lag1, 0)", [0]), _PAIR), "panel", extra=ROWS_CTE),
    "persistence_blind": sql(neat_wrap(_long("persistence", "cases_lag1", actual="cases"), _PAIR), "panel", extra=ROWS_CTE),
    "historical_mean_forecast": sql(neat_wrap(_long("historical_mean", "hist", [0]), _PAIR), "panel", extra=ROWS_CTE),
    "routed_forecast": sql(neat_wrap("SELECT * FROM routed", _PAIR), "panel", extra=ROUTED_CTE),
    "usage_share": sql(neat_wrap("""
    SELECT model_used, n, n * 100.0 / sum(n) OVER () AS pct FROM (
      SELECT model_used, count(*)::BIGINT AS n FROM routed GROUP BY 1)""", ["pct"]), "panel", extra=ROUTED_CTE),
}
