"""Scores, winners, folds and blocks over the prediction table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from weekloom.operators import evaluate, folds as fold_ops, forecast
from weekloom.session import scratch, settled
from weekloom.sources import runs
from weekloom.sources.tables import routing_table
from workloads.base import neat, neat_wrap, panel, sql
from workloads.forecasts import PREDICTIONS_CTE, ROUTED_CTE, ROUTING, ROWS_CTE, lagged, predictions

MODEL_ORDER = ["persistence", "lag4", "historical_mean"]
BLOCKS = [("1998 high", 1998, 1, 26), ("1998 low", 1998, 27, 53), ("2000", 2000, 1, 52), ("2010", 2010, 1, 52)]


def persistence_scores(spark, sf):
    """The flagship: counts, dense panel, lags, persistence, scores by horizon and split."""
    return neat(evaluate.scores(forecast.persistence(lagged(spark, sf)), ["split", "horizon"]))


def model_scores(spark, sf):
    return neat(evaluate.scores(predictions(spark, sf), ["model", "split", "horizon"], describe=True))


def rounded_scores(spark, sf):
    return evaluate.rounded(evaluate.scores(predictions(spark, sf), ["model", "split", "horizon"]))


def outbreak_scores(spark, sf):
    return neat(evaluate.outbreak_scores(predictions(spark, sf), ["model", "horizon"]))


def auc_scores(spark, sf):
    return neat(evaluate.auc(settled(predictions(spark, sf)), ["model", "horizon"]))


def entity_outbreak_scores(spark, sf):
    return neat(evaluate.entity_scores(predictions(spark, sf), by=["model", "split", "horizon"]))


def wide_horizon_scores(spark, sf):
    rows = lagged(spark, sf)
    wide = rows.select(F.col("cases").alias("y_true"), *[
        F.col(f"cases_lag{h}").alias(f"y_pred_h{h}") for h in range(1, 5)])
    return neat(evaluate.horizon_scores(wide))


def full_evaluation(spark, sf):
    return neat(evaluate.full_evaluation(predictions(spark, sf), 3, by=["model", "horizon"]))


def _by_entity(spark, sf):
    return evaluate.scores(predictions(spark, sf), ["model", "split", "horizon", "entity_id"], describe=True)


def entity_horizon_scores(spark, sf):
    return neat(_by_entity(spark, sf))


def shared_support(spark, sf):
    shared = evaluate.common_support(settled(predictions(spark, sf)))
    return neat(evaluate.scores(shared, ["model", "split", "horizon"]))


def _winners_table(spark, sf):
    return evaluate.winners(_by_entity(spark, sf), MODEL_ORDER, by=["split", "entity_id", "horizon"])


def winners(spark, sf):
    return neat(_winners_table(spark, sf))


def win_counts(spark, sf):
    return neat(evaluate.win_counts(_winners_table(spark, sf), ["split"]))


def macro_mae(spark, sf):
    return neat(evaluate.macro_mae(_by_entity(spark, sf), range(5), ["split"]))


def horizon_winners(spark, sf):
    return neat(evaluate.horizon_winners(_by_entity(spark, sf), MODEL_ORDER, by=["split"]))


def beats_baseline(spark, sf):
    return neat(evaluate.beats_baseline(_by_entity(spark, sf), "lag4", by=["split"]))


def hardest_and_easiest(spark, sf):
    return neat(evaluate.hardest_and_easiest(settled(_by_entity(spark, sf)), "lag4", by=["split"]))


def ensemble_against_best(spark, sf):
    single = settled(predictions(spark, sf))
    chosen = forecast.route(single, routing_table(spark, ROUTING))
    everything = single.unionByName(chosen.drop("model_used"))
    return neat(evaluate.ensemble_against_best(evaluate.scores(everything, ["model", "split", "horizon"])))


def safe_mae(spark, sf):
    """By entity and week of the year: groups of a few years, of which some are too few."""
    return neat(evaluate.safe_mae(predictions(spark, sf), ["model", "split", "horizon", "entity_id", "epi_week"]))


def year_errors(spark, sf):
    return neat(evaluate.year_errors(predictions(spark, sf), ["model", "horizon"]))


def residual_summary(spark, sf):
    return neat(evaluate.residual_summary(predictions(spark, sf)))


def degradation(spark, sf):
    return neat(evaluate.degradation(evaluate.scores(predictions(spark, sf), ["model", "split", "horizon"])))


def run_comparison(spark, sf):
    """Three logged runs, one of them logged twice, and the last beside the run before it."""
    path = scratch(spark, "runs")
    table = settled(evaluate.scores(predictions(spark, sf), ["model", "split", "horizon"]))
    runs.log_run(table.where("model = 'historical_mean'"), path, "0001", datetime(2024, 1, 1))
    runs.log_run(table, path, "0002", datetime(2024, 2, 1))
    runs.log_run(table.where("model = 'lag4'"), path, "0002", datetime(2024, 2, 2))
    runs.log_run(table.where("model <> 'lag4'"), path, "0003", datetime(2024, 3, 1))
    return neat(runs.against_earlier(runs.read_runs(spark, path), "0003"))


def model_deltas(spark, sf):
    table = evaluate.scores(predictions(spark, sf), ["model", "split", "horizon"])
    return neat(evaluate.model_deltas(table, "persistence", "lag4"))


def rolling_folds(spark, sf):
    return fold_ops.rolling_folds(panel(spark, sf))


def fold_members(spark, sf):
    dense = panel(spark, sf)
    inside = fold_ops.in_folds(dense, fold_ops.rolling_folds(dense, first=30, step=10, length=3))
    return inside.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("cases").alias("total"))


def fold_scores(spark, sf):
    dense = settled(panel(spark, sf))
    return neat(fold_ops.fold_scores(predictions(spark, sf), dense, fold_ops.rolling_folds(dense)))


def fold_stability(spark, sf):
    dense = settled(panel(spark, sf))
    table = fold_ops.fold_scores(predictions(spark, sf), dense, fold_ops.rolling_folds(dense))
    return neat(fold_ops.stability(table))


def block_scores(spark, sf):
    blocks = fold_ops.block_table(spark, BLOCKS)
    return neat(fold_ops.block_scores(predictions(spark, sf), panel(spark, sf), blocks))


def expanding_folds(spark, sf):
    dense = panel(spark, sf)
    assigned = fold_ops.assign_folds(dense, fold_ops.expanding_folds(dense))
    return assigned.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cases").alias("total"),
        F.min("year").alias("from_year"), F.max("year").alias("to_year"))


QUERIES = {f.__name__: f for f in (
    persistence_scores, model_scores, rounded_scores, outbreak_scores, auc_scores,
    entity_outbreak_scores, wide_horizon_scores, full_evaluation, entity_horizon_scores,
    shared_support, winners, win_counts, macro_mae, horizon_winners, beats_baseline,
    hardest_and_easiest, ensemble_against_best, safe_mae, year_errors, residual_summary,
    degradation, run_comparison, model_deltas, rolling_folds, fold_members, fold_scores,
    fold_stability, block_scores, expanding_folds,
)}

_SCORES = """avg(abs(y_real - y_pred)) AS mae, sqrt(avg((y_real - y_pred) * (y_real - y_pred))) AS rmse,
      avg(CASE WHEN y_real <> 0 THEN abs((y_real - y_pred) / y_real) END) * 100 AS mape,
      CASE WHEN count(*) < 2 THEN NULL
        WHEN min(y_real) = max(y_real) THEN CASE WHEN sum((y_real - y_pred) * (y_real - y_pred)) = 0 THEN 1.0 ELSE 0.0 END
        ELSE 1 - sum((y_real - y_pred) * (y_real - y_pred)) / (count(*) * var_pop(y_real)) END AS r2,
      count(*)::BIGINT AS n"""
_FLOATS = ["mae", "rmse", "mape", "r2"]
_DESCRIBE = ", avg(y_real) AS mean_real, max(y_real) AS max_real, var_pop(y_pred) AS var_pred"


def _outbreak(t: int) -> str:
    hit = f"count(*) FILTER (WHERE y_real >= {t} AND y_pred >= {t})"
    return f"""coalesce({hit}::DOUBLE / nullif(count(*) FILTER (WHERE y_pred >= {t}), 0), 0.0) AS precision,
      coalesce({hit}::DOUBLE / nullif(count(*) FILTER (WHERE y_real >= {t}), 0), 0.0) AS recall,
      coalesce(2.0::DOUBLE * {hit} / nullif(count(*) FILTER (WHERE y_real >= {t}) + count(*) FILTER (WHERE y_pred >= {t}), 0), 0.0) AS f1"""


_CLASS = ["precision", "recall", "f1"]
_GROUP = f"SELECT model, split, horizon, {_SCORES} FROM predictions GROUP BY ALL"
_ENTITY = {**PREDICTIONS_CTE, "entity_scores": f"""
    SELECT model, split, horizon, entity_id, {_SCORES} {_DESCRIBE} FROM predictions GROUP BY ALL"""}
_PLACE = "CASE model WHEN 'persistence' THEN 1 WHEN 'lag4' THEN 2 ELSE 3 END"


def _winners(source: str, by: str) -> str:
    return f"""
    SELECT {by}, model, mae, baseline_mae, coalesce(model <> 'persistence' AND mae < baseline_mae, false) AS beats_baseline FROM (
      SELECT *, min(CASE WHEN model = 'persistence' THEN mae END) OVER (PARTITION BY {by}) AS baseline_mae,
        row_number() OVER (PARTITION BY {by} ORDER BY mae, {_PLACE}) AS place FROM {source}) WHERE place = 1"""


_FOLDS = """
    SELECT (f + 1)::BIGINT AS fold, year, epi_week,
      first_value(year || '-SE' || lpad(epi_week::VARCHAR, 2, '0')) OVER v AS fold_label,
      first_value(year) OVER v AS from_year, first_value(epi_week) OVER v AS from_week,
      last_value(year) OVER v AS to_year, last_value(epi_week) OVER v AS to_week
    FROM numbered JOIN range(0, 1000) r(f) ON no >= {first} + f * {step} AND no < {first} + f * {step} + {length}
    WHERE {first} + f * {step} < total - {length}
    WINDOW v AS (PARTITION BY f ORDER BY year, epi_week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
_NUMBERED = """
    SELECT year, epi_week, row_number() OVER (ORDER BY year, epi_week) - 1 AS no, count(*) OVER () AS total
    FROM (SELECT DISTINCT year, epi_week FROM panel)"""
_FOLD_CTE = {"numbered": _NUMBERED, "folds": _FOLDS.format(first=26, step=4, length=4)}
_FOLD_SCORES = """
    SELECT s.*, m.mean_cases FROM (
      SELECT fold, fold_label, from_year, from_week, to_year, to_week, model, horizon, avg(abs(y_real - y_pred)) AS mae, count(*)::BIGINT AS n
      FROM predictions JOIN folds USING (year, epi_week) GROUP BY ALL HAVING count(*) >= 5) s
    JOIN (SELECT fold, avg(cases) AS mean_cases FROM panel JOIN folds USING (year, epi_week) GROUP BY 1) m USING (fold)"""
_WIDE = " UNION ALL ".join(
    f"SELECT {h}::INT AS horizon, cases::DOUBLE AS y_real, cases_lag{h}::DOUBLE AS y_pred FROM mt WHERE cases_lag{h} IS NOT NULL"
    for h in range(1, 5))
_COMMON = """
    SELECT p.* FROM predictions p JOIN (
      SELECT split, horizon, entity_id, year, epi_week FROM predictions GROUP BY ALL
      HAVING count(DISTINCT model) = CASE WHEN horizon = 0 THEN 3 ELSE 2 END) k
    USING (split, horizon, entity_id, year, epi_week)"""

ORACLES = {
    "persistence_scores": sql(neat_wrap(
        f"SELECT split, horizon, {_SCORES} FROM predictions WHERE model = 'persistence' GROUP BY ALL", _FLOATS),
        "panel", extra=PREDICTIONS_CTE),
    "model_scores": sql(neat_wrap(
        f"SELECT model, split, horizon, {_SCORES} {_DESCRIBE} FROM predictions GROUP BY ALL",
        [*_FLOATS, "mean_real", "max_real", "var_pred"]), "panel", extra=PREDICTIONS_CTE),
    "rounded_scores": sql(f"""SELECT * REPLACE (round_even(mae, 2) AS mae, round_even(rmse, 2) AS rmse,
      round_even(mape, 1) AS mape, round_even(r2, 3) AS r2) FROM ({_GROUP})""", "panel", extra=PREDICTIONS_CTE),
    "outbreak_scores": sql(neat_wrap(f"SELECT model, horizon, {_outbreak(5)} FROM predictions GROUP BY ALL", _CLASS),
                           "panel", extra=PREDICTIONS_CTE),
    "auc_scores": sql(neat_wrap("""
    SELECT model, horizon, (sum(CASE WHEN pos THEN r ELSE 0 END) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
      / nullif(count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos), 0) AS auc_roc
    FROM (SELECT model, horizon, y_real >= 5 AS pos, rank() OVER (PARTITION BY model, horizon ORDER BY y_pred)
      + (count(*) OVER (PARTITION BY model, horizon, y_pred) - 1) / 2.0 AS r FROM predictions) GROUP BY ALL""", ["auc_roc"]),
                      "panel", extra=PREDICTIONS_CTE),
    "entity_outbreak_scores": sql(neat_wrap(f"""
    SELECT model, split, horizon, entity_id, {_SCORES}, {_outbreak(5)} FROM predictions GROUP BY ALL""",
                                            [*_FLOATS, *_CLASS]), "panel", extra=PREDICTIONS_CTE),
    "wide_horizon_scores": sql(neat_wrap(f"SELECT horizon, {_SCORES} FROM wide GROUP BY 1", _FLOATS), "panel",
                               extra={**ROWS_CTE, "wide": _WIDE}),
    "full_evaluation": sql(neat_wrap(f"""
    SELECT *, recall AS detection_rate FROM (SELECT model, horizon, entity_id, CASE WHEN grouping(entity_id) = 1 THEN 'global' ELSE 'entity' END AS level,
      {_SCORES}, {_outbreak(3)} FROM predictions GROUP BY GROUPING SETS ((model, horizon, entity_id), (model, horizon)))""",
                                     [*_FLOATS, *_CLASS, "detection_rate"]), "panel", extra=PREDICTIONS_CTE),
    "entity_horizon_scores": sql(neat_wrap("SELECT * FROM entity_scores", [*_FLOATS, "mean_real", "max_real", "var_pred"]),
                                 "panel", extra=_ENTITY),
    "shared_support": sql(neat_wrap(f"SELECT model, split, horizon, {_SCORES} FROM common GROUP BY ALL", _FLOATS),
                          "panel", extra={**PREDICTIONS_CTE, "common": _COMMON}),
    "winners": sql(neat_wrap(_winners("entity_scores", "split, entity_id, horizon"), ["mae", "baseline_mae"]), "panel", extra=_ENTITY),
    "win_counts": sql(neat_wrap(f"""
    SELECT split, model, n_wins, n_wins * 100.0 / sum(n_wins) OVER (PARTITION BY split) AS pct FROM (
      SELECT split, model, count(*)::BIGINT AS n_wins FROM ({_winners('entity_scores', 'split, entity_id, horizon')}) GROUP BY ALL)""", ["pct"]),
                      "panel", extra=_ENTITY),
    "macro_mae": sql(neat_wrap("SELECT split, model, " + ", ".join(
        f"avg(CASE WHEN horizon = {h} THEN mae END) AS mae_h{h}" for h in range(5)) + " FROM entity_scores GROUP BY ALL",
        [f"mae_h{h}" for h in range(5)]), "panel", extra=_ENTITY),
    "horizon_winners": sql(neat_wrap(_winners(
        "(SELECT split, model, horizon, avg(mae) AS mae FROM entity_scores GROUP BY ALL)", "split, horizon"), ["mae", "baseline_mae"]),
        "panel", extra=_ENTITY),
    "beats_baseline": sql(neat_wrap("""
    SELECT *, model_mae < baseline_mae AS beats FROM (SELECT split, horizon, avg(CASE WHEN model = 'lag4' THEN mae END) AS model_mae,
      avg(CASE WHEN model = 'persistence' THEN mae END) AS baseline_mae FROM entity_scores GROUP BY ALL)
    WHERE model_mae IS NOT NULL AND baseline_mae IS NOT NULL""",
                                    ["model_mae", "baseline_mae"]), "panel", extra=_ENTITY),
    "hardest_and_easiest": sql(neat_wrap("""
    SELECT split, entity_id, mae, kind FROM (
      (SELECT *, 'hardest' AS kind FROM means QUALIFY row_number() OVER (PARTITION BY split ORDER BY mae DESC, entity_id) <= 3) UNION ALL
      (SELECT *, 'easiest' AS kind FROM means QUALIFY row_number() OVER (PARTITION BY split ORDER BY mae, entity_id) <= 3))""", ["mae"]),
        "panel", extra={**_ENTITY, "means": "SELECT split, entity_id, avg(mae) AS mae FROM entity_scores WHERE model = 'lag4' GROUP BY ALL"}),
    "ensemble_against_best": sql(neat_wrap(f"""
    SELECT b.split, b.horizon, e.mae AS ensemble_mae, b.model AS best_model, b.mae AS best_mae, e.mae - b.mae AS delta,
      CASE WHEN e.mae - b.mae <= 0.5 THEN 'even' WHEN e.mae - b.mae <= 2 THEN 'close' ELSE 'worse' END AS verdict
    FROM (SELECT split, horizon, {_SCORES} FROM routed GROUP BY ALL) e
    JOIN (SELECT * FROM ({_GROUP}) QUALIFY row_number() OVER (PARTITION BY split, horizon ORDER BY mae, model) = 1) b
      ON e.split = b.split AND e.horizon = b.horizon""", ["ensemble_mae", "best_mae", "delta"]), "panel", extra=ROUTED_CTE),
    "safe_mae": sql(neat_wrap("""
    SELECT model, split, horizon, entity_id, epi_week, CASE WHEN count(*) >= 5 THEN avg(abs(y_real - y_pred)) END AS mae,
      count(*)::BIGINT AS n FROM predictions GROUP BY ALL""", ["mae"]), "panel", extra=PREDICTIONS_CTE),
    "year_errors": sql(neat_wrap("""
    SELECT model, horizon, year, avg(y_real) AS mean_real, avg(y_pred) AS mean_pred, avg(abs(y_real - y_pred)) AS mae,
      count(*)::BIGINT AS n FROM predictions GROUP BY ALL""", ["mean_real", "mean_pred", "mae"]), "panel", extra=PREDICTIONS_CTE),
    "residual_summary": sql(neat_wrap("""
    SELECT model, split, avg(y_real - y_pred) AS mean_residual, stddev_pop(y_real - y_pred) AS std_residual,
      min(y_real - y_pred) AS min_residual, max(y_real - y_pred) AS max_residual FROM predictions GROUP BY ALL""",
                                      ["mean_residual", "std_residual", "min_residual", "max_residual"]),
                            "panel", extra=PREDICTIONS_CTE),
    "degradation": sql(neat_wrap("SELECT model, split, " + ", ".join(
        f"max(CASE WHEN horizon = {h} THEN {m} END) AS {m}_h{h}" for m in ("mae", "r2") for h in range(1, 5))
        + f" FROM ({_GROUP}) GROUP BY ALL", [f"{m}_h{h}" for m in ("mae", "r2") for h in range(1, 5)]),
        "panel", extra=PREDICTIONS_CTE),
    "run_comparison": sql(neat_wrap(f"""
    SELECT split, model, horizon, mae, rmse, r2, CASE WHEN model = 'lag4' THEN 'earlier' ELSE 'current' END AS run,
      min(mae) OVER (PARTITION BY split, horizon) AS best_mae, mae - min(mae) OVER (PARTITION BY split, horizon) AS delta_to_best
    FROM ({_GROUP})""", ["mae", "rmse", "r2", "best_mae", "delta_to_best"]), "panel", extra=PREDICTIONS_CTE),
    "model_deltas": sql(neat_wrap(f"""
    SELECT *, mae_second - mae_first AS delta FROM (SELECT split, horizon,
      max(CASE WHEN model = 'persistence' THEN mae END) AS mae_first, max(CASE WHEN model = 'lag4' THEN mae END) AS mae_second
      FROM ({_GROUP}) GROUP BY ALL)""", ["mae_first", "mae_second", "delta"]), "panel", extra=PREDICTIONS_CTE),
    "rolling_folds": sql("SELECT * FROM folds", "panel", extra=_FOLD_CTE),
    "fold_members": sql("""
    SELECT year, count(*)::BIGINT AS n, sum(cases)::BIGINT AS total FROM panel
    WHERE (year, epi_week) IN (SELECT (year, epi_week) FROM folds) GROUP BY 1""", "panel",
                        extra={"numbered": _NUMBERED, "folds": _FOLDS.format(first=30, step=10, length=3)}),
    "fold_scores": sql(neat_wrap(_FOLD_SCORES, ["mae", "mean_cases"]), "panel", extra={**PREDICTIONS_CTE, **_FOLD_CTE}),
    "fold_stability": sql(neat_wrap(f"""
    SELECT *, std_mae * 100 / mean_mae AS cv_pct FROM (SELECT model, horizon, avg(mae) AS mean_mae,
      stddev_samp(mae) AS std_mae, count(*)::BIGINT AS n_folds FROM ({_FOLD_SCORES}) GROUP BY ALL)""",
                                    ["mean_mae", "std_mae", "cv_pct"]), "panel", extra={**PREDICTIONS_CTE, **_FOLD_CTE}),
    "block_scores": sql(neat_wrap("""
    SELECT s.*, mean_cases, max_cases FROM (
      SELECT block, model, horizon, avg(abs(y_real - y_pred)) AS mae, count(*)::BIGINT AS n
      FROM predictions JOIN blocks ON year = y AND epi_week BETWEEN lo AND hi GROUP BY ALL HAVING count(*) >= 5) s
    JOIN (SELECT block, avg(cases) AS mean_cases, max(cases) AS max_cases FROM panel
      JOIN blocks ON year = y AND epi_week BETWEEN lo AND hi GROUP BY 1) m USING (block)""", ["mae", "mean_cases"]), "panel",
        extra={**PREDICTIONS_CTE, "blocks": "SELECT * FROM (VALUES " + ", ".join(
            f"('{n}', {y}, {a}, {b})" for n, y, a, b in BLOCKS) + ") t(block, y, lo, hi)"}),
    "expanding_folds": sql("""
    SELECT fold::INT AS fold, role, count(*)::BIGINT AS n, sum(cases)::BIGINT AS total, min(year) AS from_year, max(year) AS to_year
    FROM (SELECT f + 1 AS fold, cases, year, CASE WHEN no < start THEN 'train' WHEN no < start + part THEN 'validation' END AS role
      FROM (SELECT *, total - (5 - f) * (total // 6) AS start, total // 6 AS part
        FROM panel JOIN numbered USING (year, epi_week) CROSS JOIN range(0, 5) r(f)) WHERE start >= 52)
    WHERE role IS NOT NULL GROUP BY ALL""", "panel", extra={"numbered": _NUMBERED}),
}
