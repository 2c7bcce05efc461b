"""Scores on the long prediction table. Every score is an aggregate with partial states, so
groups that hold most of the rows are reduced before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.aggregates import regression_scores
from weekloom.keys import DEFAULT_KEYS, Keys
from weekloom.operators.ranks import distinct_positions

# Cases a week from which it counts as an outbreak, and the fewest rows for an MAE.
OUTBREAK_CASES = 5
MIN_ROWS = 5
# Decimals of a printed score.
SCORE_DECIMALS = {"mae": 2, "rmse": 2, "r2": 3, "mape": 1}
# How far an ensemble may trail the best single model.
EVEN_MARGIN = 0.5
CLOSE_MARGIN = 2.0


def usable(predictions: DataFrame) -> DataFrame:
    """Rows that can be scored: actual and forecast are known. All scores use these rows alone."""
    return predictions.where(F.col("y_real").isNotNull() & F.col("y_pred").isNotNull())


def scores(predictions: DataFrame, by: Sequence[str], describe: bool = False) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and n per group, with mean and largest actual on request."""
    extra = [
        F.avg("y_real").alias("mean_real"), F.max("y_real").alias("max_real"),
        F.var_pop("y_pred").alias("var_pred"),
    ] if describe else []
    return usable(predictions).groupBy(*by).agg(*regression_scores(F.col("y_real"), F.col("y_pred")), *extra)


def rounded(table: DataFrame) -> DataFrame:
    """Scores as they are printed, rounded half to even."""
    return table.withColumns({
        c: F.bround(c, d) for c, d in SCORE_DECIMALS.items() if c in table.columns})


def safe_mae(predictions: DataFrame, by: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """MAE, null in groups of fewer than ``min_rows``."""
    mae = F.avg(F.abs(F.col("y_real") - F.col("y_pred")))
    n = F.count(F.lit(1))
    return usable(predictions).groupBy(*by).agg(F.when(n >= min_rows, mae).alias("mae"), n.alias("n"))


def outbreak_scores(predictions: DataFrame, by: Sequence[str],
                    threshold: float = OUTBREAK_CASES) -> DataFrame:
    """Precision, recall and F1 of ``>= threshold``; 0 where undefined."""
    return usable(predictions).groupBy(*by).agg(*_outbreak(threshold))


def _outbreak(threshold: float) -> list[Column]:
    real, flagged = F.col("y_real") >= threshold, F.col("y_pred") >= threshold
    hit = F.count_if(real & flagged)
    false_alarm, missed = F.count_if(~real & flagged), F.count_if(real & ~flagged)

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    return [
        ratio(hit, hit + false_alarm).alias("precision"),
        ratio(hit, hit + missed).alias("recall"),
        ratio(hit * 2, hit * 2 + false_alarm + missed).alias("f1"),
    ]


def auc(predictions: DataFrame, by: Sequence[str], threshold: float = OUTBREAK_CASES,
        score: str = "y_pred") -> DataFrame:
    """Area under the ROC curve by the rank sum, tied scores at their mean rank.

    Null when a group has only one class. Ranks come from counts of distinct scores, so no
    group is sorted in one task.
    """
    positive = (F.col("y_real") >= threshold).cast("long")
    places = distinct_positions(usable(predictions), score, by, {"n_positive": positive})
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    sums = places.groupBy(*by).agg(
        F.sum(rank * F.col("n_positive")).alias("_ranks"),
        F.sum("n_positive").alias("_pos"), F.sum("n").alias("_all"))
    pos = F.col("_pos")
    area = F.try_divide(F.col("_ranks") - pos * (pos + 1) / F.lit(2.0), pos * (F.col("_all") - pos))
    return sums.select(*by, area.alias("auc_roc"))


def entity_scores(predictions: DataFrame, threshold: float = OUTBREAK_CASES,
                  keys: Keys = DEFAULT_KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Regression and outbreak scores per entity, apart for each of ``by``, in one aggregate."""
    return usable(predictions).groupBy(*by, keys.entity).agg(
        *regression_scores(F.col("y_real"), F.col("y_pred")), *_outbreak(threshold))


def full_evaluation(predictions: DataFrame, threshold: float = OUTBREAK_CASES,
                    keys: Keys = DEFAULT_KEYS, by: Sequence[str] = ()) -> DataFrame:
    """Entity rows and, for each of ``by``, one overall row (null entity, level ``global``) from one pass."""
    each = [F.col(c) for c in (*by, keys.entity)]
    table = usable(predictions).groupingSets([each, each[:-1]], *each).agg(
        F.when(F.grouping(keys.entity) == 1, "global").otherwise("entity").alias("level"),
        *regression_scores(F.col("y_real"), F.col("y_pred")), *_outbreak(threshold))
    return table.withColumn("detection_rate", F.col("recall"))


def horizon_scores(wide: DataFrame, true_column: str = "y_true", prefix: str = "y_pred_h",
                   horizons: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Scores per horizon of a wide table with one prediction column per horizon."""
    present = [h for h in horizons if f"{prefix}{h}" in wide.columns]
    long = wide.select(
        F.col(true_column).cast("double").alias("y_real"),
        *[F.col(f"{prefix}{h}").cast("double").alias(str(h)) for h in present],
    ).unpivot(["y_real"], [str(h) for h in present], "horizon", "y_pred")
    return scores(long.withColumn("horizon", F.col("horizon").cast("int")), ["horizon"])


def common_support(predictions: DataFrame, keys: Keys = DEFAULT_KEYS,
                   within: Sequence[str] = ("split", "horizon")) -> DataFrame:
    """Only row keys every model of the same split and horizon has predicted.

    Models that need a warm-up otherwise skip the hard weeks and look better than they are.
    """
    row = [*within, *keys.panel]
    models = predictions.groupBy(*within).agg(F.count_distinct("model").alias("_models"))
    covered = predictions.groupBy(*row).agg(F.count_distinct("model").alias("_have"))
    shared = covered.join(F.broadcast(models), list(within)).where(F.col("_have") == F.col("_models"))
    return predictions.join(shared.select(*row), row, "left_semi")


def winners(entity_table: DataFrame, model_order: Sequence[str], baseline: str = "persistence",
            by: Sequence[str] = ("entity_id", "horizon")) -> DataFrame:
    """Model of least MAE per group; ties go to the earlier in ``model_order``.

    ``beats_baseline`` tells whether the winner is another model that is strictly better.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    known = F.when(place == 0, F.lit(len(model_order) + 1)).otherwise(place)
    best = F.min_by(F.struct("model", "mae"), F.struct(F.col("mae"), known, F.col("model")))
    base = F.min(F.when(F.col("model") == baseline, F.col("mae")))
    table = entity_table.where(F.col("mae").isNotNull()).groupBy(*by).agg(
        best.alias("_best"), base.alias("baseline_mae"))
    beats = (F.col("model") != baseline) & (F.col("mae") < F.col("baseline_mae"))
    return table.select(*by, "_best.*", "baseline_mae").withColumn(
        "beats_baseline", F.coalesce(beats, F.lit(False)))


def win_counts(winner_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups won and their percentage per model, apart for each of ``by``."""
    counted = winner_table.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n_wins"))
    # One row per model, so the total is taken on a handful of rows.
    total = F.sum("n_wins").over(Window.partitionBy(*by))
    return counted.select(*by, "model", "n_wins", F.try_divide(F.col("n_wins") * 100.0, total).alias("pct"))


def macro_mae(entity_table: DataFrame, horizons: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Mean of the entities' MAEs: one row per model (and ``by``), one column per horizon."""
    return entity_table.groupBy(*by, "model").agg(*[
        F.avg(F.when(F.col("horizon") == h, F.col("mae"))).alias(f"mae_h{h}") for h in horizons])


def horizon_winners(entity_table: DataFrame, model_order: Sequence[str],
                    baseline: str = "persistence", by: Sequence[str] = ()) -> DataFrame:
    """Model of least mean MAE per horizon, apart for each of ``by``."""
    means = entity_table.groupBy(*by, "model", "horizon").agg(F.avg("mae").alias("mae"))
    return winners(means, model_order, baseline, by=[*by, "horizon"])


def beats_baseline(entity_table: DataFrame, model: str, baseline: str = "persistence",
                   by: Sequence[str] = ()) -> DataFrame:
    """Mean MAE of a model and of the baseline per horizon, and whether it is lower."""
    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col("model") == name, F.col("mae")))

    table = entity_table.groupBy(*by, "horizon").agg(
        mean_of(model).alias("model_mae"), mean_of(baseline).alias("baseline_mae"))
    return table.where(F.col("model_mae").isNotNull() & F.col("baseline_mae").isNotNull()).withColumn(
        "beats", F.col("model_mae") < F.col("baseline_mae"))


def hardest_and_easiest(entity_table: DataFrame, model: str, k: int = 3,
                        entity: str = "entity_id", by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` entities of largest and of smallest mean MAE for one model, for each of ``by``."""
    means = entity_table.where(F.col("model") == model).groupBy(*by, entity).agg(F.avg("mae").alias("mae"))
    # Only k rows of each task and group reach the window.
    hard = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mae"), entity))
    easy = F.row_number().over(Window.partitionBy(*by).orderBy("mae", entity))
    return means.withColumn("_place", hard).where(F.col("_place") <= k).withColumn("kind", F.lit("hardest")).unionByName(
        means.withColumn("_place", easy).where(F.col("_place") <= k).withColumn("kind", F.lit("easiest"))).drop("_place")


def ensemble_against_best(score_table: DataFrame, ensemble: str = "ensemble",
                          by: Sequence[str] = ("split", "horizon")) -> DataFrame:
    """Ensemble MAE minus that of the best single model, with a verdict."""
    is_ensemble = F.col("model") == ensemble
    best = F.min_by(
        F.when(~is_ensemble, F.struct("model", "mae")),
        F.when(~is_ensemble, F.struct("mae", "model")))
    table = score_table.groupBy(*by).agg(
        F.max(F.when(is_ensemble, F.col("mae"))).alias("ensemble_mae"), best.alias("_best"))
    delta = F.col("ensemble_mae") - F.col("_best.mae")
    verdict = F.when(delta <= EVEN_MARGIN, "even").when(delta <= CLOSE_MARGIN, "close").otherwise("worse")
    return table.where(F.col("ensemble_mae").isNotNull() & F.col("_best").isNotNull()).select(
        *by, "ensemble_mae", F.col("_best.model").alias("best_model"),
        F.col("_best.mae").alias("best_mae"), delta.alias("delta"), verdict.alias("verdict"))


def year_errors(predictions: DataFrame, by: Sequence[str] = ("model",),
                year: str = "year") -> DataFrame:
    """Mean actual, mean prediction, MAE and n per year."""
    return usable(predictions).groupBy(*by, year).agg(
        F.avg("y_real").alias("mean_real"), F.avg("y_pred").alias("mean_pred"),
        F.avg(F.abs(F.col("y_real") - F.col("y_pred"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


def residual_summary(predictions: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Mean, population deviation and range of actual minus predicted."""
    residual = F.col("y_real") - F.col("y_pred")
    return usable(predictions).groupBy(*by).agg(
        F.avg(residual).alias("mean_residual"), F.stddev_pop(residual).alias("std_residual"),
        F.min(residual).alias("min_residual"), F.max(residual).alias("max_residual"))


def degradation(score_table: DataFrame, horizons: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """MAE and R2 per model and split, one column per horizon."""
    def at(measure: str, h: int) -> Column:
        return F.max(F.when(F.col("horizon") == h, F.col(measure))).alias(f"{measure}_h{h}")

    return score_table.groupBy("model", "split").agg(
        *[at("mae", h) for h in horizons], *[at("r2", h) for h in horizons])


def comparison(current: DataFrame, earlier: DataFrame, by: Sequence[str] = ("split", "horizon")) -> DataFrame:
    """Scores of this run and of an earlier one, with the distance to the best of the group."""
    columns = [*by, "model", "mae", "rmse", "r2"]
    both = (
        earlier.select(*columns, F.lit("earlier").alias("run"))
        .unionByName(current.select(*columns, F.lit("current").alias("run")))
    )
    best = both.groupBy(*by).agg(F.min("mae").alias("best_mae"))
    return both.join(F.broadcast(best), list(by)).select(
        *columns, "run", "best_mae", (F.col("mae") - F.col("best_mae")).alias("delta_to_best"))


def model_deltas(score_table: DataFrame, first: str, second: str,
                 by: Sequence[str] = ("split", "horizon")) -> DataFrame:
    """MAE of two models side by side and their difference."""
    def mae_of(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("mae")))

    table = score_table.groupBy(*by).agg(mae_of(first).alias("mae_first"), mae_of(second).alias("mae_second"))
    return table.withColumn("delta", F.col("mae_second") - F.col("mae_first"))
