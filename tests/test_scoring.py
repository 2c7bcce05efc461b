from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import evaluate, folds, forecast
from weekloom.plans.scoring import ensemble_report, walk_forward_report
from weekloom.sources import runs
from weekloom.sources.tables import routing_table

PREDICTIONS = "split string, entity_id int, year int, epi_week int, horizon int, model string, y_real double, y_pred double"


def frame_of(spark, pairs, model="m", entity=1):
    return spark.createDataFrame(
        [("validation", entity, 2024, w, 0, model, float(y), float(p)) for w, (y, p) in enumerate(pairs, 1)], PREDICTIONS)


def test_scores_match_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 9, 200).astype(float), rng.normal(4, 2, 200)
    got = evaluate.scores(frame_of(spark, zip(y, p)).repartition(7), ["model"]).first()
    assert got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["mape"] == pytest.approx(np.abs((y - p) / np.where(y == 0, np.nan, y))[y != 0].mean() * 100)
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("pairs, r2, mape", [
    ([(0, 0), (0, 0)], 1.0, None), ([(0, 1), (0, 0)], 0.0, None), ([(3, 3)], None, 0.0),
    ([(0.1, 0.1)] * 7, 1.0, 0.0), ([(0.1, 0.2)] * 7, 0.0, pytest.approx(100.0)),
])
def test_degenerate_scores(spark, pairs, r2, mape):
    got = evaluate.scores(frame_of(spark, pairs).repartition(3), ["model"]).first()
    assert (got["r2"], got["mape"]) == (r2, mape)


def test_r2_is_stable_far_from_zero(spark):
    y = 1e9 + np.arange(50) % 3
    got = evaluate.scores(frame_of(spark, zip(y, y + 0.5)).repartition(6), ["model"]).first()
    assert got["r2"] == pytest.approx(1 - 0.25 / y.var(), rel=1e-6)


def test_outbreak_scores(spark):
    got = evaluate.outbreak_scores(frame_of(spark, [(6, 5), (5, 1), (0, 9), (0, 0)]), ["model"]).first()
    assert tuple(got)[1:] == (0.5, 0.5, 0.5)
    none = evaluate.outbreak_scores(frame_of(spark, [(0, 0)]), ["model"]).first()
    assert tuple(none)[1:] == (0.0, 0.0, 0.0)


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 10, 120), rng.integers(0, 6, 120)
    pos, neg = p[y >= 5], p[y < 5]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = evaluate.auc(frame_of(spark, zip(y, p)), ["model"]).first()["auc_roc"]
    assert got == pytest.approx(wins / len(pos) / len(neg))
    assert evaluate.auc(frame_of(spark, [(0, 1), (1, 2)]), ["model"]).first()["auc_roc"] is None


def test_full_evaluation_has_global_row(spark, rows):
    both = frame_of(spark, [(6, 6)], entity=1).unionByName(frame_of(spark, [(6, 2)], entity=2))
    assert rows(evaluate.full_evaluation(both), "level", "mae", "detection_rate") == [
        ("entity", 0.0, 1.0), ("entity", 4.0, 0.0), ("global", 2.0, 0.5)]


def test_horizon_scores(spark, rows):
    wide = spark.createDataFrame([(1, 2, 5), (3, 3, None)], "y_true int, y_pred_h1 int, y_pred_h2 int")
    assert rows(evaluate.horizon_scores(wide), "horizon", "mae", "n") == [(1, 0.5, 2), (2, 4.0, 1)]


def test_winner_ties_go_to_the_first_listed(spark, rows):
    table = spark.createDataFrame(
        [("persistence", 1, 0, 2.0), ("b", 1, 0, 2.0), ("persistence", 2, 0, 2.0), ("b", 2, 0, 1.0), ("b", 3, 0, 1.0)],
        "model string, entity_id int, horizon int, mae double")
    best = evaluate.winners(table, ["persistence", "b"])
    assert rows(best, "entity_id", "model", "beats_baseline") == [
        (1, "persistence", False), (2, "b", True), (3, "b", False)]
    assert rows(evaluate.win_counts(best), "model", "n_wins") == [("b", 2), ("persistence", 1)]
    assert rows(evaluate.macro_mae(table, [0])) == [("b", pytest.approx(4 / 3)), ("persistence", 2.0)]


def test_common_support(spark):
    long = frame_of(spark, [(1, 1), (50, 0), (2, 2)], "a")
    short = frame_of(spark, [(1, 1)], "b").withColumn("epi_week", F.lit(3)).withColumn("y_real", F.lit(2.0))
    shared = evaluate.common_support(long.unionByName(short))
    assert {(r["model"], r["epi_week"]) for r in shared.collect()} == {("a", 3), ("b", 3)}


def test_ensemble_verdicts(spark, rows):
    table = spark.createDataFrame(
        [("ensemble", "v", h, m) for h, m in enumerate([1.5, 3.0, 9.0])] + [("a", "v", h, 1.0) for h in range(3)],
        "model string, split string, horizon int, mae double")
    assert rows(evaluate.ensemble_against_best(table), "horizon", "verdict") == [(0, "even"), (1, "close"), (2, "worse")]


def test_safe_mae_and_residuals(spark, rows):
    assert rows(evaluate.safe_mae(frame_of(spark, [(1, 2)] * 4), ["model"])) == [("m", None, 4)]
    assert rows(evaluate.safe_mae(frame_of(spark, [(1, 2)] * 5), ["model"])) == [("m", 1.0, 5)]
    assert rows(evaluate.residual_summary(frame_of(spark, [(1, 2), (5, 2)]), ["model"])) == [("m", 1.0, 2.0, -1.0, 3.0)]


def test_routing(spark, rows):
    base = frame_of(spark, [(1, 1)], "a").unionByName(frame_of(spark, [(1, 2)], "b"))
    both = base.unionByName(base.withColumn("entity_id", F.lit(7)))
    table = routing_table(spark, {0: {"default": "a", "exceptions": {7: "b"}}})
    assert rows(forecast.route(both, table), "entity_id", "model", "model_used", "y_pred") == [
        (1, "ensemble", "a", 1.0), (7, "ensemble", "b", 2.0)]
    assert rows(forecast.usage_share(forecast.route(both, table))) == [("a", 1, 50.0), ("b", 1, 50.0)]


def test_persistence_variants(spark, rows):
    frame = spark.createDataFrame([(1, 2023, 1, 5, None, 6), (1, 2023, 2, 6, 5, None)],
                                  "entity_id int, year int, epi_week int, cases int, cases_lag1 int, target_h1 int")
    assert rows(forecast.persistence(frame, [0, 1]), "horizon", "y_real", "y_pred") == [(0, 6.0, 5.0)]
    assert rows(forecast.persistence(frame, [1], fill_first=True), "y_real", "y_pred") == [(6.0, 0.0)]
    assert rows(forecast.persistence(frame, [1], horizon_blind=True), "y_real", "y_pred") == [(6.0, 5.0)]


def test_historical_mean_falls_back(spark, rows):
    schema = "entity_id int, year int, epi_week int, cases int"
    train = spark.createDataFrame([(1, 2022, 1, 2), (1, 2023, 1, 4), (2, 2023, 1, 9)], schema)
    held = spark.createDataFrame([(1, 2024, 1, 0), (3, 2024, 1, 0), (3, 2024, 2, 0)], schema)
    got = forecast.historical_mean(held, forecast.fit_week_means(train))
    assert rows(got, "entity_id", "epi_week", "y_pred") == [(1, 1, 3.0), (3, 1, 5.0), (3, 2, 0.0)]


@pytest.mark.parametrize("weeks, step, length", [(52, 4, 4), (40, 3, 5), (33, 1, 4)])
def test_rolling_folds_match_a_plain_loop(spark, weeks, step, length):
    frame = spark.createDataFrame([(2023 + w // 52, w % 52 + 1) for w in range(weeks)], "year int, epi_week int")
    want = {(f + 1, w) for f, start in enumerate(range(26, weeks - length, step)) for w in range(start, start + length)}
    got = {(r["fold"], (r["year"] - 2023) * 52 + r["epi_week"] - 1) for r in folds.rolling_folds(frame, 26, step, length).collect()}
    assert got == want


def test_expanding_folds(spark):
    frame = spark.createDataFrame([(2020 + w // 52, w % 52 + 1) for w in range(130)], "year int, epi_week int")
    table = folds.expanding_folds(frame, n_splits=4, min_train=52).groupBy("fold", "role").count().collect()
    # Parts of 26 weeks; the first fold has only 26 weeks of past and is dropped.
    assert {(r["fold"], r["role"], r["count"]) for r in table} == {
        (2, "train", 52), (2, "validation", 26), (3, "train", 78), (3, "validation", 26),
        (4, "train", 104), (4, "validation", 26)}


def test_reports(spark):
    data = [("validation", e, 2024, w, 0, m, float(w), float(w + d))
            for e in range(3) for w in range(1, 41) for m, d in (("persistence", 1), ("boosted", 2))]
    predictions = spark.createDataFrame(data, PREDICTIONS)
    report = ensemble_report([predictions], routing_table(spark, {0: {"default": "boosted"}}))
    assert report.win_counts.first()["model"] == "persistence"
    assert report.ensemble.first()["delta"] == 1.0
    assert report.usage.first()["pct"] == 100.0
    panel = predictions.where("model = 'boosted'").select("entity_id", "year", "epi_week", F.col("y_real").alias("cases"))
    by_fold, steady, blocks = walk_forward_report(predictions, panel, folds.block_table(spark, [("x", 2024, 1, 2), ("none", 2030, 1, 9)]))
    assert by_fold.count() == 2 * 3 and steady.where("std_mae <> 0").count() == 0
    assert {r["block"] for r in blocks.collect()} == {"x"}


def test_unscorable_rows_count_nowhere(spark):
    data = [("m", "test", 1, 1, 2023, 1, 4.0, 5.0), ("m", "test", 1, 1, 2023, 2, 9.0, None), ("m", "test", 1, 1, 2023, 3, None, 2.0)]
    frame = spark.createDataFrame(data, "model string, split string, horizon int, entity_id int, year int, epi_week int, y_real double, y_pred double")
    assert evaluate.scores(frame, ["model"]).first()["n"] == 1
    assert evaluate.entity_scores(frame).first()["n"] == 1
    assert {r["n"] for r in evaluate.full_evaluation(frame).collect()} == {1}
    assert evaluate.safe_mae(frame, ["model"], 1).first()["n"] == 1
    assert evaluate.year_errors(frame).first()["n"] == 1


def test_run_log_replaces_a_run_and_finds_the_one_before(spark, tmp_path, rows):
    path = str(tmp_path / "runs")

    def metrics(mae):
        return spark.createDataFrame([("m", "test", h, mae + h, 1.0, 0.5) for h in (0, 1)],
                                     "model string, split string, horizon int, mae double, rmse double, r2 double")

    for run, day, mae in (("1", 1, 9.0), ("2", 2, 5.0), ("3", 3, 4.0), ("2", 2, 3.0)):
        runs.log_run(metrics(mae), path, run, datetime(2024, 1, day))
    log = runs.read_runs(spark, path)
    assert rows(log.groupBy("run_id").count()) == [("1", 2), ("2", 2), ("3", 2)]
    assert (runs.earlier_run(log, "3"), runs.earlier_run(log, "2"), runs.earlier_run(log, "1")) == ("2", "1", None)
    assert runs.earlier_run(log, "3", F.col("run_id") == "1") == "1"
    assert rows(runs.against_earlier(log, "3"), "horizon", "run", "mae", "delta_to_best") == [
        (0, "current", 4.0, 1.0), (0, "earlier", 3.0, 0.0), (1, "current", 5.0, 1.0), (1, "earlier", 4.0, 0.0)]
    with pytest.raises(ValueError, match="no run before 1"):
        runs.against_earlier(log, "1")
