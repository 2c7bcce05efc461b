import math

import pytest
from pyspark.sql import functions as F

from weekloom.functions.measures import approximate_month, clip_low, from_log_target, in_season, log_target, outbreak_weight
from weekloom.operators import alerts, augment, features as ops

PANEL = "entity_id int, year int, epi_week int, cases bigint"


@pytest.fixture(scope="module")
def series(spark):
    data = [(1, 2023, w, w * w) for w in range(1, 9)] + [(2, 2023, w, 10 * w) for w in range(1, 9)]
    return spark.createDataFrame(data, PANEL).repartition(3)


def test_scalars(spark):
    r = spark.createDataFrame([(None, 0), (-2.0, 0), (3.0, 9)], "x double, c int").select(
        clip_low(F.col("x")).alias("x"), outbreak_weight(F.col("c")).alias("w"),
        from_log_target(log_target(F.col("c"))).alias("back")).collect()
    assert [v["x"] for v in r] == [None, 0.0, 3.0]
    assert r[2]["w"] == pytest.approx(math.log(10) + 1) and r[2]["back"] == pytest.approx(9)


def test_season_edges(spark):
    r = spark.createDataFrame([(w,) for w in (1, 4, 5, 17, 18, 47, 48, 52, 53)], "w int").select(
        in_season(F.col("w")).alias("s"), approximate_month(F.col("w")).alias("m")).collect()
    assert [v["s"] for v in r] == [1, 1, 1, 1, 0, 0, 1, 1, 1]
    assert [v["m"] for v in r] == [1, 1, 2, 5, 5, 12, 12, 12, 12]


def test_lead_undoes_lag(series):
    both = ops.add_targets(ops.add_lags(series, {"cases": "cases"}))
    inside = both.withColumn("again", F.lag("target_h2", 2).over(ops.DEFAULT_KEYS.series()))
    assert inside.where("again is not null and again <> cases").count() == 0
    first = both.where("entity_id = 1 and epi_week = 1").first()
    assert (first["cases_lag1"], first["target_h1"], first["target_h4"]) == (None, 4, 25)


def test_lags_and_targets_share_one_exchange(series):
    both = ops.add_targets(ops.add_lags(series, {"cases": "cases"}))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(entity_id") == 1 and plan.count("Sort [") == 1


def test_incidence(spark, rows):
    frame = spark.createDataFrame([(3, 40000), (1, None)], "cases bigint, population bigint")
    assert rows(ops.add_incidence(frame), "incidence") == [(0.75,), (None,)]


def test_neighbours_skip_nulls_and_isolated(spark):
    data = [(e, 2023, w, v) for e, w, v in [(1, 1, 1), (1, 2, 5), (2, 1, 10), (2, 2, None), (3, 1, 20), (3, 2, 40), (4, 1, 7), (4, 2, 7)]]
    frame = spark.createDataFrame(data, PANEL)
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 1), (1, 99)], "src int, dst int")
    got = {(r["entity_id"], r["epi_week"]): r["near_lag1"]
           for r in ops.add_neighbour_means(frame, edges, {"cases": "near"}).collect()}
    assert got[(1, 1)] is None and got[(1, 2)] == 15.0 and got[(2, 2)] == 1.0 and got[(4, 2)] is None


def test_weather_lags_follow_weeks(spark):
    frame = spark.createDataFrame([(e, 2023, w, 0, float(w)) for e in (1, 2) for w in range(1, 5)], PANEL + ", temp_mean double")
    got = ops.add_weather_lags(frame, ["temp_mean"], [1, 2]).where("epi_week = 3").collect()
    assert [(r["temp_mean_lag1"], r["temp_mean_lag2"]) for r in got] == [(2.0, 1.0)] * 2


def test_split_keeps_every_row_and_embargo(series, rows):
    split = ops.add_split(series, (2023, 4), (2023, 6))
    assert rows(ops.split_sizes(split)) == [("test", 4), ("train", 8), ("validation", 4)]
    held = ops.add_split(series, (2023, 4), (2023, 6), embargo=1)
    assert rows(ops.split_sizes(held)) == [("embargo", 4), ("test", 4), ("train", 6), ("validation", 2)]


def test_scaler_sees_training_rows_only(spark):
    frame = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("train", None, 5.0), ("test", 100.0, 6.0)],
                                  "split string, x double, flat double")
    fitted = ops.fit_scaler(frame.where("split = 'train'"), ["x", "flat"])
    got = ops.apply_scaler(frame, fitted, ["x", "flat"]).where("split = 'test'").first()
    mean, deviation = 4 / 3, math.sqrt((1 + 9) / 3 - (4 / 3) ** 2)
    assert got["x_norm"] == pytest.approx((100 - mean) / deviation) and got["flat_norm"] == 1.0


def test_min_max_inverts(spark):
    frame = spark.createDataFrame([(2.0,), (6.0,), (10.0,)], "y double")
    fitted = ops.fit_min_max(frame.where("y < 10"), ["y"])
    scaled = ops.apply_min_max(frame, fitted, ["y"])
    assert sorted(r["y_scaled"] for r in scaled.collect()) == [0.0, 1.0, 2.0]
    back = ops.invert_min_max(scaled.withColumn("p", F.col("y_scaled") - 1), fitted, "y", "p")
    assert sorted(r["p"] for r in back.collect()) == [0.0, 2.0, 6.0]


def test_sequences(series):
    tagged = series.withColumn("split", F.lit("train"))
    got = ops.sequence_windows(tagged, ["cases", "epi_week"], "cases", length=3).where("entity_id = 1").orderBy("epi_week").collect()
    assert [r["epi_week"] for r in got] == [4, 5, 6, 7, 8]
    assert got[0]["sequence"] == [[1.0, 1.0], [4.0, 2.0], [9.0, 3.0]] and got[0]["target"] == 16
    ahead = ops.sequence_windows(tagged, ["cases"], "cases", length=3, ahead=2).where("entity_id = 1")
    assert sorted(r["target"] for r in ahead.collect()) == [36, 49, 64]


def test_feature_report(spark, rows):
    frame = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    assert rows(ops.feature_report(frame, {"one": ["a"], "two": ["a", "b", "absent"]})) == [("one", 1, 1), ("two", 2, 2)]


def test_scaled_copies_do_not_depend_on_partitioning(spark, rows):
    frame = spark.createDataFrame([(1, 2023, w, 60 + w, None, 0.5) for w in range(5)],
                                  PANEL + ", cases_lag1 double, cases_lag1_norm double")
    one = augment.scaled_copies(frame.repartition(1))
    assert rows(one) == rows(augment.scaled_copies(frame.repartition(7)))
    assert one.count() == 10 and "cases_lag1_norm" not in one.columns
    for r in one.collect():
        assert abs(r["cases"] / r["factor"] - (60 + r["epi_week"])) < 0.35 * (60 + r["epi_week"])
        assert 0 <= r["cases_lag1"] < 1e-4


def test_noise_is_standard_normal(spark):
    frame = spark.range(20000).select(F.col("id").cast("int").alias("entity_id"), F.lit(2023).alias("year"),
                                      F.lit(1).alias("epi_week"), F.lit(100).cast("bigint").alias("cases"))
    got = augment.scaled_copies(frame, factors=[1.0]).agg(F.avg("cases"), F.stddev("cases")).first()
    assert got[0] == pytest.approx(100, abs=0.2) and got[1] == pytest.approx(5, abs=0.1)


def test_augmented_and_reports(spark, rows):
    frame = spark.createDataFrame([(1, 2023, 1, 0), (1, 2023, 2, 100), (2, 2023, 1, 51)], PANEL)
    both = augment.augmented(frame, augment.scaled_copies(augment.outbreak_weeks(frame)))
    assert rows(augment.augmentation_report(both), "is_synthetic", "n", "pct_zero") == [
        (False, 3, pytest.approx(100 / 3)), (True, 4, 0.0)]
    assert sum(r["n"] for r in augment.augmentation_histogram(both).collect()) == 7
    assert rows(augment.worst_entities(frame)) == [(1, 100), (2, 51)]
    assert rows(augment.outbreak_summary(frame)) == [(2, 3, pytest.approx(200 / 3), 75.5, 100)]


def test_alert_levels(spark, rows):
    train = spark.createDataFrame([(v,) for v in range(101)], "cases bigint")
    fitted = alerts.fit_alert_thresholds(train)
    assert tuple(fitted.first()) == (50.0, 75.0, 90.0, 95.0)
    frame = spark.createDataFrame([(49,), (50,), (75,), (94,), (95,), (None,)], "cases bigint")
    assert [r["alert"] for r in alerts.add_alert_level(frame, fitted).orderBy(F.col("cases").asc_nulls_last()).collect()] == [
        "none", "low", "moderate", "high", "critical", None]


def test_lead_times(spark, rows):
    cases = [0, 3, 4, 6, 7, 0, 0, 9, 1, 4, 1, 1]
    frame = spark.createDataFrame([(1, 2023, w, c) for w, c in enumerate(cases, 1)], PANEL)
    flagged = alerts.add_outbreak_flag(frame).withColumn("is_alert", (F.col("cases").isin(3, 4)).cast("int"))
    assert rows(alerts.lead_times(flagged)) == [(1, 1, 2023, 4, 2), (1, 2, 2023, 8, None)]
