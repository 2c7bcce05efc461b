from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, week_index, week_label, week_of_index, week_start, year_of_index
from weekloom.operators import panel, weather
from weekloom.plans.ingest import case_panel, master_table, replaced_counts, weather_weeks

PANEL = "entity_id int, year int, epi_week int, cases bigint"


def test_iso_calendar_round_trip(spark):
    days = [date(2020, 12, 20) + timedelta(days=i) for i in range(40)] + [date(2024, 12, 30)]
    frame = spark.createDataFrame([(d,) for d in days], "d date").select("d", iso_year("d").alias("y"), iso_week("d").alias("w"))
    frame = frame.withColumns({"i": week_index("y", "w"), "monday": week_start("y", "w")})
    for r in frame.withColumns({"y2": year_of_index("i"), "w2": week_of_index("i"), "label": week_label("y", "w")}).collect():
        assert (r["y"], r["w"]) == tuple(r["d"].isocalendar())[:2] == (r["y2"], r["w2"])
        assert r["monday"] == r["d"] - timedelta(days=r["d"].weekday())
        assert r["label"] == f"{r['y']}-SE{r['w']:02d}"


def test_densify_fills_iso_weeks(spark, rows):
    frame = spark.createDataFrame([(1, 2020, 53, 4), (1, 2021, 2, 1), (2, 2021, 1, 7)], PANEL)
    dense = panel.densify(frame)
    assert dense.count() == 2 * (53 + 52)
    assert dense.select("entity_id", "year", "epi_week").distinct().count() == dense.count()
    assert rows(dense.where("cases > 0")) == [(1, 2020, 53, 4), (1, 2021, 2, 1), (2, 2021, 1, 7)]


def test_densify_fixed_calendar_domain_and_missing_year(spark, rows):
    frame = spark.createDataFrame([(1, 2020, 53, 4), (1, 2020, 5, 1), (1, 2022, 52, 2)], PANEL)
    domain = spark.createDataFrame([(1,), (9,)], "entity_id int")
    dense = panel.densify(frame, entities=domain, weeks_per_year=52)
    assert dense.count() == 2 * 2 * 52
    assert rows(dense.groupBy("entity_id", "year").agg(F.sum("cases").alias("n"))) == [
        (1, 2020, 1), (1, 2022, 2), (9, 2020, 0), (9, 2022, 0)]
    assert panel.densify(frame, weeks_per_year=52, observed_years_only=False).count() == 3 * 52


def test_densify_first_week_of_the_domain_is_not_doubled(spark):
    frame = spark.createDataFrame([(1, 2021, 1, 4)], PANEL)
    domain = spark.createDataFrame([(1,)], "entity_id int")
    dense = panel.densify(frame, entities=domain)
    assert (dense.count(), dense.agg(F.sum("cases")).first()[0]) == (52, 4)


def test_densify_keeps_totals_beside_null_weeks(spark, rows):
    frame = spark.createDataFrame([(1, 2023, 1, 4), (1, 2023, 3, 5), (1, 2023, None, 100), (2, 2023, None, 7),
                                   (2, 2023, 2, 1), (2, 2023, 2, 2)], PANEL)
    dense = panel.densify(frame)
    assert dense.count() == 2 * 52
    assert rows(dense.where("cases > 0")) == [(1, 2023, 1, 4), (1, 2023, 3, 5), (2, 2023, 2, 3)]
    assert rows(panel.rows_without_week(frame)) == [(1, 1, 100), (2, 1, 7)]


def test_sources_add_up_or_follow_precedence(spark, rows):
    schema = PANEL + ", source string"
    a = spark.createDataFrame([(1, 2024, 1, 3, "national"), (1, 2024, 2, 5, "national")], schema)
    b = spark.createDataFrame([(1, 2024, 1, 4, "city")], schema)
    union = panel.combine_sources([a, b])
    assert rows(panel.weekly_sum(union)) == [(1, 2024, 1, 7), (1, 2024, 2, 5)]
    by_source = panel.weekly_sum(union, by=["source"])
    assert rows(panel.resolve_overlap(by_source, ["city", "national"])) == [
        (1, 2024, 1, 4, "city"), (1, 2024, 2, 5, "national")]
    assert rows(panel.source_summary(union)) == [("city", 1, 4, [2024]), ("national", 2, 8, [2024])]


def test_alignment(spark, rows):
    left = spark.createDataFrame([(2024, 1), (2024, 2)], "year int, epi_week int")
    right = spark.createDataFrame([(2024, 2), (2024, 3)], "year int, epi_week int")
    assert rows(panel.alignment_report(left, right)) == [
        (2024, 1, "panel only"), (2024, 2, "both"), (2024, 3, "weather only")]
    assert rows(panel.weeks_missing_from(left, right)) == [(2024, 1)]
    assert rows(panel.shared_weeks(left, right)) == [(2024, 2)]


DAYS = "date date, temp_max double, temp_min double, temp_mean double, precipitation double, humidity_max double, humidity_min double"


def test_weekly_weather(spark):
    days = [(date(2024, 12, 30), 30.0, 20.0, 27.0, None, 50.0, 30.0), (date(2024, 12, 31), 31.0, 50.0, 26.9, None, 90.0, 70.0)]
    weeks = weather_weeks(spark.createDataFrame(days, DAYS)).collect()
    assert len(weeks) == 1 and (weeks[0]["year"], weeks[0]["epi_week"], weeks[0]["n_days"]) == (2025, 1, 2)
    assert weeks[0]["temp_min_mean"] == 20.0 and weeks[0]["precipitation"] == 0.0
    t, h = 27.0, 40.0
    hot = (-8.78469475556 + 1.61139411 * t + 2.33854883889 * h - 0.14611605 * t * h - 0.012308094 * t * t
           - 0.0164248277778 * h * h + 0.002211732 * t * t * h + 0.00072546 * t * h * h - 0.000003582 * t * t * h * h)
    assert weeks[0]["heat_index_mean"] == pytest.approx((hot + 26.9) / 2)
    assert weeks[0]["temp_mean_anomaly"] == 0.0


def test_anomalies_can_ignore_later_years(spark, rows):
    frame = spark.createDataFrame([(2022, 1, 10.0), (2023, 1, 20.0), (2024, 1, 60.0)], "year int, epi_week int, temp_mean double")
    assert rows(weather.add_anomalies(frame, ["temp_mean"]), "temp_mean_anomaly") == [(-20.0,), (-10.0,), (30.0,)]
    past = weather.add_anomalies(frame, ["temp_mean"], fit_until_year=2023)
    assert rows(past, "temp_mean_anomaly") == [(-5.0,), (5.0,), (45.0,)]


def test_trailing_means_use_calendar_days(spark):
    frame = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 7), 3.0), (date(2024, 1, 8), 5.0)], "date date, x double")
    got = weather.trailing_means(frame, ["x"], spans=[7]).orderBy("date").collect()
    assert [r["x_mean7d"] for r in got] == [1.0, 2.0, 4.0]


def test_ingest_to_master(spark):
    schema = "year string, epi_week string, label string, cases string, source string"
    a = spark.createDataFrame([("2023", "1", "comuna 1", "3", "a"), ("2023", "2", "COMUNA 1", "x", "a")], schema)
    b = spark.createDataFrame([("2023", "1", "Comuna 1 ", "2", "b"), ("2023", "1", "SIN DATO", "9", "b")], schema)
    mapping = spark.createDataFrame([("COMUNA 1", 1), ("COMUNA 2", 2)], "label string, entity_id int")
    dense = case_panel([a, b], mapping, entities=mapping, weeks_per_year=52)
    assert (dense.count(), dense.agg(F.sum("cases")).first()[0]) == (104, 5)
    days = spark.createDataFrame([(date(2023, 1, 2) + timedelta(days=i), 25.0, 15.0, 20.0 + i, 1.0, 80.0, 60.0) for i in range(14)], DAYS)
    master = master_table(dense, weather_weeks(days))
    assert master.count() == 104 and len(master.columns) == 13
    assert master.where("temp_mean is null").count() == 0
    assert master.where("entity_id = 1 and epi_week = 40").first()["temp_mean"] == 30.0


def test_master_keeps_high_counts_and_tells_what_it_replaces(spark, rows):
    dense = spark.createDataFrame([(1, 2031, w, n) for w, n in enumerate([4800, 9000, 5200], 1)], PANEL)
    days = spark.createDataFrame([(date(2030, 12, 30) + timedelta(days=i), 25.0, 15.0, 20.0, 120.0, 80.0, 60.0) for i in range(21)], DAYS)
    weeks = weather_weeks(days)
    master = master_table(dense, weeks)
    assert rows(master, "cases", "precipitation") == [(4800.0, 840.0), (5200.0, 840.0), (9000.0, 840.0)]
    assert {r["column"]: r["n_out_of_range"] for r in replaced_counts(dense, weeks).collect()}["precipitation"] == 0
    capped = master_table(dense, weeks, bounds={"cases": (0, 5000)})
    assert sorted(r["cases"] for r in capped.collect()) == [4800.0, 4800.0, 4800.0]
