from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from weekloom.operators import cleaning
from weekloom.operators.ranks import average_ranks, distinct_positions, exact_quantiles


def test_labels(spark, rows):
    raw = spark.createDataFrame([(" comuna 7 ",), ("COMUNA 7",), ("nowhere",), (None,)], "label string")
    mapping = spark.createDataFrame([("COMUNA 7", 7)], "label string, entity_id int")
    assert rows(cleaning.map_labels(raw, mapping)) == [(7,), (7,)]
    assert ("NOWHERE", 1) in rows(cleaning.unmapped_labels(raw, mapping))


def test_weeks_and_counts(spark, rows):
    raw = spark.createDataFrame(
        [("2023", "1", "3"), ("2023", "54", "3"), ("n/a", "1", "1"), ("2023", "2.0", None), ("2017", "1", "1"),
         ("2024", "53", "-1"), ("2024", "53", "x")], "year string, epi_week string, cases string")
    got = cleaning.clean_counts(cleaning.clean_weeks(raw))
    assert rows(got) == [(2023, 1, 3), (2023, 2, 0), (2024, 53, 0)]


def test_ranges_are_inclusive(spark, rows):
    frame = spark.createDataFrame([(-5.0,), (45.0,), (45.1,), (None,)], "temp_max double")
    limited = cleaning.limit_ranges(frame, cleaning.DAILY_WEATHER_BOUNDS)
    assert sorted(r[0] for r in limited.collect() if r[0] is not None) == [-5.0, 45.0]
    assert rows(cleaning.out_of_range_counts(frame, cleaning.DAILY_WEATHER_BOUNDS)) == [("temp_max", 1)]


def test_interpolation_stays_within_the_entity(spark):
    data = [(1, 2023, w, v) for w, v in enumerate([None, 2.0, None, None, 8.0, None], 1)]
    data += [(2, 2023, w, None) for w in range(1, 4)]
    frame = spark.createDataFrame(data, "entity_id int, year int, epi_week int, x double")
    got = cleaning.interpolate(frame, ["x"]).orderBy("entity_id", "epi_week").collect()
    assert [r["x"] for r in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0, None, None, None]


def test_repair_nulls_then_fills(spark):
    frame = spark.createDataFrame([(1, 2023, 1, 10, 20.0), (1, 2023, 2, 9000, 99.0), (1, 2023, 3, 20, 30.0)],
                                  "entity_id int, year int, epi_week int, cases bigint, temp_mean double")
    bounds = {**cleaning.MASTER_BOUNDS, "cases": (0, 5000)}
    got = cleaning.repair_ranges(frame, bounds).orderBy("epi_week").collect()
    assert [(r["cases"], r["temp_mean"]) for r in got] == [(10.0, 20.0), (15.0, 25.0), (20.0, 30.0)]


def test_high_counts_stay(spark):
    frame = spark.createDataFrame([(1, 2031, w, n) for w, n in enumerate([6000, 9000, -1, 8000], 1)],
                                  "entity_id int, year int, epi_week int, cases bigint")
    got = cleaning.repair_ranges(frame).orderBy("epi_week").collect()
    assert [r["cases"] for r in got] == [6000.0, 9000.0, 8500.0, 8000.0]
    assert cleaning.clean_weeks(frame).count() == 4


def test_dropped_weeks_are_counted(spark, rows):
    frame = spark.createDataFrame([("2040", "1"), ("1999", "2"), ("x", "3"), ("2020", "60"), ("2020", "7.5"), ("2020", "7.0")],
                                  "year string, epi_week string")
    assert rows(cleaning.dropped_weeks(frame)) == [("unreadable", 2), ("week", 1), ("year", 1)]
    assert rows(cleaning.clean_weeks(frame)) == [(2020, 7), (2040, 1)]


def test_large_counts_are_read_exactly(spark, rows):
    frame = spark.createDataFrame([("9007199254740993",), ("7.9",), ("7.0",), (None,)], "cases string")
    assert rows(cleaning.clean_counts(frame)) == [(0,), (0,), (7,), (9007199254740993,)]


def test_a_label_with_two_ids_fails(spark):
    frame = spark.createDataFrame([("a", 1)], "label string, cases int")
    twice = spark.createDataFrame([("A", 1), ("A", 1)], "label string, entity_id int")
    assert cleaning.map_labels(frame, twice).count() == 1
    two = spark.createDataFrame([("A", 1), ("A", 2)], "label string, entity_id int")
    with pytest.raises(Exception, match="several ids"):
        cleaning.map_labels(frame, two).collect()


def test_interpolation_of_the_whole_order(spark):
    """Without groups, gaps are filled along the order of the table, also where they span ranges."""
    rng = np.random.default_rng(4)
    data = [(e, y, w, float(rng.integers(1, 50)) if rng.random() < 0.3 and not (y == 2020 and 8 < w < 33) else None, None,
             1.5 if (e, y, w) == (2, 2020, 9) else None) for y in (2020, 2021) for w in range(1, 40) for e in range(1, 13)]
    schema = "entity_id int, year int, epi_week int, x double, none double, one double"
    frame = spark.createDataFrame(data, schema).repartition(5)
    want = pd.DataFrame(data, columns=["entity_id", "year", "epi_week", "x", "none", "one"]).sort_values(["year", "epi_week", "entity_id"])
    expected = pd.to_numeric(want["x"]).interpolate(limit_direction="both")
    for partitions in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = cleaning.interpolate(frame, ["x", "none", "one"], by=[]).toPandas().sort_values(["year", "epi_week", "entity_id"])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert np.allclose(got["x"], expected) and got["none"].isna().all() and (got["one"] == 1.5).all()
    assert cleaning.interpolate(frame.limit(0), ["x"], by=[]).count() == 0


def test_formats_round_half_even(spark, rows):
    frame = spark.createDataFrame([(1, 2023, 1, 0.0625, 1.2344)], "entity_id bigint, year bigint, epi_week bigint, a double, b double")
    got = cleaning.standard_formats(frame, ["year", "epi_week", "entity_id"])
    assert got.columns[:3] == ["year", "epi_week", "entity_id"] and dict(got.dtypes)["year"] == "int"
    assert rows(got, "a", "b") == [(0.062, 1.234)]


def test_duplicates(spark, rows):
    frame = spark.createDataFrame([(1, 2023, 1, 2, "b"), (1, 2023, 1, 1, "a"), (1, 2023, 2, 3, "c")],
                                  "entity_id int, year int, epi_week int, n int, v string")
    assert rows(cleaning.duplicate_report(frame)) == [(1, 2023, 1, 2)]
    assert rows(cleaning.first_per_key(frame, ["n"])) == [(1, 2023, 1, 1, "a"), (1, 2023, 2, 3, "c")]


def test_missing_report(spark, rows):
    frame = spark.createDataFrame([(1, None), (None, None), (2, 1.0)], "a int, b double")
    assert rows(cleaning.missing_report(frame)) == [("a", 1, 33.33), ("b", 2, 66.67)]


def test_date_gaps(spark, rows):
    days = [date(2024, 1, d) for d in (1, 2, 5, 6, 9, 9)]
    frame = spark.createDataFrame([(d,) for d in days], "date date")
    assert rows(cleaning.date_gaps(frame)) == [(2,)]


def test_date_gaps_move_words_of_days(spark, rows):
    """Dates around 1970, edges of words, repeated, null and alone, against a sorted list."""
    rng = np.random.default_rng(3)
    series = {k: {date(1969, 6, 1) + timedelta(int(d)) for d in rng.choice(700, n)} for k, n in ((1, 650), (2, 300), (3, 1), (None, 90))}
    series[4] = {date(1970, 1, 1) + timedelta(d) for d in range(-64, 130)}
    series[5] = {date(1970, 1, 1) + timedelta(d) for d in (-65, -64, -1, 0, 63, 65, 127, 128, 192)}
    frame = spark.createDataFrame([(k, d) for k, days in series.items() for d in days] * 2 + [(1, None), (6, None)], "k int, date date")
    want = {k: sum((b - a).days > 1 for a, b in zip(sorted(days), sorted(days)[1:])) for k, days in series.items()}
    got = cleaning.date_gaps(frame, by=["k"])
    assert dict(rows(got)) == want
    assert rows(cleaning.date_gaps(frame.where("k = 6"))) == [(-1,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "hashpartitioning(k" in plan and "_day#" not in plan.replace("_days#", "")


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=700), np.zeros(400), rng.integers(0, 5, 300)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = exact_quantiles(frame, "v", {"a": 0.25, "b": 0.5, "c": 0.95}).first()
    assert np.allclose(tuple(got), np.quantile(values, [0.25, 0.5, 0.95]))


def test_positions_count_ties_once(spark, rows):
    frame = spark.createDataFrame([("a", v) for v in (1, 1, 1, 2, 5)] + [("b", 9)], "g string, v int")
    assert rows(distinct_positions(frame, "v", ["g"])) == [
        ("a", 1, 3, 0, 5), ("a", 2, 1, 3, 5), ("a", 5, 1, 4, 5), ("b", 9, 1, 0, 1)]
    assert rows(average_ranks(frame, "v", ["g"]), "g", "v", "rank") == [
        ("a", 1, 2.0), ("a", 2, 4.0), ("a", 5, 5.0), ("b", 9, 1.0)]


def test_iqr_outliers(spark, rows):
    frame = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 100]], "x double, y double")
    assert rows(cleaning.iqr_outliers(frame, ["x", "y"]), "variable", "n_outliers", "n") == [("x", 1, 6), ("y", 0, 6)]


def test_quantiles_keep_the_null_group(spark, rows):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "g string, x double")
    assert rows(exact_quantiles(frame, "x", {"q": 0.5}, ["g"])) == [("a", 2.0), (None, 4.0)]
    assert average_ranks(frame, "x", ["g"]).count() == 4
