import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.functions.significance import correlation_p_value
from weekloom.operators import explore

PANEL = "entity_id int, year int, epi_week int, cases bigint"


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(
        [(1, 2023, 1, 0), (1, 2023, 2, 6), (2, 2023, 1, 0), (2, 2023, 2, 2), (1, 2024, 1, 4), (1, 2024, 2, 0),
         (2, 2024, 1, 0), (2, 2024, 2, 0)], PANEL)


def test_totals_and_top(panel, rows):
    assert rows(explore.entity_totals(panel)) == [(1, 10), (2, 2)]
    assert [tuple(r) for r in explore.top_weeks(panel, 2).collect()] == [(2023, 2, 8), (2024, 1, 4)]
    assert [tuple(r)[3] for r in explore.top_rows(panel, 2).collect()] == [6, 4]
    assert rows(explore.week_by_entity(panel, [1, 2, 3], 2023)) == [(2023, 1, 0, 0, 0), (2023, 2, 6, 2, 0)]
    assert (2023, 2, 6, 2, 0) in rows(explore.week_by_entity(panel, [1, 2, 3]))
    assert {r[:3]: r[3] for r in rows(explore.week_cells(panel), 'year', 'epi_week', 'entity_id', 'total')}[2023, 2, 1] == 6


def test_season(panel, rows):
    assert rows(explore.season_profile(panel)) == [(1, 2.0, 1), (2, 4.0, 1)]
    assert rows(explore.season_peak(panel)) == [(2, 4.0)]


def test_relative_and_share(panel, rows):
    assert rows(explore.relative_incidence(panel)) == [(1, 2023, 6, 1.5), (1, 2024, 4, 2.0), (2, 2023, 2, 0.5), (2, 2024, 0, 0.0)]
    assert rows(explore.relative_incidence(panel, at_least=1.5), "entity_id", "year") == [(1, 2024)]
    assert rows(explore.focus_share(panel, 1), "year", "epi_week", "pct") == [
        (2023, 1, None), (2023, 2, 75.0), (2024, 1, 100.0), (2024, 2, None)]
    assert tuple(explore.focus_summary(panel, 1, 80).first()) == (1, 2, 4, 100.0, 87.5, 50.0)


def test_imbalance_and_quality(panel, rows, spark):
    assert rows(explore.zero_imbalance(panel, 1)) == [
        ("all", 8, 62.5, 4.0), ("focus", 4, 50.0, 5.0), ("rest", 4, 75.0, 2.0)]
    got = explore.panel_quality(panel).first()
    assert (got["n_rows"], got["n_entities"], got["pct_nonzero"], got["total"], got["max"]) == (8, 2, 37.5, 12, 6)
    domain = spark.createDataFrame([(1,), (5,)], "entity_id int")
    assert rows(explore.missing_entities(panel, domain)) == [(5,)]


def test_master_quality_counts_duplicates(spark):
    frame = spark.createDataFrame([(1, 2023, 1, 2, 1.0, None, 3.0), (1, 2023, 1, 4, 2.0, None, 3.0)],
                                  PANEL + ", temp_mean double, precipitation double, humidity_mean double")
    got = explore.master_quality(frame).first()
    assert (got["n_rows"], got["n_duplicates"], got["mean"], got["mean_temp_mean"], got["mean_precipitation"],
            got["n_null_precipitation"]) == (2, 1, 3.0, 1.5, None, 2)


def test_buckets_have_no_gaps(spark, rows):
    frame = spark.createDataFrame([(v,) for v in (0.0, 0.4, 50.0, 50.4, 200.5, 500.0, 501.0)], "cases double")
    assert rows(explore.bucket_histogram(frame), "bucket", "n") == [
        ("1-50", 2), ("201-500", 2), ("51-200", 1), ("= 0", 1), ("> 500", 1)]


def test_lagged_correlation(spark):
    weather = np.sin(np.arange(30))
    cases = np.roll(weather, 2) * 5
    frame = spark.createDataFrame([(2023, w + 1, float(cases[w]), float(weather[w]), 1.0) for w in range(30)],
                                  "year int, epi_week int, total double, temp double, flat double")
    table = explore.lagged_correlation(frame, ["temp", "flat"])
    got = {(r["variable"], r["lag"]): r["r"] for r in table.collect()}
    assert got[("flat", 0)] is None and got[("temp", 2)] == pytest.approx(1.0)
    assert got[("temp", 1)] == pytest.approx(np.corrcoef(cases[1:], weather[:-1])[0, 1])
    assert [(r["variable"], r["lag"]) for r in explore.best_lag(table).collect()] == [("temp", 2)]


def test_matrix_uses_complete_pairs(spark):
    data = [(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 5.0, 0.0), (None, 1.0, 2.0)]
    frame = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["first"], r["second"]): r["r"] for r in explore.correlation_matrix(frame, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert got[("a", "c")] == pytest.approx(-1.0)


def test_trend(spark):
    frame = spark.createDataFrame([(float(x), 3.0 * x + 1, 5.0) for x in range(5)], "x double, total double, flat double")
    got = {r["variable"]: r for r in explore.linear_trend(frame, ["x", "flat"]).collect()}
    assert (got["x"]["slope"], got["x"]["intercept"]) == (pytest.approx(3), pytest.approx(1))
    assert got["flat"]["slope"] is None


def test_rank_correlation_matches_pandas(spark):
    rng = np.random.default_rng(9)
    y = np.where(rng.random(300) < 0.6, 0, rng.integers(1, 50, 300))
    x = np.round(rng.normal(size=300) + y / 30, 1)
    frame = spark.createDataFrame([(int(i % 3), 2023, int(i), int(y[i]), float(x[i])) for i in range(300)], PANEL + ", temp double")
    got = {r["group"]: r for r in explore.rank_correlation(frame, ["temp"], 1).collect()}
    import pandas as pd
    table = pd.DataFrame({"x": x, "y": y, "e": np.arange(300) % 3})
    for group, part in {"all": table, "focus": table[table.e == 1], "rest": table[table.e != 1]}.items():
        assert got[group]["pearson"] == pytest.approx(part.x.corr(part.y))
        assert got[group]["spearman"] == pytest.approx(part.x.rank().corr(part.y.rank()))
    marked = explore.with_significance(explore.rank_correlation(frame, ["temp"], 1)).where("group = 'all'").first()
    assert marked["spearman_mark"] == "***"


@pytest.mark.parametrize("r, n, p", [
    (0.5, 10, 0.141113281), (0.9, 5, 0.0373860735), (0.0, 20, 1.0), (1.0, 9, 0.0), (0.1, 2340, 1.25391e-06),
])
def test_p_values(spark, r, n, p):
    got = spark.createDataFrame([(r, n)], "r double, n int").select(correlation_p_value(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=1e-5)


def test_large_sample_p_value_tends_to_the_normal_tail(spark):
    r, n = 0.01, 100_000_000
    got = spark.createDataFrame([(r / 50, n)], "r double, n int").select(correlation_p_value(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert got == pytest.approx(math.erfc(r / 50 * math.sqrt((n - 2) / 2)), rel=1e-5)


def test_p_value_has_no_step(spark):
    pairs = [(0.1, n) for n in range(49_990, 50_011)] + [(0.15, n) for n in range(49_990, 50_011)]
    got = [r["p"] for r in spark.createDataFrame(pairs, "r double, n int").coalesce(1).select(
        F.log10(correlation_p_value(F.col("r"), F.col("n"))).alias("p")).collect()]
    for part in (got[:21], got[21:]):
        steps = [a - b for a, b in zip(part, part[1:])]
        assert max(steps) == pytest.approx(min(steps), rel=1e-3) and min(steps) > 0

