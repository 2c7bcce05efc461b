"""Totals, seasonality, shares, quality reports, correlations and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import explore, panel as panels
from weekloom.session import settled
from workloads.base import (
    FOCUS, entities, master, neat, neat_wrap, panel, sql, supplier_panel, table, weather,
)

_MEASURES = ["temp_mean", "precipitation", "humidity_mean"]
_MATRIX = ["cases", "temp_mean", "temp_max_mean", "temp_min_mean", "precipitation", "humidity_mean",
           "heat_index_mean", "temp_mean_anomaly", "precipitation_anomaly"]


def week_totals(spark, sf):
    return neat(panels.week_totals(master(spark, sf), constant=_MEASURES))


def entity_totals(spark, sf):
    return explore.entity_totals(panel(spark, sf))


def entity_year_totals(spark, sf):
    return explore.entity_totals(supplier_panel(spark, sf), by=["year"])


def week_by_entity(spark, sf):
    return explore.week_by_entity(panel(spark, sf), list(range(25)))


def week_cells(spark, sf):
    return explore.week_cells(supplier_panel(spark, sf))


def season_profile(spark, sf):
    return neat(explore.season_profile(panel(spark, sf)))


def season_peaks(spark, sf):
    grouped = explore.with_groups(panel(spark, sf), FOCUS)
    return neat(explore.season_peak(grouped, by=["group"]))


def relative_incidence(spark, sf):
    return neat(explore.relative_incidence(supplier_panel(spark, sf)))


def high_incidence(spark, sf):
    return neat(explore.relative_incidence(supplier_panel(spark, sf), at_least=1.1))


def focus_share(spark, sf):
    return neat(explore.focus_share(panel(spark, sf), FOCUS))


def focus_summary(spark, sf):
    return neat(explore.focus_summary(panel(spark, sf), FOCUS, above=8.0))


def zero_imbalance(spark, sf):
    return neat(explore.zero_imbalance(settled(supplier_panel(spark, sf)), FOCUS))


def panel_quality(spark, sf):
    return neat(explore.panel_quality(supplier_panel(spark, sf)))


def year_totals(spark, sf):
    return explore.year_totals(panel(spark, sf))


def missing_entities(spark, sf):
    """Orders without a line item: entities of a large domain that the rows never name."""
    named = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_id"))
    return explore.missing_entities(named, table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id")))


def weather_quality(spark, sf):
    return neat(explore.weather_quality(weather(spark, sf)))


def master_quality(spark, sf):
    return neat(explore.master_quality(master(spark, sf)))


def top_weeks(spark, sf):
    return explore.top_weeks(panel(spark, sf))


def top_rows(spark, sf):
    return explore.top_rows(supplier_panel(spark, sf))


def bucket_histogram(spark, sf):
    return neat(explore.bucket_histogram(supplier_panel(spark, sf)))


def _weeks(spark, sf):
    return panels.week_totals(master(spark, sf), constant=_MEASURES)


def lagged_correlation(spark, sf):
    return neat(explore.lagged_correlation(_weeks(spark, sf), _MEASURES))


def best_weather_lag(spark, sf):
    return neat(explore.best_lag(explore.lagged_correlation(_weeks(spark, sf), _MEASURES)))


def correlation_matrix(spark, sf):
    return neat(explore.correlation_matrix(master(spark, sf), _MATRIX))


def linear_trend(spark, sf):
    return neat(explore.linear_trend(_weeks(spark, sf), _MEASURES))


def rank_correlation(spark, sf):
    return neat(explore.rank_correlation(
        settled(master(spark, sf)), [*_MEASURES, "heat_index_mean", "temp_mean_anomaly", "precipitation_anomaly"], FOCUS))


def correlation_significance(spark, sf):
    return neat(explore.with_significance(
        explore.rank_correlation(settled(master(spark, sf)), _RANKED_MEASURES, FOCUS)))


QUERIES = {f.__name__: f for f in (
    week_totals, entity_totals, entity_year_totals, week_by_entity, week_cells, season_profile, season_peaks,
    relative_incidence, high_incidence, focus_share, focus_summary, zero_imbalance, panel_quality,
    year_totals, missing_entities, weather_quality, master_quality, top_weeks, top_rows,
    bucket_histogram, lagged_correlation, best_weather_lag, correlation_matrix, linear_trend,
    rank_correlation, correlation_significance,
)}

_RELATIVE = """
    SELECT entity_id, year, total, total / avg(total) OVER (PARTITION BY year) AS relative
    FROM (SELECT entity_id, year, sum(cases)::BIGINT AS total FROM supplier_panel GROUP BY ALL)"""
_SHARE = f"""
    SELECT *, CASE WHEN total <> 0 THEN focus_total * 100.0 / total END AS pct FROM (
      SELECT year, epi_week, sum(CASE WHEN entity_id = {FOCUS} THEN cases ELSE 0 END)::BIGINT AS focus_total,
        sum(cases)::BIGINT AS total FROM panel GROUP BY ALL)"""
_GROUPED = """
    SELECT *, 'all' AS "group" FROM {0} UNION ALL
    SELECT *, CASE WHEN entity_id = %d THEN 'focus' ELSE 'rest' END FROM {0}""" % FOCUS
_PROFILE = """
    SELECT {0} epi_week, avg(total) AS mean_total FROM (
      SELECT {0} year, epi_week, sum(cases)::BIGINT AS total FROM {1} GROUP BY ALL) GROUP BY ALL"""
_BUCKET = """CASE WHEN cases > 500 THEN '> 500' WHEN cases > 200 THEN '201-500'
      WHEN cases > 50 THEN '51-200' WHEN cases > 0 THEN '1-50' WHEN cases = 0 THEN '= 0' END"""
_WEEKS = """
    SELECT year, epi_week, sum(cases) AS total, min(temp_mean) AS temp_mean,
      min(precipitation) AS precipitation, min(humidity_mean) AS humidity_mean FROM master GROUP BY year, epi_week"""


def _corr(x: str, y: str) -> str:
    """corr with null, not an error or NaN, for a constant side."""
    px, py = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (f"CASE WHEN min({px}) < max({px}) AND min({py}) < max({py}) THEN "
            f"corr({y}, {x}) END")


_LAGGED = " UNION ALL ".join(
    f"SELECT '{m}' AS variable, {k}::INT AS lag, {_corr('total', f'{m}_{k}')} AS r FROM shifted"
    for m in _MEASURES for k in range(5))
_SHIFTED = "SELECT total, " + ", ".join(
    f"lag({m}, {k}) OVER (ORDER BY year, epi_week) AS {m}_{k}" for m in _MEASURES for k in range(5)) + " FROM weeks"
_RANKED_MEASURES = [*_MEASURES, "heat_index_mean", "temp_mean_anomaly", "precipitation_anomaly"]

_RANKED = """
    SELECT *, abs(spearman) - abs(pearson) AS difference FROM (
    SELECT "group", variable, count(*)::BIGINT AS n,
      CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson,
      CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM (
      SELECT *, rank() OVER (PARTITION BY "group", variable ORDER BY x) + (count(*) OVER (PARTITION BY "group", variable, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY "group", variable ORDER BY y) + (count(*) OVER (PARTITION BY "group", variable, y) - 1) / 2.0 AS ry
      FROM long) GROUP BY ALL)"""
_RANKED_INPUT = {"grouped": _GROUPED.format("master"), "long": " UNION ALL ".join(
    f"SELECT \"group\", '{m}' AS variable, {m} AS x, cases AS y FROM grouped WHERE {m} IS NOT NULL AND cases IS NOT NULL"
    for m in _RANKED_MEASURES)}


def _tail(r: str, steps: int = 200_000) -> str:
    """Two-sided p of a coefficient by numeric integration: with r the sine of an angle, the
    density of r is a power of the angle's cosine."""
    def area(low: str) -> str:
        # Twelve deviations of the angle hold all that counts.
        width = f"least(pi() / 2 - {low}, 12 / sqrt(n - 2.0))"
        return (f"(SELECT sum(pow(cos({low} + {width} * (i + 0.5) / {steps}), n - 3)) "
                f"FROM range({steps}) t(i)) * {width}")
    return f"CASE WHEN {r} IS NOT NULL AND n >= 3 THEN {area(f'asin(least(abs({r}), 1.0))')} / ({area('0.0')}) END"


def _mark(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} IS NOT NULL THEN 'ns' END"


ORACLES = {
    "week_totals": sql(neat_wrap("SELECT * FROM weeks", ["total", *_MEASURES]), "master", extra={"weeks": _WEEKS}),
    "entity_totals": sql("SELECT entity_id, sum(cases)::BIGINT AS total FROM panel GROUP BY 1", "panel"),
    "entity_year_totals": sql(
        "SELECT entity_id, year, sum(cases)::BIGINT AS total FROM supplier_panel GROUP BY ALL", "supplier_panel"),
    "week_by_entity": sql("SELECT year, epi_week, " + ", ".join(
        f"sum(CASE WHEN entity_id = {e} THEN cases ELSE 0 END)::BIGINT AS entity_{e}" for e in range(25))
        + " FROM panel GROUP BY 1, 2", "panel"),
    "week_cells": sql("""
    SELECT year, epi_week, entity_id, sum(cases)::BIGINT AS total FROM supplier_panel GROUP BY ALL HAVING sum(cases) <> 0""", "supplier_panel"),
    "season_profile": sql(neat_wrap(
        f"SELECT *, CASE WHEN epi_week <= 17 OR epi_week >= 48 THEN 1 ELSE 0 END AS in_season FROM ({_PROFILE.format('', 'panel')})",
        ["mean_total"]), "panel"),
    "season_peaks": sql(neat_wrap(f"""
    SELECT "group", epi_week AS peak_week, mean_total AS peak_mean FROM ({_PROFILE.format('"group",', 'grouped')})
    QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY mean_total DESC, epi_week) = 1""", ["peak_mean"]),
                         "panel", extra={"grouped": _GROUPED.format("panel")}),
    "relative_incidence": sql(neat_wrap(_RELATIVE, ["relative"]), "supplier_panel"),
    "high_incidence": sql(neat_wrap(f"SELECT * FROM ({_RELATIVE}) WHERE relative > 1.1", ["relative"]), "supplier_panel"),
    "focus_share": sql(neat_wrap(_SHARE, ["pct"]), "panel"),
    "focus_summary": sql(neat_wrap(f"""
    SELECT count(*) FILTER (WHERE pct > 8)::BIGINT AS weeks_above, count(*) FILTER (WHERE total > 0)::BIGINT AS active_weeks,
      count(*)::BIGINT AS weeks, max(pct) AS max_pct, avg(pct) AS mean_pct,
      count(*) FILTER (WHERE pct > 8) * 100.0 / count(*) FILTER (WHERE total > 0) AS pct_of_active
    FROM ({_SHARE})""", ["max_pct", "mean_pct", "pct_of_active"]), "panel"),
    "zero_imbalance": sql(neat_wrap("""
    SELECT "group", count(*)::BIGINT AS n, count(*) FILTER (WHERE cases = 0) * 100.0 / count(*) AS pct_zero,
      quantile_cont(cases, 0.5) FILTER (WHERE cases > 0) AS median_nonzero FROM grouped GROUP BY 1""",
                                    ["pct_zero", "median_nonzero"]),
                          "supplier_panel", extra={"grouped": _GROUPED.format("supplier_panel")}),
    "panel_quality": sql(neat_wrap("""
    SELECT count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS n_entities,
      count(DISTINCT year)::BIGINT AS n_years, count(DISTINCT epi_week)::BIGINT AS n_weeks,
      count(*) FILTER (WHERE cases > 0)::BIGINT AS n_nonzero,
      count(*) FILTER (WHERE cases > 0) * 100.0 / count(*) AS pct_nonzero,
      sum(cases)::BIGINT AS total, avg(cases) AS mean, max(cases) AS max FROM supplier_panel""",
                                   ["pct_nonzero", "mean"]), "supplier_panel"),
    "year_totals": sql("""
    SELECT year, count(*)::BIGINT AS n_rows, sum(cases)::BIGINT AS total,
      count(*) FILTER (WHERE cases > 0)::BIGINT AS n_nonzero FROM panel GROUP BY 1""", "panel"),
    "missing_entities": """
    SELECT o_orderkey AS entity_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "weather_quality": sql(neat_wrap("""
    SELECT count(*)::BIGINT AS n_weeks, count(DISTINCT year)::BIGINT AS n_years, avg(temp_mean) AS temp_mean,
      max(temp_max_mean) AS temp_max, min(temp_min_mean) AS temp_min, avg(precipitation) AS rain_mean,
      max(precipitation) AS rain_max, avg(humidity_mean) AS humidity_mean, max(heat_index_mean) AS heat_index_max,
      count(*) FILTER (WHERE temp_mean IS NULL)::BIGINT AS n_null_temp,
      count(*) FILTER (WHERE precipitation IS NULL)::BIGINT AS n_null_rain FROM weather""",
        ["temp_mean", "temp_max", "temp_min", "rain_mean", "rain_max", "humidity_mean", "heat_index_max"]), "weather"),
    "master_quality": sql(neat_wrap("""
    SELECT count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS n_entities,
      count(DISTINCT year)::BIGINT AS n_years, count(DISTINCT epi_week)::BIGINT AS n_weeks,
      (count(*) - count(DISTINCT (entity_id, year, epi_week)))::BIGINT AS n_duplicates,
      sum(cases) AS total, avg(cases) AS mean, max(cases) AS max,
      count(*) FILTER (WHERE cases > 0)::BIGINT AS n_nonzero,
      avg(temp_mean) AS mean_temp_mean, avg(precipitation) AS mean_precipitation, avg(humidity_mean) AS mean_humidity_mean,
      count(*) FILTER (WHERE temp_mean IS NULL)::BIGINT AS n_null_temp_mean,
      count(*) FILTER (WHERE precipitation IS NULL)::BIGINT AS n_null_precipitation,
      count(*) FILTER (WHERE humidity_mean IS NULL)::BIGINT AS n_null_humidity_mean FROM master""",
        ["total", "mean", "max", "mean_temp_mean", "mean_precipitation", "mean_humidity_mean"]), "master"),
    "top_weeks": sql("""
    SELECT year, epi_week, sum(cases)::BIGINT AS total FROM panel GROUP BY ALL
    ORDER BY total DESC, year, epi_week LIMIT 5""", "panel"),
    "top_rows": sql("""
    SELECT * FROM supplier_panel ORDER BY cases DESC, year, epi_week, entity_id LIMIT 10""", "supplier_panel"),
    "bucket_histogram": sql(neat_wrap(f"""
    SELECT bucket, n, n * 100.0 / sum(n) OVER () AS pct FROM (
      SELECT {_BUCKET} AS bucket, count(*)::BIGINT AS n FROM supplier_panel GROUP BY 1)""", ["pct"]), "supplier_panel"),
    "lagged_correlation": sql(neat_wrap(_LAGGED, ["r"]), "master", extra={"weeks": _WEEKS, "shifted": _SHIFTED}),
    "best_weather_lag": sql(neat_wrap(f"""
    SELECT variable, lag, r FROM ({_LAGGED}) WHERE r IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY variable ORDER BY abs(r) DESC, lag) = 1""", ["r"]),
                             "master", extra={"weeks": _WEEKS, "shifted": _SHIFTED}),
    "correlation_matrix": sql(neat_wrap(" UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {_corr(a, b)} AS r FROM master"
        for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1:]), ["r"]), "master"),
    "linear_trend": sql(neat_wrap(" UNION ALL ".join(
        f"SELECT '{m}' AS variable, regr_slope(total, {m}) AS slope, regr_intercept(total, {m}) AS intercept, "
        f"{_corr('total', m)} AS r FROM weeks" for m in _MEASURES), ["slope", "intercept", "r"]),
                        "master", extra={"weeks": _WEEKS}),
    "rank_correlation": sql(neat_wrap(_RANKED, ["pearson", "spearman", "difference"]), "master", extra=_RANKED_INPUT),
    "correlation_significance": sql(neat_wrap(f"""
    SELECT *, {_mark('pearson_p')} AS pearson_mark, {_mark('spearman_p')} AS spearman_mark FROM (
      SELECT *, {_tail('pearson')} AS pearson_p, {_tail('spearman')} AS spearman_p FROM ({_RANKED}))""",
        ["pearson", "spearman", "difference", "pearson_p", "spearman_p"]), "master", extra=_RANKED_INPUT),
}
