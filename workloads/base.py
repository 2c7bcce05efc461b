"""Inputs shared by the registered queries, and their SQL as named common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year
from weekloom.operators.panel import densify, weekly_sum
from weekloom.plans.features import base_features, feature_table
from weekloom.plans.ingest import master_table, weather_weeks
from weekloom.session import settled

FOCUS = 7
TRAIN_UNTIL = (1999, 52)
VALIDATION_UNTIL = (2000, 26)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def neat(frame: DataFrame) -> DataFrame:
    """Doubles to six decimals without a negative zero, so that engines can be compared."""
    def column(name: str, kind: str):
        if kind != "double":
            return F.col(name)
        return F.when(F.abs(F.col(name)) < 5e-7, F.lit(0.0)).otherwise(F.round(name, 6)).alias(name)

    return frame.select(*[column(n, k) for n, k in frame.dtypes])


def orders_by_week(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each order with its week."""
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_custkey", iso_year(date).alias("year"), iso_week(date).alias("epi_week"), F.lit(1).cast("long").alias("cases"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by nation and week. The orders move once, to their customers; a busy customer is
    split by adaptive execution, and what is left is summed before it moves again."""
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity_id"))
    return weekly_sum(orders_by_week(spark, sf).join(customers, "o_custkey"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity_id"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return densify(counts(spark, sf), entities=entities(spark, sf))


def supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Units shipped per supplier and week, dense."""
    date = F.col("l_shipdate").cast("date")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), iso_year(date).alias("year"),
        iso_week(date).alias("epi_week"), F.col("l_quantity").cast("bigint").alias("cases"))
    return densify(weekly_sum(rows))


def population(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("population"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations next to each other by key, or next within their region (every fifth key)."""
    domain = entities(spark, sf)
    key = F.col("entity_id")
    near = domain.select(
        key.alias("src"), F.explode(F.array(key - 1, key + 1, key - 5, key + 5)).alias("dst"))
    return near.join(domain.select(key.alias("dst")), "dst", "left_semi").select("src", "dst")


def daily_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Six daily measures from whole numbers of the line items, some out of range."""
    units = F.sum(F.col("l_quantity").cast("bigint"))
    n = F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        (n % 50).cast("double").alias("temp_max"),
        (F.count_if(F.col("l_returnflag") == "A") % 50 - 6).cast("double").alias("temp_min"),
        (units / n).alias("temp_mean"),
        (units % 520).cast("double").alias("precipitation"),
        (F.sum("l_linenumber") % 105).cast("double").alias("humidity_max"),
        (units % 101).cast("double").alias("humidity_min"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    return weather_weeks(daily_weather(spark, sf))


def master(spark: SparkSession, sf: str) -> DataFrame:
    return master_table(panel(spark, sf), weather(spark, sf))


def base_table(spark: SparkSession, sf: str) -> DataFrame:
    # Features read the master several times (own series, neighbours, weeks of weather).
    return base_features(
        settled(master(spark, sf)), population(spark, sf), edges(spark, sf), focus=FOCUS)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table(settled(base_table(spark, sf)), TRAIN_UNTIL, VALIDATION_UNTIL)


WEATHER_COLUMNS = [
    "temp_max_mean", "temp_min_mean", "temp_mean", "precipitation", "humidity_mean",
    "heat_index_mean", "temp_mean_anomaly", "precipitation_anomaly", "humidity_mean_anomaly",
]
# The master table repairs these by interpolation; anomalies are left as joined.
REPAIRED = WEATHER_COLUMNS[:6]


def _repaired(name: str) -> str:
    known = f"CASE WHEN {name} IS NOT NULL THEN no END"
    return f"""
      last_value({name} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {name}_b,
      last_value({known} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {name}_bn,
      first_value({name} IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {name}_a,
      first_value({known} IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {name}_an"""


def interpolated_sql(source: str, columns: list[str], kept: str) -> str:
    """Linear interpolation by row position within an entity, in SQL."""
    looks = ",".join(_repaired(c) for c in columns)
    filled = ", ".join(
        f"coalesce({c}, CASE WHEN {c}_b IS NOT NULL AND {c}_a IS NOT NULL "
        f"THEN {c}_b + ({c}_a - {c}_b) / ({c}_an - {c}_bn) * (no - {c}_bn) "
        f"ELSE coalesce({c}_b, {c}_a) END) AS {c}" for c in columns)
    return f"""
    SELECT {kept}, {filled} FROM (
      SELECT *, {looks} FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY year, epi_week) AS no FROM {source})
      WINDOW w AS (PARTITION BY entity_id ORDER BY year, epi_week))"""


_HEAT = """-8.78469475556 + 1.61139411*t + 2.33854883889*h + -0.14611605*t*h + -0.012308094*(t*t)
  + -0.0164248277778*(h*h) + 0.002211732*(t*t)*h + 0.00072546*t*(h*h) + -0.000003582*(t*t)*(h*h)"""

_LAGS = range(1, 5)
_LAGGED_WEATHER = ["temp_mean", "precipitation", "humidity_mean", "heat_index_mean",
                   "temp_mean_anomaly", "precipitation_anomaly", "humidity_mean_anomaly"]


def dense_sql(source: str, calendar: str, domain: str) -> str:
    return f"""
    SELECT d.entity_id, k.year, k.epi_week, coalesce(c.cases, 0)::BIGINT AS cases
    FROM {domain} d CROSS JOIN {calendar} k LEFT JOIN {source} c
      ON c.entity_id = d.entity_id AND c.year = k.year AND c.epi_week = k.epi_week"""


def calendar_sql(source: str) -> str:
    return f"""
    SELECT isoyear(d)::INT AS year, week(d)::INT AS epi_week FROM (
      SELECT unnest(generate_series(
        date_trunc('week', make_date(lo, 1, 4))::TIMESTAMP,
        date_trunc('week', make_date(hi + 1, 1, 4))::TIMESTAMP - INTERVAL 7 DAY,
        INTERVAL 7 DAY)) AS d
      FROM (SELECT min(year) AS lo, max(year) AS hi FROM {source}))
    WHERE isoyear(d) IN (SELECT year FROM {source})"""


# Name -> (names it needs, SQL).
CTES: dict[str, tuple[list[str], str]] = {
    "counts": ([], """
    SELECT c_nationkey AS entity_id, isoyear(o_orderdate)::INT AS year,
      week(o_orderdate)::INT AS epi_week, count(*)::BIGINT AS cases
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""),
    "domain": ([], "SELECT n_nationkey AS entity_id FROM nation"),
    "calendar": (["counts"], calendar_sql("counts")),
    "panel": (["counts", "calendar", "domain"], dense_sql("counts", "calendar", "domain")),
    "supplier_counts": ([], """
    SELECT l_suppkey AS entity_id, isoyear(l_shipdate)::INT AS year, week(l_shipdate)::INT AS epi_week,
      sum(l_quantity)::BIGINT AS cases FROM lineitem GROUP BY ALL"""),
    "supplier_domain": ([], "SELECT DISTINCT l_suppkey AS entity_id FROM lineitem"),
    "supplier_calendar": (["supplier_counts"], calendar_sql("supplier_counts")),
    "supplier_panel": (["supplier_counts", "supplier_calendar", "supplier_domain"],
                       dense_sql("supplier_counts", "supplier_calendar", "supplier_domain")),
    "pop": ([], "SELECT c_nationkey AS entity_id, count(*)::BIGINT AS population FROM customer GROUP BY ALL"),
    "edges": ([], """
    SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b
      ON abs(a.n_nationkey - b.n_nationkey) IN (1, 5)"""),
    "daily": ([], """
    SELECT l_shipdate::DATE AS date, (count(*) % 50)::DOUBLE AS temp_max,
      (count(*) FILTER (WHERE l_returnflag = 'A') % 50 - 6)::DOUBLE AS temp_min,
      sum(l_quantity::BIGINT)::BIGINT / count(*) AS temp_mean,
      (sum(l_quantity::BIGINT)::BIGINT % 520)::DOUBLE AS precipitation,
      (sum(l_linenumber)::BIGINT % 105)::DOUBLE AS humidity_max,
      (sum(l_quantity::BIGINT)::BIGINT % 101)::DOUBLE AS humidity_min
    FROM lineitem GROUP BY ALL"""),
    "checked": (["daily"], """
    SELECT date,
      CASE WHEN temp_max BETWEEN -5 AND 45 THEN temp_max END AS temp_max,
      CASE WHEN temp_min BETWEEN -5 AND 45 THEN temp_min END AS temp_min,
      CASE WHEN temp_mean BETWEEN -5 AND 45 THEN temp_mean END AS temp_mean,
      CASE WHEN precipitation BETWEEN 0 AND 500 THEN precipitation END AS precipitation,
      CASE WHEN humidity_max BETWEEN 0 AND 100 THEN humidity_max END AS humidity_max,
      CASE WHEN humidity_min BETWEEN 0 AND 100 THEN humidity_min END AS humidity_min
    FROM daily"""),
    "derived": (["checked"], f"""
    SELECT *, CASE WHEN t >= 27 AND h >= 40 THEN {_HEAT} ELSE t END AS heat_index FROM (
      SELECT *, temp_mean AS t, (humidity_max + humidity_min) / 2 AS h,
        (humidity_max + humidity_min) / 2 AS humidity_mean,
        isoyear(date)::INT AS year, week(date)::INT AS epi_week FROM checked)"""),
    "weekly": (["derived"], """
    SELECT year, epi_week, avg(temp_max) AS temp_max_mean, avg(temp_min) AS temp_min_mean,
      avg(temp_mean) AS temp_mean, coalesce(sum(precipitation), 0.0) AS precipitation,
      avg(humidity_mean) AS humidity_mean, avg(heat_index) AS heat_index_mean,
      count(date)::BIGINT AS n_days, min(date) AS start_date
    FROM derived GROUP BY year, epi_week"""),
    "weather": (["weekly"], """
    SELECT *, temp_mean - avg(temp_mean) OVER (PARTITION BY epi_week) AS temp_mean_anomaly,
      precipitation - avg(precipitation) OVER (PARTITION BY epi_week) AS precipitation_anomaly,
      humidity_mean - avg(humidity_mean) OVER (PARTITION BY epi_week) AS humidity_mean_anomaly
    FROM weekly"""),
    "joined": (["panel", "weather"], f"""
    SELECT p.*, {', '.join(f'w.{c}' for c in WEATHER_COLUMNS)}
    FROM panel p LEFT JOIN weather w ON p.year = w.year AND p.epi_week = w.epi_week"""),
    "in_range": (["joined"], """
    SELECT * REPLACE (
      CASE WHEN cases >= 0 THEN cases::DOUBLE END AS cases,
      CASE WHEN temp_max_mean BETWEEN -5 AND 45 THEN temp_max_mean END AS temp_max_mean,
      CASE WHEN temp_min_mean BETWEEN -5 AND 45 THEN temp_min_mean END AS temp_min_mean,
      CASE WHEN temp_mean BETWEEN -5 AND 45 THEN temp_mean END AS temp_mean,
      CASE WHEN precipitation >= 0 THEN precipitation END AS precipitation,
      CASE WHEN humidity_mean BETWEEN 0 AND 100 THEN humidity_mean END AS humidity_mean,
      CASE WHEN heat_index_mean BETWEEN -5 AND 60 THEN heat_index_mean END AS heat_index_mean)
    FROM joined"""),
    "repaired": (["in_range"], interpolated_sql(
        "in_range", ["cases", *REPAIRED],
        "year, epi_week, entity_id, " + ", ".join(WEATHER_COLUMNS[6:]))),
    "master": (["repaired"], f"""
    SELECT year, epi_week, entity_id, round_even(cases, 3) AS cases,
      {', '.join(f'round_even({c}, 3) AS {c}' for c in WEATHER_COLUMNS)} FROM repaired"""),
    "rated": (["master", "pop"], """
    SELECT m.*, population, round_even(cases / (population / 10000), 4) AS incidence
    FROM master m LEFT JOIN pop USING (entity_id)"""),
    "moved": (["rated"], f"""
    SELECT *, {', '.join(f'lag({c}, {k}) OVER w AS {c}_lag{k}' for c in ('cases', 'incidence') for k in _LAGS)},
      {', '.join(f'lead(cases, {h}) OVER w AS target_h{h}' for h in _LAGS)}
    FROM rated WINDOW w AS (PARTITION BY entity_id ORDER BY year, epi_week)"""),
    "neighbours": (["moved", "edges"], """
    SELECT src AS entity_id, year, epi_week, avg(cases) AS nc, avg(incidence) AS ni
    FROM edges JOIN moved ON dst = entity_id GROUP BY ALL"""),
    "near": (["moved", "neighbours"], """
    SELECT m.*, lag(nc, 1) OVER w AS neighbour_cases_lag1, lag(ni, 1) OVER w AS neighbour_incidence_lag1
    FROM moved m LEFT JOIN neighbours n
      ON m.entity_id = n.entity_id AND m.year = n.year AND m.epi_week = n.epi_week
    WINDOW w AS (PARTITION BY m.entity_id ORDER BY m.year, m.epi_week)"""),
    "weather_lags": (["moved"], f"""
    SELECT year, epi_week,
      {', '.join(f'lag({c}, {k}) OVER (ORDER BY year, epi_week) AS {c}_lag{k}' for c in _LAGGED_WEATHER for k in _LAGS)}
    FROM (SELECT year, epi_week, {', '.join(f'min({c}) AS {c}' for c in _LAGGED_WEATHER)}
      FROM moved GROUP BY ALL)"""),
    "base": (["near", "weather_lags"], f"""
    SELECT n.*, {', '.join(f'l.{c}_lag{k}' for c in _LAGGED_WEATHER for k in _LAGS)},
      sin(2.0 * pi() * n.epi_week / 52) AS week_sin, cos(2.0 * pi() * n.epi_week / 52) AS week_cos,
      CASE WHEN n.epi_week <= 17 OR n.epi_week >= 48 THEN 1 ELSE 0 END AS in_season,
      least(greatest((n.epi_week - 1) // 4 + 1, 1), 12)::INT AS month,
      CASE WHEN n.entity_id = {FOCUS} THEN 1 ELSE 0 END AS is_focus
    FROM near n JOIN weather_lags l ON n.year = l.year AND n.epi_week = l.epi_week"""),
    "split": (["base"], f"""
    SELECT *, CASE WHEN year < {TRAIN_UNTIL[0]} OR (year = {TRAIN_UNTIL[0]} AND epi_week <= {TRAIN_UNTIL[1]}) THEN 'train'
      WHEN year < {VALIDATION_UNTIL[0]} OR (year = {VALIDATION_UNTIL[0]} AND epi_week <= {VALIDATION_UNTIL[1]}) THEN 'validation'
      ELSE 'test' END AS split FROM base"""),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named expressions and all they need, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for other in needs:
            add(other)
        done[name] = text

    for name in names:
        add(name)
    done.update(extra or {})
    parts = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH {parts}\n{body}" if parts else body


def neat_sql(columns: list[str], doubles: list[str]) -> str:
    """Select list that rounds the named doubles as ``neat`` does."""
    return ", ".join(
        f"CASE WHEN abs({c}) < 5e-7 THEN 0.0::DOUBLE ELSE round({c}, 6) END AS {c}" if c in doubles else c
        for c in columns)


def neat_wrap(body: str, doubles: list[str]) -> str:
    """Round columns of a whole query."""
    items = ", ".join(
        f"CASE WHEN abs({c}) < 5e-7 THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, 6) END AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({items}) FROM ({body})"
