"""Cleaning, densifying, weather and master queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year, week_index, week_label, week_start
from weekloom.operators import cleaning, panel as panels, weather as weathers
from weekloom.plans import ingest
from weekloom.sources.cases import keep_region_event
from workloads.base import (
    WEATHER_COLUMNS, counts, daily_weather, entities, interpolated_sql, master, neat, neat_wrap,
    panel, sql, supplier_panel, table, weather,
)


def _raw_cases(spark, sf):
    """Orders as untidy text: padded names, odd events, bad weeks, null and negative counts."""
    date = F.col("o_orderdate").cast("date")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    rows = table(spark, sf, "orders").join(customer, "o_custkey").join(nation, "c_nationkey")
    key = F.col("o_orderkey")
    return rows.select(
        F.col("n_regionkey").cast("string").alias("region"),
        F.when(key % 3 == 0, "Dengue").when(key % 3 == 1, "DENGUE").otherwise("other").alias("event"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, "999").otherwise("1").alias("district"),
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("label"),
        F.when(key % 17 == 0, "n/a").otherwise(iso_year(date).cast("string")).alias("year"),
        iso_week(date).cast("string").alias("epi_week"),
        F.when(key % 19 == 0, F.lit(None)).otherwise((key % 7 - 1).cast("string")).alias("cases"),
    )


_RAW = """
    SELECT n_regionkey::VARCHAR AS region,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Dengue' WHEN o_orderkey % 3 = 1 THEN 'DENGUE' ELSE 'other' END AS event,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '999' ELSE '1' END AS district,
      ' ' || lower(n_name) || ' ' AS label,
      CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE isoyear(o_orderdate)::VARCHAR END AS year,
      week(o_orderdate)::VARCHAR AS epi_week,
      CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey % 7 - 1)::VARCHAR END AS cases
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _mapping(spark, sf):
    """Labels of the nations that have a code; the last ones are left out."""
    return table(spark, sf, "nation").where("n_nationkey < 23").select(
        F.upper("n_name").alias("label"), F.col("n_nationkey").alias("entity_id"))


def cleaned_cases(spark, sf):
    kept = keep_region_event(_raw_cases(spark, sf), 2, "dengue", "region", "event", "district")
    coded = cleaning.map_labels(kept, _mapping(spark, sf))
    rows = cleaning.clean_counts(cleaning.clean_weeks(coded, years=(1994, 2001)))
    return panels.weekly_sum(rows)


def unmapped_labels(spark, sf):
    return cleaning.unmapped_labels(_raw_cases(spark, sf), _mapping(spark, sf))


def weather_in_range(spark, sf):
    return neat(cleaning.limit_ranges(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS))


def out_of_range_counts(spark, sf):
    return cleaning.out_of_range_counts(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS)


def supplier_date_gaps(spark, sf):
    days = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"))
    return cleaning.date_gaps(days, by=["l_suppkey"])


def _order_rows(spark, sf):
    date = F.col("o_orderdate").cast("date")
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity_id"))
    return table(spark, sf, "orders").join(customer, "o_custkey").select(
        "entity_id", iso_year(date).alias("year"), iso_week(date).alias("epi_week"),
        date.alias("date"), "o_orderkey", "o_totalprice")


def duplicate_keys(spark, sf):
    return cleaning.duplicate_report(_order_rows(spark, sf))


def first_of_week(spark, sf):
    return cleaning.first_per_key(_order_rows(spark, sf), ["date", "o_orderkey"])


def missing_report(spark, sf):
    checked = cleaning.limit_ranges(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS)
    return neat(cleaning.missing_report(checked))


def interpolated_cases(spark, sf):
    holes = supplier_panel(spark, sf).withColumn(
        "cases", F.when(F.col("cases") > 0, F.col("cases").cast("double")))
    return neat(cleaning.interpolate(holes, ["cases"]))


def interpolated_whole(spark, sf):
    """The same holes, filled along the order of weeks and entities over the whole table."""
    holes = supplier_panel(spark, sf).withColumn(
        "cases", F.when(F.col("cases") > 0, F.col("cases").cast("double")))
    return neat(cleaning.interpolate(holes, ["cases"], by=[]))


def iqr_outliers(spark, sf):
    rows = table(spark, sf, "lineitem")
    return neat(cleaning.iqr_outliers(rows, ["l_quantity", "l_extendedprice", "l_discount"]))


def master_columns(spark, sf):
    return neat(master(spark, sf))


def replaced_counts(spark, sf):
    return ingest.replaced_counts(panel(spark, sf), weather(spark, sf))


def _holes(spark, sf):
    """Counts by week of which some lack the week."""
    hole = F.pmod(F.col("entity_id") * 7 + F.col("epi_week"), F.lit(9)) == 0
    return counts(spark, sf).withColumn("epi_week", F.when(~hole, F.col("epi_week")))


def densify_totals(spark, sf):
    """What the dense panel holds and what belongs to no week, by entity."""
    dense = panels.densify(_holes(spark, sf), entities=entities(spark, sf)).groupBy("entity_id").agg(
        F.count("*").alias("n_weeks"), F.sum("cases").alias("cases"))
    lost = panels.rows_without_week(_holes(spark, sf)).select("entity_id", "n_rows", F.col("cases").alias("lost"))
    return dense.join(lost, "entity_id", "left").select(
        "entity_id", "n_weeks", "cases", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("lost", F.lit(0)).alias("lost"))


def high_counts_master(spark, sf):
    """Counts in the thousands, by entity, as the master table holds them."""
    high = panel(spark, sf).withColumn("cases", F.col("cases") * 6000)
    return ingest.master_table(high, weather(spark, sf)).groupBy("entity_id").agg(
        F.sum("cases").alias("total"), F.max("cases").alias("most"), F.count("cases").alias("n"))


def dropped_weeks(spark, sf):
    return cleaning.dropped_weeks(_raw_cases(spark, sf), years=(1996, 2000))


def source_summary(spark, sf):
    return panels.source_summary(_sources(spark, sf))


def _sources(spark, sf):
    """Orders by status as three sources of one panel."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity_id"))
    date = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").join(customer, "o_custkey").select(
        "entity_id", iso_year(date).alias("year"), iso_week(date).alias("epi_week"),
        F.lit(1).cast("bigint").alias("cases"), F.col("o_orderstatus").alias("source"))
    return panels.combine_sources([rows.where(F.col("source") == s) for s in ("F", "O", "P")])


def overlapping_sources(spark, sf):
    by_source = panels.weekly_sum(_sources(spark, sf), by=["source"])
    return panels.resolve_overlap(by_source, ["P", "F", "O"])


def weekly_counts(spark, sf):
    return counts(spark, sf)


def dense_panel(spark, sf):
    return panel(spark, sf)


def dense_supplier_panel(spark, sf):
    return supplier_panel(spark, sf)


def dense_panel_52(spark, sf):
    return panels.densify(counts(spark, sf), entities=entities(spark, sf), weeks_per_year=52)


def iso_weeks(spark, sf):
    date = F.col("o_orderdate").cast("date")
    days = table(spark, sf, "orders").select(date.alias("date")).distinct()
    dated = days.select("date", iso_year("date").alias("year"), iso_week("date").alias("epi_week"))
    return dated.withColumns({
        "label": week_label("year", "epi_week"), "monday": week_start("year", "epi_week"),
        "week_index": week_index("year", "epi_week")})


def week_alignment(spark, sf):
    return panels.alignment_report(panel(spark, sf), weather(spark, sf))


def weeks_without_weather(spark, sf):
    return panels.weeks_missing_from(panel(spark, sf), weather(spark, sf))


def shared_weeks(spark, sf):
    return panels.shared_weeks(panel(spark, sf), weather(spark, sf))


def panel_with_weather(spark, sf):
    return neat(panels.join_weather(panel(spark, sf), weather(spark, sf)))


def weekly_weather(spark, sf):
    checked = cleaning.limit_ranges(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS)
    return neat(weathers.weekly_weather(weathers.derive_daily(checked)))


def daily_heat_index(spark, sf):
    checked = cleaning.limit_ranges(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS)
    return neat(weathers.derive_daily(checked).select("date", "year", "epi_week", "humidity_mean", "heat_index"))


def weather_anomalies(spark, sf):
    return neat(weather(spark, sf).select("year", "epi_week", *WEATHER_COLUMNS[6:]))


def past_anomalies(spark, sf):
    checked = cleaning.limit_ranges(daily_weather(spark, sf), cleaning.DAILY_WEATHER_BOUNDS)
    weeks = weathers.weekly_weather(weathers.derive_daily(checked))
    fitted = weathers.add_anomalies(weeks, ["temp_mean"], fit_until_year=1999)
    return neat(fitted.select("year", "epi_week", "temp_mean_anomaly"))


def trailing_weather(spark, sf):
    days = weathers.trailing_means(daily_weather(spark, sf), ["precipitation", "humidity_max"])
    return neat(days.select("date", *[c for c in days.columns if c.endswith("d")]))


QUERIES = {f.__name__: f for f in (
    cleaned_cases, unmapped_labels, weather_in_range, out_of_range_counts, supplier_date_gaps,
    duplicate_keys, first_of_week, missing_report, interpolated_cases, interpolated_whole, iqr_outliers, master_columns,
    replaced_counts, densify_totals, high_counts_master, dropped_weeks,
    source_summary, overlapping_sources, weekly_counts, dense_panel, dense_supplier_panel,
    dense_panel_52, iso_weeks, week_alignment, weeks_without_weather, shared_weeks,
    panel_with_weather, weekly_weather, daily_heat_index, weather_anomalies, past_anomalies,
    trailing_weather,
)}

_ORDER_ROWS = """
    SELECT c_nationkey AS entity_id, isoyear(o_orderdate)::INT AS year, week(o_orderdate)::INT AS epi_week,
      o_orderdate::DATE AS date, o_orderkey, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey"""
_WEATHER_DAYS = ["temp_max", "temp_min", "temp_mean", "precipitation", "humidity_max", "humidity_min"]

ORACLES = {
    "replaced_counts": sql("""
    SELECT unnest(['cases', 'temp_max_mean', 'temp_min_mean', 'temp_mean', 'precipitation', 'humidity_mean', 'heat_index_mean']) AS column,
      unnest([count(*) FILTER (WHERE cases < 0), count(*) FILTER (WHERE temp_max_mean NOT BETWEEN -5 AND 45),
        count(*) FILTER (WHERE temp_min_mean NOT BETWEEN -5 AND 45), count(*) FILTER (WHERE temp_mean NOT BETWEEN -5 AND 45),
        count(*) FILTER (WHERE precipitation < 0), count(*) FILTER (WHERE humidity_mean NOT BETWEEN 0 AND 100),
        count(*) FILTER (WHERE heat_index_mean NOT BETWEEN -5 AND 60)]) AS n_out_of_range FROM joined""", "joined"),
    "densify_totals": sql("""
    SELECT d.entity_id, (SELECT count(*) FROM calendar) AS n_weeks, coalesce(cases, 0) AS cases, coalesce(n_rows, 0) AS n_rows, coalesce(lost, 0) AS lost
    FROM domain d LEFT JOIN (
      SELECT entity_id, sum(cases) FILTER (WHERE (entity_id * 7 + epi_week) % 9 <> 0)::BIGINT AS cases,
        count(*) FILTER (WHERE (entity_id * 7 + epi_week) % 9 = 0) AS n_rows,
        sum(cases) FILTER (WHERE (entity_id * 7 + epi_week) % 9 = 0)::BIGINT AS lost FROM counts GROUP BY ALL) USING (entity_id)""",
        "domain", "calendar", "counts"),
    "high_counts_master": sql("""
    SELECT entity_id, sum(6000 * cases)::DOUBLE AS total, max(6000 * cases)::DOUBLE AS most, count(*) AS n FROM panel GROUP BY ALL""", "panel"),
    "dropped_weeks": sql("""
    SELECT reason, count(*) AS n_rows FROM (
      SELECT CASE WHEN try_cast(year AS INT) IS NULL THEN 'unreadable' WHEN try_cast(year AS INT) NOT BETWEEN 1996 AND 2000 THEN 'year' END AS reason
      FROM raw) WHERE reason IS NOT NULL GROUP BY ALL""", extra={"raw": _RAW}),
    "cleaned_cases": sql("""
    SELECT n_nationkey AS entity_id, year::INT AS year, epi_week::INT AS epi_week,
      sum(coalesce(cases::BIGINT, 0))::BIGINT AS cases
    FROM raw JOIN nation ON upper(trim(label)) = upper(n_name) AND n_nationkey < 23
    WHERE region = '2' AND upper(event) = 'DENGUE' AND district IS DISTINCT FROM '999'
      AND try_cast(year AS INT) BETWEEN 1994 AND 2001 AND (cases IS NULL OR cases::BIGINT >= 0)
    GROUP BY ALL""", extra={"raw": _RAW}),
    "unmapped_labels": sql("""
    SELECT upper(trim(label)) AS label, count(*)::BIGINT AS n_rows FROM raw
    WHERE upper(trim(label)) NOT IN (SELECT upper(n_name) FROM nation WHERE n_nationkey < 23)
    GROUP BY 1""", extra={"raw": _RAW}),
    "weather_in_range": sql(neat_wrap("SELECT * FROM checked", _WEATHER_DAYS), "checked"),
    "out_of_range_counts": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE NOT {c} BETWEEN {lo} AND {hi})::BIGINT AS n_out_of_range FROM daily"
        for c, (lo, hi) in cleaning.DAILY_WEATHER_BOUNDS.items()), "daily"),
    "supplier_date_gaps": """
    SELECT l_suppkey, count(*) FILTER (WHERE step > 1)::BIGINT AS n_gaps FROM (
      SELECT l_suppkey, date_diff('day', lag(d) OVER (PARTITION BY l_suppkey ORDER BY d), d) AS step
      FROM (SELECT DISTINCT l_suppkey, l_shipdate::DATE AS d FROM lineitem)) GROUP BY 1""",
    "duplicate_keys": sql("""
    SELECT entity_id, year, epi_week, count(*)::BIGINT AS n_rows FROM rows GROUP BY ALL HAVING count(*) > 1""",
                          extra={"rows": _ORDER_ROWS}),
    "first_of_week": sql("""
    SELECT * FROM rows QUALIFY row_number() OVER (
      PARTITION BY entity_id, year, epi_week ORDER BY date, o_orderkey) = 1""", extra={"rows": _ORDER_ROWS}),
    "missing_report": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_null, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS pct_null FROM checked"
        for c in ["date", *_WEATHER_DAYS]), "checked"),
    "interpolated_cases": sql(neat_wrap(interpolated_sql("holes", ["cases"], "entity_id, year, epi_week"), ["cases"]),
                              "supplier_panel", extra={"holes": """
    SELECT entity_id, year, epi_week, CASE WHEN cases > 0 THEN cases::DOUBLE END AS cases FROM supplier_panel"""}),
    "interpolated_whole": sql(neat_wrap(interpolated_sql("holes", ["cases"], "entity_id, year, epi_week").replace(
        "PARTITION BY entity_id ORDER BY year, epi_week", "ORDER BY year, epi_week, entity_id"), ["cases"]),
                              "supplier_panel", extra={"holes": """
    SELECT entity_id, year, epi_week, CASE WHEN cases > 0 THEN cases::DOUBLE END AS cases FROM supplier_panel"""}),
    "iqr_outliers": neat_wrap("""
    SELECT variable, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS n_outliers,
      count(*)::BIGINT AS n,
      count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS pct
    FROM (SELECT variable, value, quantile_cont(value, 0.25) OVER (PARTITION BY variable) AS q1,
            quantile_cont(value, 0.75) OVER (PARTITION BY variable) AS q3
          FROM (SELECT 'l_quantity' AS variable, l_quantity AS value FROM lineitem
                UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
                UNION ALL SELECT 'l_discount', l_discount FROM lineitem))
    GROUP BY variable""", ["pct"]),
    "master_columns": sql(neat_wrap("SELECT * FROM master", ["cases", *WEATHER_COLUMNS]), "master"),
    "source_summary": """
    SELECT o_orderstatus AS source, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS total,
      list_sort(list(DISTINCT isoyear(o_orderdate)::INT)) AS years
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "overlapping_sources": """
    SELECT entity_id, year, epi_week, cases, source FROM (
      SELECT c_nationkey AS entity_id, isoyear(o_orderdate)::INT AS year, week(o_orderdate)::INT AS epi_week,
        o_orderstatus AS source, count(*)::BIGINT AS cases
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY entity_id, year, epi_week
      ORDER BY CASE source WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END) = 1""",
    "weekly_counts": sql("SELECT * FROM counts", "counts"),
    "dense_panel": sql("SELECT * FROM panel", "panel"),
    "dense_supplier_panel": sql("SELECT * FROM supplier_panel", "supplier_panel"),
    "dense_panel_52": sql("""
    SELECT d.entity_id, y.year, w.epi_week::INT AS epi_week, coalesce(c.cases, 0)::BIGINT AS cases
    FROM domain d CROSS JOIN (SELECT DISTINCT year FROM counts) y CROSS JOIN range(1, 53) w(epi_week)
    LEFT JOIN counts c ON c.entity_id = d.entity_id AND c.year = y.year AND c.epi_week = w.epi_week""",
                          "counts", "domain"),
    "iso_weeks": """
    SELECT DISTINCT o_orderdate::DATE AS date, isoyear(o_orderdate)::INT AS year, week(o_orderdate)::INT AS epi_week,
      isoyear(o_orderdate) || '-SE' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS label,
      date_trunc('week', o_orderdate)::DATE AS monday,
      (date_diff('day', DATE '1970-01-05', date_trunc('week', o_orderdate)::DATE) // 7)::INT AS week_index
    FROM orders""",
    "week_alignment": sql("""
    SELECT coalesce(p.year, w.year) AS year, coalesce(p.epi_week, w.epi_week) AS epi_week,
      CASE WHEN p.year IS NOT NULL AND w.year IS NOT NULL THEN 'both'
        WHEN p.year IS NOT NULL THEN 'panel only' ELSE 'weather only' END AS status
    FROM (SELECT DISTINCT year, epi_week FROM panel) p FULL JOIN weather w
      ON p.year = w.year AND p.epi_week = w.epi_week""", "panel", "weather"),
    "weeks_without_weather": sql(
        "SELECT year, epi_week FROM panel EXCEPT SELECT year, epi_week FROM weather", "panel", "weather"),
    "shared_weeks": sql(
        "SELECT year, epi_week FROM panel INTERSECT SELECT year, epi_week FROM weather", "panel", "weather"),
    "panel_with_weather": sql(neat_wrap("SELECT * FROM joined", WEATHER_COLUMNS), "joined"),
    "weekly_weather": sql(neat_wrap("SELECT * FROM weekly", WEATHER_COLUMNS[:6]), "weekly"),
    "daily_heat_index": sql(neat_wrap(
        "SELECT date, year, epi_week, humidity_mean, heat_index FROM derived", ["humidity_mean", "heat_index"]), "derived"),
    "weather_anomalies": sql(neat_wrap(
        f"SELECT year, epi_week, {', '.join(WEATHER_COLUMNS[6:])} FROM weather", WEATHER_COLUMNS[6:]), "weather"),
    "past_anomalies": sql(neat_wrap("""
    SELECT year, epi_week, temp_mean - avg(CASE WHEN year <= 1999 THEN temp_mean END)
      OVER (PARTITION BY epi_week) AS temp_mean_anomaly FROM weekly""", ["temp_mean_anomaly"]), "weekly"),
    "trailing_weather": sql(neat_wrap("SELECT date, " + ", ".join(
        f"avg({m}) OVER (ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW) AS {m}_mean{n}d"
        for m in ("precipitation", "humidity_max") for n in (7, 14, 21)) + " FROM daily",
        [f"{m}_mean{n}d" for m in ("precipitation", "humidity_max") for n in (7, 14, 21)]), "daily"),
}
