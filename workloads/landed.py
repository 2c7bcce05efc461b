"""Tables written as raw files below the checkpoint folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.functions.calendar import iso_week, iso_year
from weekloom.operators import forecast
from weekloom.session import scratch, settled
from weekloom.sources import cases, tables, weather
from workloads.base import daily_weather, features, population, sql, table
from workloads.forecasts import ROUTED_CTE, ROUTING, predictions


def _orders(spark, sf):
    """Orders as rows of a case export; labels hold quotes, separators, accents and line feeds."""
    date = F.col("o_orderdate").cast("date")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    rows = table(spark, sf, "orders").join(customer, "o_custkey").join(nation, "c_nationkey")
    key = F.col("o_orderkey")
    label = (F.when(key % 5 == 0, F.concat(F.lit('"'), "n_name", F.lit('", año;1')))
             .when(key % 5 == 1, F.concat("n_name", F.lit("\nsecond; line,"))).otherwise(F.col("n_name")))
    return rows.select(
        key.alias("key"), F.col("n_regionkey").alias("id_prov_indec_residencia"),
        F.when(key % 13 == 0, 999).otherwise(F.col("c_nationkey")).alias("id_depto_indec_residencia"),
        F.when(key % 3 == 0, "Dengue").when(key % 3 == 1, "DENGUE").otherwise("other").alias("evento"),
        label.alias("departamento_residencia"), iso_year(date).alias("anio_min"), iso_week(date).alias("sepi_min"),
        (key % 7).alias("cantidad"))


_ORDERS = """
    SELECT o_orderkey AS key, n_regionkey, CASE WHEN o_orderkey % 13 = 0 THEN 999 ELSE n_nationkey END AS district,
      CASE WHEN o_orderkey % 5 = 0 THEN '"' || n_name || '", año;1'
        WHEN o_orderkey % 5 = 1 THEN n_name || chr(10) || 'second; line,' ELSE n_name END AS label,
      isoyear(o_orderdate)::VARCHAR AS year, week(o_orderdate)::VARCHAR AS epi_week, (o_orderkey % 7)::VARCHAR AS cases
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _export(rows, path, separator=",", encoding="UTF-8"):
    rows.write.option("header", "true").option("sep", separator).option("escape", '"').option("encoding", encoding).csv(path)
    return path


def national_case_files(spark, sf):
    """Three dialects under one reader call: separator, column order, encoding and extra columns differ."""
    rows = settled(_orders(spark, sf), "orders")
    base = scratch(spark, "national")
    columns = rows.columns[1:]
    part = [rows.where(F.col("key") % 3 == i).select(columns) for i in range(3)]
    return cases.read_national_cases(spark, [
        _export(part[0], f"{base}/comma"),
        _export(part[1].select(columns[::-1]), f"{base}/semicolon", ";", "ISO-8859-1"),
        _export(part[2].withColumn("id_grupo_etario", F.lit("x")).select("id_grupo_etario", *columns[3:], *columns[:3]), f"{base}/tab", "\t"),
    ], "national", region=2, event="dengue")


def city_case_files(spark, sf):
    """The city export, whose unknown districts are dropped."""
    rows = _orders(spark, sf).select(
        F.col("anio_min").alias("ano"), F.col("sepi_min").alias("semana_epidemiologica"),
        F.when(F.col("key") % 11 == 0, " sin dato").when(F.col("key") % 11 == 1, "").otherwise(F.col("departamento_residencia")).alias(
            "departamento_residencia"), F.col("cantidad").alias("n_confirmados"))
    return cases.read_city_cases(spark, _export(rows, f"{scratch(spark, 'city')}/city", ";"), "city")


def _payloads(spark, sf):
    """One document per year; of three years one is cut off and one lacks its last rain."""
    days = daily_weather(spark, sf).select("date", *[F.col(new).alias(old) for old, new in weather.DAILY_VARIABLES.items()])
    columns = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("time"), *weather.DAILY_VARIABLES)))
    years = days.groupBy(F.year("date").alias("year")).agg(columns.alias("days"))
    rain = F.col("days.precipitation_sum")
    kept = F.when(F.col("year") % 3 == 1, F.slice(rain, 1, F.size(rain) - 1)).otherwise(rain)
    daily = F.struct(F.col("days.time").alias("time"), *[
        (kept if name == "precipitation_sum" else F.col(f"days.{name}")).alias(name) for name in weather.DAILY_VARIABLES])
    text = F.to_json(F.struct(daily.alias("daily")))
    path = f"{scratch(spark, 'payloads')}/daily"
    years.select("year", F.when(F.col("year") % 3 == 2, F.substring(text, 1, 200)).otherwise(text).alias("value")).write.partitionBy(
        "year").text(path)
    return weather.read_payloads(spark, path)


def weather_payloads(spark, sf):
    return weather.daily_rows(_payloads(spark, sf))


def rejected_weather_payloads(spark, sf):
    year = F.regexp_extract("file", "year=([0-9]+)", 1).cast("int").alias("year")
    return weather.rejected_payloads(_payloads(spark, sf)).select(year, "reason")


def population_file(spark, sf):
    named = population(spark, sf).join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity_id"), "n_name"), "entity_id")
    rows = named.select(F.concat("n_name", F.lit(', "old" part')).alias("barrios"), F.col("population").alias("poblacion"),
                        F.col("entity_id").alias("comuna_id"))
    return tables.read_population(spark, _export(rows, f"{scratch(spark, 'population')}/population"))


def table_with_twin(spark, sf):
    """A table and its CSV twin, read back."""
    path = scratch(spark, "twins")
    rows = _orders(spark, sf).select("key", F.col("anio_min").alias("year"), F.col("sepi_min").alias("epi_week"))
    tables.write_table(rows, f"{path}/table", ["year"], f"{path}/csv")
    twin = spark.read.schema(rows.schema).csv(f"{path}/csv", header=True)
    stored = tables.read_table(spark, f"{path}/table", rows.columns)
    return stored.select(F.lit("table").alias("form"), *rows.columns).unionByName(twin.select(F.lit("csv").alias("form"), *rows.columns))


def split_tables(spark, sf):
    """The splits of a stored feature table; training rows come from their augmented form."""
    path = scratch(spark, "splits")
    rows = features(spark, sf).select("entity_id", "year", "epi_week", "cases", "split")
    tables.write_table(rows, f"{path}/features", ["split"])
    stored = tables.read_table(spark, f"{path}/features")
    doubled = stored.where("split = 'train'").withColumn("cases", F.col("cases") * 2)
    tables.write_table(stored.where("split = 'train'").unionByName(doubled), f"{path}/augmented")
    read = [tables.read_splits(spark, f"{path}/features", s, f"{path}/augmented" if s == "train" else None, rows.columns)
            for s in ("train", "validation", "test")]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("split", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cases").cast("long").alias("cases"))


def routing_file(spark, sf):
    """Predictions routed by rules that were written and read back."""
    path = scratch(spark, "routing")
    tables.write_routing(tables.routing_table(spark, ROUTING), path)
    return forecast.route(predictions(spark, sf), tables.read_routing(spark, path)).groupBy("horizon", "model_used").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_pred").cast("long").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    national_case_files, city_case_files, weather_payloads, rejected_weather_payloads, population_file, table_with_twin,
    split_tables, routing_file)}

ORACLES = {
    "national_case_files": f"""
    SELECT year, epi_week, label, cases, 'national' AS source FROM ({_ORDERS})
    WHERE n_regionkey = 2 AND key % 3 <> 2 AND district <> 999""",
    "city_case_files": f"""
    SELECT year, epi_week, label, cases, 'city' AS source FROM ({_ORDERS}) WHERE key % 11 > 1""",
    "weather_payloads": sql("SELECT * FROM daily WHERE year(date) % 3 = 0", "daily"),
    "rejected_weather_payloads": sql("""
    SELECT year(date)::INT AS year, CASE WHEN year(date) % 3 = 2 THEN 'not a document of daily values'
      ELSE 'precipitation_sum: ' || (count(*) - 1) || ' values for ' || count(*) || ' days' END AS reason
    FROM daily WHERE year(date) % 3 > 0 GROUP BY year(date)""", "daily"),
    "population_file": sql("""
    SELECT entity_id::INT AS entity_id, population, n_name || ', "old" part' AS names
    FROM pop JOIN nation ON n_nationkey = entity_id""", "pop"),
    "table_with_twin": f"""
    SELECT form, key, year::INT AS year, epi_week::INT AS epi_week FROM ({_ORDERS}), (SELECT unnest(['table', 'csv']) AS form)""",
    "split_tables": sql("""
    SELECT split, entity_id, count(*) * CASE WHEN split = 'train' THEN 2 ELSE 1 END AS n,
      (sum(cases) * CASE WHEN split = 'train' THEN 3 ELSE 1 END)::BIGINT AS cases FROM split GROUP BY split, entity_id""", "split"),
    "routing_file": sql(
        "SELECT horizon, model_used, count(*) AS n, sum(y_pred)::BIGINT AS predicted FROM routed GROUP BY ALL", "panel", extra=ROUTED_CTE),
}
