import csv
import datetime
import io
import json
import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from weekloom.sources import cases, tables, weather
from weekloom.sources.delimited import read_delimited

HEADER = ("id_depto_indec_residencia,departamento_residencia,id_prov_indec_residencia,provincia_residencia,"
          "anio_min,evento,id_grupo_etario,grupo_etario,sepi_min,cantidad")
LINES = [
    "7,COMUNA 7,2,CABA,2023,Dengue,1,a,10,3",
    "7, comuna 7 ,2,CABA,2023,dengue,2,b,10,4",
    "8,COMUNA 8,6,PBA,2023,Dengue,1,a,10,9",
    "8,COMUNA 8,2,CABA,2023,Zika,1,a,10,9",
    "999,desconocido,2,CABA,2023,Dengue,1,a,10,9",
    ",COMUNA 9,2,CABA,2023,Dengue,1,a,11,1",
]


def test_national_cases(spark, tmp_path, rows):
    path = tmp_path / "national.csv"
    path.write_text("\n".join([HEADER, *LINES]), encoding="utf-8")
    got = rows(cases.read_national_cases(spark, str(path), "national"))
    assert got == [("2023", "10", " comuna 7 ", "4", "national"), ("2023", "10", "COMUNA 7", "3", "national"),
                   ("2023", "11", "COMUNA 9", "1", "national")]


def test_other_separator_and_encoding(spark, tmp_path, rows):
    path = tmp_path / "latin.csv"
    path.write_bytes("nombre;n\nNúñez;1\n".encode("latin-1"))
    assert rows(read_delimited(spark, str(path))) == [("Núñez", "1")]


def test_mixed_encodings_are_read_line_by_line(spark, tmp_path, rows):
    path = tmp_path / "mixed.csv"
    path.write_bytes("nombre,n\r\nÑ,1\r\n".encode() + "Ü,2\r\n".encode("latin-1"))
    assert set(rows(read_delimited(spark, str(path)))) == {("Ü", "2"), ("Ñ", "1")}


def test_missing_column_raises(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        read_delimited(spark, str(path), ["c"])


def test_city_cases(spark, tmp_path, rows):
    path = tmp_path / "city.csv"
    head = ("ano;semana_epidemiologica;fecha_inicio_semana_epidemiologica;grupo_etario;departamento_residencia;"
            "n_confirmados;fecha_semana_epidemiologica")
    path.write_text("﻿" + head + "\n2024;31;28/7/2024;SIN DATO;SIN DATO;0;2024-W31\n"
                    "2025;5;x;a;Comuna 1;2;2025-W05\n2025;5;x;b;;2;2025-W05\n2025;5;x;b;sin dato;2;2025-W05\n", encoding="utf-8")
    assert rows(cases.read_city_cases(spark, str(path), "city")) == [("2025", "5", "Comuna 1", "2", "city")]


def test_daily_weather_from_columnar_payload(spark, tmp_path, rows):
    names = list(weather.DAILY_VARIABLES)
    payload = {"daily": {"time": ["2024-01-01", "2024-01-02"], **{n: [float(i), None] for i, n in enumerate(names)}}}
    (tmp_path / "a.json").write_text(json.dumps(payload, indent=1))
    got = weather.read_daily_weather(spark, str(tmp_path / "a.json")).orderBy("date").collect()
    assert [str(r["date"]) for r in got] == ["2024-01-01", "2024-01-02"]
    assert (got[0]["temp_max"], got[0]["humidity_min"], got[1]["temp_mean"]) == (0.0, 5.0, None)


def test_population_with_quoted_names(spark, tmp_path, rows):
    path = tmp_path / "pop.csv"
    path.write_text('comuna_id,poblacion,barrios\n1,100,"Retiro, San Telmo"\n2,50,Recoleta\n')
    assert rows(tables.read_population(spark, str(path))) == [(1, 100, "Retiro, San Telmo"), (2, 50, "Recoleta")]


def test_routing_round_trip(spark, tmp_path, rows):
    rules = {0: {"default": "a"}, 1: {"default": "b", "exceptions": {7: "a"}}}
    table = tables.routing_table(spark, rules)
    tables.write_routing(table, str(tmp_path / "routing"))
    assert rows(tables.read_routing(spark, str(tmp_path / "routing"))) == rows(table)


def test_table_round_trip_and_splits(spark, tmp_path, rows):
    frame = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    tables.write_table(frame, str(tmp_path / "t"), ["split"], str(tmp_path / "csv"))
    assert rows(tables.read_splits(spark, str(tmp_path / "t"), "train"), "x") == [(1,)]
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t"), ["y"])


def test_model_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(frame)
    tables.save_model(model, str(tmp_path / "m"))
    assert tables.load_model(str(tmp_path / "m")).stages[0].getInputCols() == ["a", "b"]


def _written(path, header, rows, separator, encoding="utf-8", mark="", newline="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=separator, lineterminator=newline)
    writer.writerow(header)
    writer.writerows([[row.get(c, "") for c in header] for row in rows])
    path.write_bytes((mark + out.getvalue()).encode(encoding))


def test_each_file_has_its_own_dialect_and_records_span_splits(spark, tmp_path):
    """Quoted line feeds are put together although every file is cut into many splits."""
    random.seed(7)
    values = ["x,y", "p;q", 'say "hi"', "é ñ", "two\nlines", "a\n\nb", '5" x', '"', '""\n"', "q\t\nr;,\n", ""]
    want = []
    for n, (separator, header, encoding, mark, newline) in enumerate([
            (",", "abc", "utf-8", "﻿", "\n"), (";", "cab", "latin-1", "", "\r\n"), (";", "bc", "utf-8", "", "\n"), ("\t", "abcd", "utf-8", "", "\r\n")]):
        given = [{c: random.choice([f"{n}-{i}", *values]) for c in header} for i in range(300)]
        _written(tmp_path / f"{n}.csv", list(header), given, separator, encoding, mark, newline)
        want += [tuple(row.get(c) or None for c in "abcd") for row in given]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = read_delimited(spark, str(tmp_path))
        assert got.columns == ["a", "b", "c", "d"]
        assert Counter(tuple(r) for r in got.collect()) == Counter(r for r in want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quotes_that_never_close_are_characters(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('a,b\n1,5" pipe\n2,x"y\n3,"open\n4,z\n')
    assert rows(read_delimited(spark, str(tmp_path))) == [("1", '5" pipe'), ("2", 'x"y'), ("3", "open"), ("4", "z")]


def test_chosen_columns_and_the_file_of_a_row(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n\na,b\n")
    (tmp_path / "b.csv").write_text("b;c;a\n4;5;3\n")
    got = read_delimited(spark, str(tmp_path), ["a"], columns=["c", "a"], file_column="file")
    assert [(f.rsplit("/", 1)[1], c, a) for f, c, a in rows(got)] == [("a.csv", None, "1"), ("b.csv", "5", "3")]
    with pytest.raises(ValueError, match="a.csv lacks columns .'c'"):
        read_delimited(spark, str(tmp_path), ["c"])
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header line"):
        read_delimited(spark, str(tmp_path / "empty"))


def test_payloads_that_cannot_be_read_are_listed(spark, tmp_path, rows):
    names = list(weather.DAILY_VARIABLES)
    good = {"daily": {"time": ["2024-01-01", "2024-01-02"], names[0]: [1.0, None]}}
    bad = {
        "cut.json": json.dumps(good)[:-9], "text.json": "no json", "other.json": json.dumps({"error": True}),
        "uneven.json": json.dumps({"daily": {"time": ["2024-01-01"], names[3]: [1.0, 2.0]}}),
        "day.json": json.dumps({"daily": {"time": ["2024-01-01", "never"], names[0]: [1.0, 2.0]}})}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    payloads = weather.read_payloads(spark, str(tmp_path))
    assert rows(weather.daily_rows(payloads), "date", "temp_max", "temp_min") == [
        (datetime.date(2024, 1, 1), 1.0, None), (datetime.date(2024, 1, 2), None, None)]
    found = {file.rsplit("/", 1)[1]: reason for file, reason in rows(weather.rejected_payloads(payloads))}
    assert found == {
        "cut.json": "not a document of daily values", "text.json": "not a document of daily values", "other.json": "no days",
        "uneven.json": "precipitation_sum: 2 values for 1 days", "day.json": "a day that is no date"}
