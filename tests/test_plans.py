"""What the plans must look like: these properties decide whether a query survives more data."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weekloom import session
from weekloom.operators import cleaning, explore, features as ops, panel
from weekloom.operators.ranks import exact_quantiles
from weekloom.session import settled, shared_folder

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
PANEL = "entity_id int, year int, epi_week int, cases bigint"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", [
    "weekly_counts", "dense_panel", "supplier_lags", "neighbour_means", "season_peaks", "relative_incidence",
    "alert_levels", "persistence_scores", "rolling_folds", "block_scores", "lead_times", "scaled_copies",
])
def test_no_nested_loops_and_no_python(spark, name):
    plan = physical(entry.queries()[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


@needs_data
def test_counts_read_two_columns_and_combine_before_the_shuffle(spark):
    plan = physical(entry.queries()["weekly_counts"](spark, SF_DIR))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "partial_sum" in plan
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(entry.queries()["weekly_counts"](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Orders and customers to the join, then the partial sums.
    assert plan.count("Exchange hashpartitioning(") == 3


def test_one_entity_holding_most_rows_is_combined_before_the_shuffle(spark, rows):
    """A third of the rows on one key leaves each task as at most one row per week."""
    skewed = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("int").alias("entity_id"),
        F.lit(2023).alias("year"), (F.col("id") % 52 + 1).cast("int").alias("epi_week"), F.lit(1).cast("bigint").alias("cases"))
    weekly = panel.weekly_sum(skewed)
    assert "partial_sum" in physical(weekly)
    dense = panel.densify(weekly)
    assert dense.count() == 52 * dense.select("entity_id").distinct().count()
    assert dense.agg(F.sum("cases")).first()[0] == 30000
    assert dense.where("entity_id = 7").agg(F.sum("cases")).first()[0] == skewed.where("entity_id = 7").count()


def test_lags_after_the_fill_need_no_second_exchange(spark):
    frame = spark.createDataFrame([(1, 2023, 1, 4), (2, 2023, 9, 1)], PANEL).repartition(3)
    filled = ops.add_targets(ops.add_lags(panel.densify(frame, weeks_per_year=52), {"cases": "cases"}))
    assert physical(filled).count("hashpartitioning(entity_id") == 1


@pytest.fixture
def large(spark, tmp_path, monkeypatch):
    """A panel in files of some size, for partitions of few bytes."""
    path = str(tmp_path / "a b.parquet")
    cell = F.when(F.col("id") % 3 == 0, F.col("id") % 11)
    spark.range(6000).select(
        (F.col("id") % 60).cast("int").alias("entity_id"), F.lit(2023).alias("year"),
        (F.col("id") % 49 + 1).cast("int").alias("epi_week"), cell.alias("cases")).dropDuplicates(
            ["entity_id", "year", "epi_week"]).write.parquet(path)
    monkeypatch.setattr(session, "PART_BYTES", 400, raising=False)
    return spark.read.parquet(path)


def most_rows(frame):
    """Partitions with rows, and the rows of the largest."""
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(sizes), max(sizes)


def test_partitions_of_the_panel_grow_with_its_files(spark, large, rows, monkeypatch):
    """one exchange on the entity, in more partitions than the session's four."""
    cells = lambda: explore.week_cells(panel.densify(large))
    windows = lambda: ops.sequence_windows(panel.densify(large), ["cases"], "cases", by=())
    assert most_rows(windows())[0] > 8
    assert physical(windows()).count("Exchange") == physical(panel.densify(large)).count("Exchange")
    got = rows(cells()), rows(windows())
    monkeypatch.setattr(session, "PART_BYTES", 1 << 30)
    assert most_rows(windows())[0] <= 4
    assert got == (rows(cells()), rows(windows()))


def test_ranges_of_the_whole_table_grow_with_its_files(spark, large, rows, monkeypatch):
    """more ranges than the session's four partitions, and no task gets several of them by chance."""
    filled = lambda: cleaning.interpolate(large.withColumn("cases", F.col("cases").cast("double")), ["cases"], by=[])
    many, most = most_rows(filled())
    assert many > 8 and most < large.count() / 4
    got = rows(filled())
    monkeypatch.setattr(session, "PART_BYTES", 1 << 30)
    assert got == rows(filled())


def test_quantiles_of_a_dominant_value(spark):
    frame = spark.range(9000).select(F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = exact_quantiles(frame, "v", {"half": 0.5, "high": 1.0}).first()
    assert tuple(got) == (0.0, 8997.0)


def test_settled_tables_keep_their_rows_and_pruning(spark, rows):
    frame = spark.createDataFrame([(1, "a", 2.0), (2, None, None)], "x int, y string, z double")
    stored = settled(frame)
    assert rows(stored) == rows(frame) and shared_folder(spark)
    assert "ReadSchema: struct<x:int>" in physical(stored.select("x"))
