"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "weekly_counts", "dense_panel", "cleaned_cases", "master_columns", "case_lags", "scaled_copies",
    "persistence_scores", "auc_scores", "winners", "fold_scores", "rank_correlation", "outbreak_flags",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    problem = check.compare(spark, check.duck(SF_DIR), entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem is None


@needs_data
def test_panel_reads_its_source_once(spark):
    """The years of the calendar come from the shuffle of the counts, not from a second scan."""
    frame = entry.queries()["dense_panel"](spark, SF_DIR)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
