"""A log of runs: one table of metrics that grows by one partition per run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.evaluate import comparison


def log_run(metrics: DataFrame, path: str, run_id: str, finished: datetime) -> None:
    """Add a run's metrics to the log. A run that is logged again replaces itself alone.

    Only the run's own partition is overwritten, when the job commits, so a failed or repeated
    job leaves neither half a run nor a doubled one.
    """
    rows = metrics.withColumns({
        "run_id": F.lit(run_id), "finished": F.lit(finished).cast("timestamp"), "run_part": F.lit(f"run-{run_id}")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_part").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the log, with ``run_id`` and ``finished``."""
    return spark.read.parquet(path).drop("run_part")


def earlier_run(runs: DataFrame, run_id: str, about: Column | None = None) -> str | None:
    """The id of the latest run that finished before the named one, among those that ``about`` selects."""
    own = runs.where(F.col("run_id") == run_id).agg(F.min("finished").alias("at"))
    others = runs.where(about) if about is not None else runs
    before = others.where(F.col("run_id") != run_id).join(F.broadcast(own), F.col("finished") < F.col("at"))
    return before.agg(F.max_by("run_id", F.struct("finished", "run_id")).alias("run")).first()["run"]


def against_earlier(runs: DataFrame, run_id: str, **kwargs) -> DataFrame:
    """Scores of a run beside those of the latest run before it, with the distance to the best."""
    other = earlier_run(runs, run_id)
    if other is None:
        raise ValueError(f"the log holds no run before {run_id}")
    return comparison(runs.where(F.col("run_id") == run_id), runs.where(F.col("run_id") == other), **kwargs)
