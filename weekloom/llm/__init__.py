"""Operators for training-data pipelines: text quality, duplicates, mixing, search, scoring."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_weekloom_shipped", None) != context.applicationId:
        # Spark serves the archive to executors for as long as the application runs.
        archive = Path(tempfile.mkdtemp(prefix="modules-")) / "weekloom_modules.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, Path(PACKAGE.name) / file.relative_to(PACKAGE))
        context.addPyFile(str(archive))
        context._weekloom_shipped = context.applicationId
    return spark
