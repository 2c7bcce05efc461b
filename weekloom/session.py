"""Session settings and checkpoint location."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable
from itertools import chain

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files, as they are stored, for a partition of a step that holds its rows in memory.
PART_BYTES = 8 << 20


def local_session(cores: str | int = "*", app: str = "weekloom", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Session for tests and local benches. On a cluster, use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(frame: DataFrame | Iterable[DataFrame], name: str = "settled", codec: str | None = None) -> DataFrame:
    """Write a costly intermediate table once and read it back. Several frames of one schema are
    written one after the other, so that none waits in memory or in a plan for the others; an
    iterator makes each when the one before is written. ``codec`` is the session's if not given.

    For operators that read their input several times. A parquet table, unlike a cache,
    survives the loss of executors, and unlike an RDD checkpoint keeps column pruning.
    The table goes when the application ends.
    """
    frames = iter([frame] if isinstance(frame, DataFrame) else frame)
    first = next(frames)
    spark = first.sparkSession
    path = scratch(spark, name)
    for part in chain([first], frames):
        part.write.mode("append").parquet(path, compression=codec)
    return spark.read.schema(first.schema).parquet(path)


def packed(frame: DataFrame | Iterable[DataFrame], name: str) -> DataFrame:
    """``settled`` in smaller files, which take longer to write: for texts."""
    return settled(frame, name, "zstd")


def dropped(table: DataFrame) -> None:
    """Delete the files of a ``settled`` table that no unwritten plan reads any more."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def parts_for(frame: DataFrame) -> int | None:
    """Partitions that keep a task's share of ``frame`` at one size however large its files are.

    None while ``spark.sql.shuffle.partitions`` are enough, which leaves them to adaptive execution.
    """
    spark = frame.sparkSession
    jvm, conf, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in frame.inputFiles():  # as encoded addresses
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size += file.getFileSystem(conf).getFileStatus(file).getLen()
    many = -(-size // PART_BYTES)
    return many if many > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(frame: DataFrame, *by: str) -> DataFrame:
    """``frame`` by hash of ``by``, in as many partitions as its files ask for; as it is if the
    session's number is enough. For steps that would exchange on ``by`` anyway."""
    many = parts_for(frame)
    return frame.repartition(many, *by) if many else frame


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to.

    For long chains of settled tables: the files otherwise stay until the driver happens to
    collect its garbage. Events of a query that has ended refer to its plan until all listeners
    have had them, which takes a moment.
    """
    gc.collect()
    context = spark.sparkContext
    try:
        context._jsc.sc().listenerBus().waitUntilEmpty(5000)
    except Py4JJavaError:  # still busy; the next call will find them
        pass
    context._jvm.System.gc()
