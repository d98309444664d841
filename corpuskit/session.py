"""Session helpers: building a local session, and cutting lineage safely on a cluster."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: set[str] = set()


def local_session(cores: str = "*", app: str = "corpuskit", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster, whose
    machines would each write to their own disk, that is an error.
    """
    context = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if wanted is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="corpuskit-checkpoint-"))
    folder = context.getCheckpointDir()
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove_tables, spark, folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and return a DataFrame that reads it.

    The files survive the loss of executors, the plan starts afresh (so the optimiser's work
    stays constant over the rounds of an iterative job), sizes are known exactly and unused
    columns are not read. The folder belongs to the application and is removed when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no plan reads any more, such as those of earlier rounds."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_tables(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, f"{folder}/tables")
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
