"""Watching append-only shards, and boards of stage events, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.operators.rollouts import shard_progress
from corpuskit.session import ensure_checkpoint_dir


def watch_shards(lines: DataFrame, samples: int, name: str, once: bool = True, interval: str = "30 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Running line counts per shard of a stream of manifest lines, as the in-memory table ``name``.

    The state is one row per shard. ``once`` reads what is there and ends; otherwise the
    stream goes on every ``interval``. Its state lies in ``checkpoint``, by default a folder of
    its name in the shared checkpoint folder.
    """
    writer = shard_progress(lines, samples).writeStream.outputMode("complete").format("memory").queryName(name)
    writer = writer.option("checkpointLocation", checkpoint or f"{ensure_checkpoint_dir(lines.sparkSession)}/streams/{name}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def board(events: DataFrame, item: str, at: str, percent: str, stage: str, identity: str) -> DataFrame:
    """``item, started, stage, percent, n_events``: first time, latest stage, and a percentage that never falls."""
    return events.groupBy(item).agg(
        F.min(at).alias("started"),
        F.max(F.struct(at, identity, stage)).getField(stage).alias("stage"),
        F.max(percent).alias("percent"),
        F.count("*").alias("n_events"),
    )


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Events per window and kind; on a stream, windows close ``late`` after the latest event seen."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A file stream over a Parquet table, be it a folder or one file; the schema is that of ``like``, as streams need it beforehand."""
    reader = spark.readStream.schema(like.schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)
