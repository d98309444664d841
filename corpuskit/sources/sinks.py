"""Sinks: tables, statistics, manifests, provenance."""

from __future__ import annotations

import json
import platform
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet; refuses to overwrite unless told to."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_manifest(df: DataFrame, path: str, shard: str = "shard") -> None:
    """JSON lines appended in one folder per shard, so that writers never meet."""
    df.write.mode("append").partitionBy(shard).option("ignoreNullFields", "false").json(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document at a path of any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2, default=str).encode()))
    finally:
        out.close()


def write_statistics(stats: DataFrame, path: str, settings: dict | None = None) -> dict:
    """Per-source statistics rows (one per source and one with a null source) as one document."""
    rows = [r.asDict(recursive=True) for r in stats.collect()]
    document = {
        "config": settings or {},
        "global": next(({k: v for k, v in r.items() if k != "source"} for r in rows if r["source"] is None), {}),
        "per_source": sorted((r for r in rows if r["source"] is not None), key=lambda r: r["source"]),
    }
    write_document(stats.sparkSession, document, path)
    return document


def provenance(stage: str, config: dict, **more) -> dict:
    """Where a table came from: stage, time, settings, environment."""
    import pyspark

    return {
        "schema_version": 1,
        "stage": stage,
        "saved_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "environment": {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()},
        "config": config,
        **more,
    }


def write_keep_index(index: DataFrame, folder: str, tag: str, replace: bool = False) -> str:
    """The sorted index ``row_id, copy, orig_len`` as ``folder/keep_index_<tag>``; returns that path."""
    path = f"{folder}/keep_index_{tag}"
    index.orderBy("row_id", "copy").write.mode("overwrite" if replace else "errorifexists").parquet(path)
    return path


def write_tokens(tokens: DataFrame, folder: str, shard: int) -> None:
    """Token rows of one shard in a folder of their own, so that writers never meet; a shard that runs again replaces its own."""
    tokens.write.mode("overwrite").parquet(f"{folder}/shard={shard}")


def write_prefixes(prefixes: DataFrame, path: str, shard: int) -> bool:
    """The prefix table, written by shard 0 only, as all shards have the same; tells whether it was written."""
    if shard == 0:
        prefixes.write.mode("overwrite").parquet(path)
    return shard == 0
