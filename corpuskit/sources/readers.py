"""Scans: tables, slices of them, JSON lines, manifests, audio references."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.config import ConfigError
from corpuskit.functions.text import file_stem
from corpuskit.operators.ranking import ordered_rank

_SPLIT = re.compile(r"^\w+(?:\[(?P<low>-?\d+%?)?:(?P<high>-?\d+%?)?\])?$")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema given, only its columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def split_bounds(expression: str, n: int) -> tuple[int, int]:
    """First row and last row + 1 of ``name``, ``name[:k]``, ``name[a:b]`` or ``name[:p%]`` over n rows; percentages are floored."""
    m = _SPLIT.match(expression.strip())
    if not m:
        raise ConfigError(f"bad split {expression!r}")

    def at(x: str | None, default: int) -> int:
        if x is None:
            return default
        i = int(x[:-1]) * n // 100 if x.endswith("%") else int(x)
        return max(0, min(n, i + n if i < 0 else i))

    return at(m["low"], 0), at(m["high"], n)


def split_slices(df: DataFrame, source: str, expressions: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Rows of each source that its split expression selects, rows taken in ``order``; sources without one are out.

    Counts of the named sources reach the driver, one row each.
    """
    named = df.where(F.col(source).isin(*expressions))
    counts = {r[0]: r[1] for r in named.groupBy(source).count().collect()}
    bounds = {s: split_bounds(e, counts.get(s, 0)) for s, e in expressions.items()}
    whole = [s for s, (lo, hi) in bounds.items() if lo == 0 and hi >= counts.get(s, 0)]
    out = named.where(F.col(source).isin(*whole))
    part = [s for s in bounds if s not in whole]
    if part:
        ranked = ordered_rank(named.where(F.col(source).isin(*part)), source, list(order), "_at")
        inside = None
        for s in part:
            c = (F.col(source) == s) & (F.col("_at") >= bounds[s][0]) & (F.col("_at") < bounds[s][1])
            inside = c if inside is None else inside | c
        out = out.unionByName(ranked.where(inside).drop("_at"))
    return out


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines under a given schema; lines that are no JSON object give a row of nulls."""
    return spark.read.schema(schema).json(list(paths) if not isinstance(paths, str) else paths)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``path`` and ``path.shard*`` together, with ``file`` for the order of lines; fails if none exists."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path + "{,.shard*}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    names = sorted(str(f.getPath()) for f in (found or []))
    if not names:
        raise FileNotFoundError(f"no manifest at {path}")
    return read_jsonl(spark, names, schema).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file; 0 if it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.text(path).count()


def audio_references(spark: SparkSession, path: str, suffix: str = "*.wav") -> DataFrame:
    """``speaker, path, content``: one row per audio file, the speaker being the file's stem; decoding is a provider's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return files.select(file_stem(F.col("path")).alias("speaker"), "path", "content")


def pool_references(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``speaker`` named ``pool_00``, ``pool_01`` ... by row number."""
    return rows.withColumn("speaker", F.format_string("pool_%02d", F.col(row_id)))


def count_files(spark: SparkSession, folder: str, suffix: str = "") -> int:
    """Files of a folder whose names end so, subfolders included; 0 if it is missing. Names only are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    found, n = fs.listFiles(p, True), 0
    while found.hasNext():
        n += found.next().getPath().getName().endswith(suffix)
    return n


def require_built(spark: SparkSession, table: str, keep_index: str | None = None, checkpoint: str | None = None) -> None:
    """Fails before any work if the table was never completely written, or a named index or local checkpoint is missing.

    A checkpoint may be a name in a model registry; only one that is written as a path is looked for.
    """

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    if not there(table):
        raise ConfigError(f"no table at {table}; build it first")
    if not there(f"{table}/_SUCCESS"):
        raise ConfigError(f"the table at {table} was not completely written")
    if keep_index and not there(keep_index):
        raise ConfigError(f"no keep index at {keep_index}")
    if checkpoint and checkpoint.startswith(("/", "./", "../", "~")) and not there(checkpoint):
        raise ConfigError(f"no checkpoint at {checkpoint}")


def require_rows(table: DataFrame, voice_cloning: bool = False, frame_rate: float | None = None, heads: Sequence[str] | None = None) -> DataFrame:
    """The table, if it has a row and training with voices has the settings it needs."""
    if not table.head(1):
        raise ConfigError("the training table is empty")
    if voice_cloning and (not frame_rate or not heads):
        raise ConfigError("training with voices needs the frame rate and the heads")
    return table
