"""Problem 2: per-speaker results in spite of speakers that own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.speaker_ids import known_speaker
from corpuskit.operators.skew import per_key_records
from corpuskit.plans.registry import Registry, known_speaker_sql, table

registry = Registry()

_PER_SPEAKER = f"""
WITH c AS (SELECT {known_speaker_sql('speaker_id')} AS speaker_id, row_id, encoded_len FROM clips),
once AS (SELECT speaker_id, row_id, count(*) AS n, max(encoded_len) AS m FROM c WHERE speaker_id IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(n) AS n_all FROM once)
SELECT speaker_id, CAST(sum(n) AS BIGINT) AS n_rows, count(row_id) AS n_clips,
       CAST(coalesce(sum(m) FILTER (row_id IS NOT NULL), 0) AS BIGINT) AS n_frames, max(m) FILTER (row_id IS NOT NULL) AS longest_clip,
       any_value(n_all) AS n_all
FROM once, t GROUP BY speaker_id"""


def speaker_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "clips").select(known_speaker("speaker_id").alias("speaker_id"), "row_id", "encoded_len")
    return per_key_records(clips, "speaker_id", "row_id", "encoded_len")


@registry.query(f"SELECT speaker_id, n_rows, n_clips, n_frames, longest_clip FROM ({_PER_SPEAKER})")
def p2_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, frames and longest clip of every known speaker."""
    return speaker_results(spark, sf_dir).select(
        "speaker_id", "n_rows", F.col("n_records").alias("n_clips"), F.col("total").alias("n_frames"), F.col("longest").alias("longest_clip")
    )


@registry.query(f"SELECT speaker_id FROM ({_PER_SPEAKER}) WHERE n_rows * 100 >= n_all")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers with at least one hundredth of the rows that have a known speaker."""
    return speaker_results(spark, sf_dir).where(F.col("n_rows") * 100 >= F.col("n_all")).select("speaker_id")
