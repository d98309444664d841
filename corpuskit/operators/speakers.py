"""Counting speakers, and what happens to rare ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.skew import heavy_share, skew_join
from corpuskit.session import materialize

#: Stands for "no speaker" in prepared tables.
SENTINEL = "__null_ref__"

# The clip-count histogram.
HISTOGRAM = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4-5", 4, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21+", 21, None))


def _key(speaker: Column) -> Column:
    """A null id is a value of its own, different from every text."""
    return F.coalesce(F.concat(F.lit("="), speaker), F.lit("null"))


def clip_counts(df: DataFrame, speaker: str = "speaker_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``by, speaker, n_clips``; a null speaker is counted like any other."""
    return df.groupBy(*by, speaker).agg(F.count("*").alias("n_clips"))


def with_rarity(df: DataFrame, min_clips: int, speaker: str = "speaker_id") -> DataFrame:
    """Adds ``is_rare``: the row's speaker has fewer than ``min_clips`` rows.

    Only rare speakers are joined, and a speaker with many rows is never one: frequent
    speakers bypass the shuffle.
    """
    keyed = df.withColumn("_k", _key(F.col(speaker)))
    counts = materialize(keyed.groupBy("_k").count())
    rare = counts.where(F.col("count") < min_clips).select("_k", F.lit(True).alias("_rare"))
    # the counts are known exactly, so no sketch is needed; at most 1 / share keys
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = [r["_k"] for r in counts.where(F.col("count") > heavy_share(df.sparkSession) * total).collect()]
    return skew_join(keyed, rare, "_k", heavy, "left").withColumn("is_rare", F.coalesce("_rare", F.lit(False))).select(*df.columns, "is_rare")


def remove_rare(df: DataFrame, min_clips: int, speaker: str = "speaker_id") -> DataFrame:
    """Policy ``remove``: rows of rare speakers go, those of a rare null speaker too."""
    return with_rarity(df, min_clips, speaker).where(~F.col("is_rare")).drop("is_rare")


def null_rare(df: DataFrame, min_clips: int, prefix: Column, speaker: str = "speaker_id") -> DataFrame:
    """Policy ``null_prefix``: rows of rare speakers and of the sentinel get the sentinel, others ``prefix_id``."""
    name = F.concat(prefix, F.lit("_"), F.coalesce(F.col(speaker), F.lit("None")))
    lost = F.col("is_rare") | F.coalesce(F.col(speaker) == SENTINEL, F.lit(False))
    return with_rarity(df, min_clips, speaker).withColumn(speaker, F.when(lost, F.lit(SENTINEL)).otherwise(name)).drop("is_rare")


def histogram(counts: DataFrame) -> DataFrame:
    """Speakers by clip count: all buckets, zero-filled, as columns named like the bucket."""
    return counts.agg(*[F.count_if((F.col("n_clips") >= lo) & (F.col("n_clips") <= hi if hi else F.lit(True))).alias(name) for name, lo, hi in HISTOGRAM])


def speaker_statistics(df: DataFrame, source: str, min_clips: int, speaker: str = "speaker_id") -> DataFrame:
    """One row per source and one for all (source null): rows, speakers, rare and eligible ones, and the null exposure.

    Speakers of different sources are different. A source whose only speaker is the sentinel
    has no speakers to drop: as in the pipelines this stands in for, its sentinel counts as
    one eligible speaker, and ``pct_null_exposure`` does not count its rows;
    ``pct_null_exposure_corrected`` does.
    """
    counts = clip_counts(df, speaker, (source,))
    is_sentinel = F.coalesce(F.col(speaker) == SENTINEL, F.lit(False))
    rare = (F.col("n_clips") < min_clips) & ~is_sentinel
    n = F.col("n_clips")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    rows = counts.rollup(source).agg(
        F.sum(n).alias("n_rows"),
        F.count("*").alias("n_speakers"),
        F.count_if(rare).alias("n_rare_speakers"),
        total(rare).alias("n_rare_rows"),
        F.count_if(~rare).alias("n_eligible_speakers"),
        total(~rare).alias("n_eligible_rows"),
        total(rare | is_sentinel).alias("_null_rows"),
        *[F.count_if((n >= lo) & (n <= hi if hi else F.lit(True))).alias(f"n_speakers_{name}") for name, lo, hi in HISTOGRAM],
    )
    from corpuskit.functions.numeric import round_half_up

    share = lambda c: round_half_up(F.lit(100.0) * F.col(c) / F.greatest(F.lit(1), F.col("n_rows")), 2)
    return rows.withColumn("pct_null_exposure", share("n_rare_rows")).withColumn("pct_null_exposure_corrected", share("_null_rows")).drop("_null_rows")
