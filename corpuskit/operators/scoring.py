"""Scores of generated samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import PairConfig, RewardConfig
from corpuskit.functions.numeric import cosine, round_half_up
from corpuskit.functions.text import character_error_rate, expected_seconds, normalise, word_error_rate
from corpuskit.operators.skew import heavy_hitters, skew_join


def latest_lines(lines: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, the one with the greatest version; rows equal in it are compared by all other columns.

    An aggregate combined before the shuffle instead of a window; map columns are not supported.
    """
    rest = [c for c in lines.columns if c not in keys and c != version]
    best = lines.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in lines.columns])


def error_rates(df: DataFrame, reference: str = "text", hypothesis: str = "transcript") -> DataFrame:
    """Adds ``empty``, ``wer`` and ``cer``, unrounded; null transcripts are empty, an empty reference gives null rates."""
    ref, hyp = normalise(F.coalesce(F.col(reference), F.lit(""))), normalise(F.coalesce(F.col(hypothesis), F.lit("")))
    staged = df.withColumns({"_ref": ref, "_hyp": hyp})
    return staged.withColumns({"empty": F.col("_hyp") == "", "wer": word_error_rate(F.col("_ref"), F.col("_hyp")), "cer": character_error_rate(F.col("_ref"), F.col("_hyp"))}).drop("_ref", "_hyp")


def duration_bounds(df: DataFrame, cfg: RewardConfig, text: str = "text") -> DataFrame:
    seconds = expected_seconds(F.col(text), cfg)
    return df.withColumns({"low": seconds * F.lit(cfg.min_ratio), "high": seconds * F.lit(cfg.max_ratio)})


def rewards(df: DataFrame, cfg: RewardConfig, pairs: PairConfig) -> DataFrame:
    """Adds ``raw_reward`` and ``is_clean`` from unrounded ``wer, empty, low, high, duration_sec, sim, truncated``.

    A null similarity costs nothing. Sums never give a negative zero.
    """
    over = F.greatest(F.lit(0.0), F.col("duration_sec") - F.col("high"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = F.col("wer") * F.lit(-cfg.w_wer) - over * F.lit(cfg.w_over) - flag(F.col("duration_sec") < F.col("low")) * F.lit(cfg.w_short) - flag(F.col("empty")) * F.lit(cfg.w_empty)
    similarity = F.when(F.col("sim").isNull(), 0.0).otherwise((F.lit(1.0) - F.col("sim")) * F.lit(cfg.w_similarity))
    clean = (F.col("wer") <= pairs.max_wer) & (F.col("duration_sec") >= F.col("low")) & (F.col("duration_sec") <= F.col("high")) & ~F.col("truncated") & ~F.col("empty")
    return df.withColumns({"raw_reward": parts - similarity + F.lit(0.0), "is_clean": F.coalesce(clean, F.lit(False))})


def written(df: DataFrame) -> DataFrame:
    """The columns as they are stored: rates, similarity and reward to 4 digits, bounds to 2."""
    return df.withColumns(
        {
            "wer": round_half_up(F.col("wer"), 4),
            "cer": round_half_up(F.col("cer"), 4),
            "dur_min": round_half_up(F.col("low"), 2),
            "dur_max": round_half_up(F.col("high"), 2),
            "sim": round_half_up(F.col("sim"), 4),
            "reward": round_half_up(F.col("raw_reward"), 4),
            "clean": F.col("is_clean"),
            "empty_asr": F.col("empty"),
        }
    ).drop("low", "high", "raw_reward", "is_clean", "empty")


def with_similarity(samples: DataFrame, voices: DataFrame, vector: str = "vector", speaker: str = "speaker", least_seconds: float = 0.2) -> DataFrame:
    """Adds ``sim``: cosine of a sample's vector with its speaker's reference vector.

    Null for clips that are too short, and for speakers without a reference. ``voices`` is
    the reference pool, one row per speaker.
    """
    refs = voices.select(F.col(speaker), F.col(vector).alias("_voice"))
    long_enough = F.col("duration_sec") >= least_seconds
    heavy, _ = heavy_hitters(samples, speaker)
    return skew_join(samples, refs, speaker, heavy, "left").withColumn("sim", F.when(long_enough, cosine(F.col(vector), F.col("_voice")))).drop("_voice")


def clean_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.count_if("clean").alias("n_clean"), F.avg(F.col("clean").cast("int")).alias("rate"))


def assemble(manifest: DataFrame, transcripts: DataFrame, similarities: DataFrame) -> DataFrame:
    """Every line of the manifest with its transcript and similarity, by ``(group_id, sample_idx)``.

    The three tables are joined by key, never by position. A sample without a transcript has
    a null one (its recognition failed), one without a similarity has none. The tables have one row a sample
    (see :func:`latest_lines`); lines without a key are out.
    """
    key = ["group_id", "sample_idx"]
    lines = manifest.where(F.col("group_id").isNotNull() & F.col("sample_idx").isNotNull())
    return lines.join(transcripts.select(*key, "transcript"), key, "left").join(similarities.select(*key, "sim"), key, "left")
