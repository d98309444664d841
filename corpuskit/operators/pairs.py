"""Preference pairs from scored groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.config import PairConfig
from corpuskit.functions.hashing import hash_key
from corpuskit.operators.ranking import global_position
from corpuskit.operators.skew import heavy_hitters, skew_join


def acceptable(cfg: PairConfig) -> Column:
    """Gate of a chosen sample, on the stored (rounded) columns; a null in it does not pass."""
    ok = (F.col("wer") <= cfg.max_wer) & ~F.col("empty_asr")
    if cfg.not_truncated:
        ok = ok & ~F.col("truncated")
    if cfg.duration_in_bounds:
        ok = ok & (F.col("duration_sec") >= F.col("dur_min")) & (F.col("duration_sec") <= F.col("dur_max"))
    return F.coalesce(ok, F.lit(False))


def _sides(scores: DataFrame, cfg: PairConfig) -> tuple[DataFrame, DataFrame]:
    """The k best acceptable and the k worst other samples of each group; ranks beyond the limit fall before the shuffle."""
    usable = scores.where(F.col("group_id").isNotNull() & F.col("reward").isNotNull() & ~F.isnan("reward"))
    reward = F.col("reward") + F.lit(0.0)
    good = Window.partitionBy("group_id").orderBy(reward.desc(), F.col("sample_idx").asc())
    bad = Window.partitionBy("group_id").orderBy(reward.asc(), F.col("sample_idx").desc())
    top = lambda df, w: df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cfg.max_pairs)
    return top(usable.where(acceptable(cfg)), good), top(usable.where(~acceptable(cfg)), bad)


def _matched(scores: DataFrame, cfg: PairConfig) -> DataFrame:
    good, bad = _sides(scores, cfg)
    chosen = good.select("group_id", "k", "uuid", "text", "category", "speaker", F.col("sample_idx").alias("chosen_idx"), F.col("n_frames").alias("chosen_n_frames"), F.col("truncated").alias("chosen_truncated"), F.col("reward").alias("reward_chosen"))
    rejected = bad.select("group_id", "k", F.col("sample_idx").alias("rejected_idx"), F.col("n_frames").alias("rejected_n_frames"), F.col("truncated").alias("rejected_truncated"), F.col("reward").alias("reward_rejected"))
    return chosen.join(rejected, ["group_id", "k"]).withColumn("_ok", F.col("reward_chosen") - F.col("reward_rejected") >= cfg.min_margin)


def mine_pairs(scores: DataFrame, cfg: PairConfig) -> DataFrame:
    """The k-th best acceptable sample of a group with its k-th worst other, while the margin suffices.

    Margins fall with k, so stopping at the first small one and dropping all small ones are
    the same. ``scores`` has one row per (group, sample). Samples without a reward are out.
    """
    return _matched(scores, cfg).where("_ok").drop("_ok", "k")


def pair_report(scores: DataFrame, cfg: PairConfig) -> DataFrame:
    """One row: groups, pairs, groups without an acceptable sample, groups that ran into a small margin."""
    per_group = scores.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.bool_or(acceptable(cfg) & F.col("reward").isNotNull() & ~F.isnan("reward")).alias("any"))
    groups = per_group.agg(F.count("*").alias("n_groups"), F.count_if(~F.coalesce("any", F.lit(False))).alias("n_no_chosen"))
    matched = _matched(scores, cfg).agg(F.count_if("_ok").alias("n_pairs"), F.count_distinct(F.when(~F.col("_ok"), F.col("group_id"))).alias("n_no_margin"))
    both = groups.unionByName(matched, allowMissingColumns=True)  # one row each
    return both.agg(*[F.sum(c).alias(c) for c in ("n_groups", "n_no_chosen", "n_pairs", "n_no_margin")])


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    """``category, n``; null and empty are ``?``."""
    return df.groupBy(F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("?")).alias("category")).agg(F.count("*").alias("n"))


def pair_sides(pairs: DataFrame) -> DataFrame:
    """Two rows per pair, ``pair_id, side, group_id, sample_idx, n_frames, truncated, reward``, for lookups by sample."""
    identity = F.concat_ws("|", "group_id", "chosen_idx", "rejected_idx")
    side = lambda name: F.struct(
        F.lit(name).alias("side"),
        F.col(f"{name}_idx").alias("sample_idx"),
        F.col(f"{name}_n_frames").alias("n_frames"),
        F.col(f"{name}_truncated").alias("truncated"),
        F.col(f"reward_{name}").alias("reward"),
    )
    return pairs.select(identity.alias("pair_id"), "group_id", F.explode(F.array(side("chosen"), side("rejected"))).alias("s")).select("pair_id", "group_id", "s.*")


def attach_samples(sides: DataFrame, tokens: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Tokens of each side by (group, sample), and the prefix of its speaker if given; sides without tokens are out."""
    out = sides.join(tokens, ["group_id", "sample_idx"])
    return out if prefixes is None else skew_join(out, prefixes, "speaker", heavy_hitters(out, "speaker")[0])


def pair_batches(pairs: DataFrame, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """``batch_id, slot`` of every pair in the epoch's own shuffle; the last batch may be short."""
    identity = ["group_id", "chosen_idx", "rejected_idx"]
    placed = global_position(pairs.select(*identity), [hash_key(f"{seed}:{epoch}", *identity), *identity], "_at")
    return placed.select(*identity, F.floor(F.col("_at") / size).alias("batch_id"), (F.col("_at") % size).cast("int").alias("slot"))


def wanted_samples(pairs: DataFrame) -> DataFrame:
    """``group_id, sample_idx``: the samples that are a side of a pair, each once."""
    return pairs.select("group_id", F.explode(F.array("chosen_idx", "rejected_idx")).alias("sample_idx")).distinct()


def training_pairs(pairs: DataFrame, tokens: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One row per pair with the tokens of both sides and the speaker's prefix; pairs that lack any of them are out.

    Sides are looked up as two rows per pair and brought together again by pair.
    ``tokens`` has one row per (group, sample), ``prefixes`` one per speaker. Tokens are the
    wide part: they come after the prefixes, and are never broadcast, as an array counts as
    one value where Spark estimates the size of a table.
    """
    identity = ["group_id", "chosen_idx", "rejected_idx"]
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_idx").alias("sample_idx"))
    told = skew_join(pairs.select(*identity, "speaker"), prefixes.select("speaker", "prefix"), "speaker", heavy_hitters(pairs, "speaker")[0])
    sides = told.select(*identity, "prefix", F.explode(F.array(side("chosen"), side("rejected"))).alias("s")).select(*identity, "prefix", "s.*")
    found = attach_samples(sides, tokens.select("group_id", "sample_idx", "tokens").hint("merge"))
    both = [F.max(F.when(F.col("side") == name, F.col("tokens"))).alias(f"{name}_tokens") for name in ("chosen", "rejected")]
    whole = found.groupBy(*identity).agg(F.first("prefix").alias("prefix"), *both)
    return whole.where(F.col("chosen_tokens").isNotNull() & F.col("rejected_tokens").isNotNull())
