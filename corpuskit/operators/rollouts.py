"""Fan-out of seed texts to generation groups, sharding, resuming and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import RewardConfig, RolloutConfig
from corpuskit.functions.hashing import hash01
from corpuskit.functions.text import frame_cap
from corpuskit.operators.ranking import global_position
from corpuskit.operators.skew import skew_join

#: Stands for "no speaker" in rollouts; not the sentinel of prepared tables.
NULL_ROLLOUT = "__null__"


def without_holdouts(speakers: DataFrame, holdouts: DataFrame, column: str = "speaker") -> DataFrame:
    """Speakers that are not held out; null names stay unless null is held out."""
    left, right = speakers.alias("a"), holdouts.select(F.col(column).alias("_held")).distinct().alias("b")
    return left.join(right, F.col(f"a.{column}").eqNullSafe(F.col("b._held")), "left_anti")


def fan_out(seeds: DataFrame, speakers: DataFrame, cfg: RolloutConfig, shards: int = 1) -> DataFrame:
    """``gi, group_id, id, uuid, text, category, slot, speaker, shard``: every text with several speakers.

    Slot k of text id takes the null speaker with a fixed probability (a hash of seed, id and
    slot), else speaker number (id + k) mod n in the order of their names. ``speakers`` is the
    reference pool, one row per voice with its audio elsewhere; its size is the configured
    pool's, not the data's. ``gi`` enumerates (text in id order, slot).
    """
    cfg.validate()
    pool = global_position(speakers.select("speaker").where(F.col("speaker").isNotNull()).distinct(), ["speaker"], "_at")
    n = pool.count()
    texts = global_position(seeds.select("id", "uuid", "text", "category"), ["id", "uuid"], "_text")
    slots = texts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(cfg.speakers_per_text - 1))))
    is_null = (hash01(cfg.seed, "id", "slot") < F.lit(cfg.null_probability)) if n else F.lit(True)
    drawn = slots.withColumn("_at", F.when(~is_null, F.pmod(F.col("id").cast("bigint") + F.col("slot"), F.lit(max(n, 1)))))
    named = skew_join(drawn, pool, "_at", [], "left").withColumn("speaker", F.coalesce("speaker", F.lit(NULL_ROLLOUT)))
    group = F.concat(F.substring("uuid", 1, 8), F.lit("__"), F.col("speaker"), F.lit("__s"), F.col("slot"))
    gi = F.col("_text") * cfg.speakers_per_text + F.col("slot")
    return named.select(gi.alias("gi"), group.alias("group_id"), "id", "uuid", "text", "category", "slot", "speaker", F.pmod(gi, F.lit(shards)).cast("int").alias("shard"))


def with_frame_cap(groups: DataFrame, reward: RewardConfig, rollout: RolloutConfig, frame_rate: float) -> DataFrame:
    return groups.withColumn("max_frames", frame_cap(F.col("text"), reward, rollout, frame_rate))


def shard_groups(groups: DataFrame, shard: int, shards: int, limit: int | None = None) -> DataFrame:
    """The groups of one shard, after ``limit``, if given, has kept the first groups of all shards."""
    if limit is not None:
        groups = groups.orderBy("gi").limit(limit)
    return groups.where(F.pmod(F.col("gi"), F.lit(shards)) == shard)


def unfinished(groups: DataFrame, manifest: DataFrame, samples: int) -> DataFrame:
    """Groups without all their manifest lines; repeated lines of a sample count once.

    A group whose output broke off is run again, which testing for the first file of it would miss.
    """
    done = manifest.select("group_id", "sample_idx").distinct().groupBy("group_id").count().where(F.col("count") >= samples)
    return groups.join(done, "group_id", "left_anti")


def shard_progress(lines: DataFrame, samples: int, shard: str = "shard") -> DataFrame:
    """``shard, n_lines, n_groups_done`` by line counts."""
    return lines.groupBy(shard).agg(F.count("*").alias("n_lines")).withColumn("n_groups_done", F.floor(F.col("n_lines") / samples))


def shard_totals(n_groups: int, shards: int) -> list[int]:
    """Groups of each shard when group g goes to shard g mod shards."""
    return [n_groups // shards + (i < n_groups % shards) for i in range(shards)]
