"""Reweighting by length: which rows to keep, and how often."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.config import KeepConfig
from corpuskit.functions.hashing import hash_key
from corpuskit.operators.ranking import global_position
from corpuskit.session import materialize


@dataclass(frozen=True)
class KeepPlan:
    n_rows: int
    n_short: int
    n_eligible: int
    n_tail: int
    n_long_kept: int


def plan_keep(lengths: DataFrame, cfg: KeepConfig, length: str = "orig_len") -> KeepPlan:
    """Counts that fix the mixture; one aggregate row reaches the driver. The target is rounded half to even."""
    short = F.col(length) < cfg.short_below
    row = lengths.agg(F.count("*").alias("n"), F.count_if(short).alias("s"), F.count_if(~short & (F.col(length) <= cfg.tail_cap)).alias("e"), F.count_if(~short & (F.col(length) > cfg.tail_cap)).alias("t")).first()
    wanted = round(row["n"] * cfg.fraction) - row["s"] * cfg.oversample
    return KeepPlan(row["n"], row["s"], row["e"], row["t"], min(max(0, wanted), row["e"]))


def keep_index(lengths: DataFrame, cfg: KeepConfig, row_id: str = "row_id", length: str = "orig_len") -> DataFrame:
    """``row_id, copy, orig_len``: every short row ``oversample`` times, and as many long ones as the target leaves.

    Long rows above ``tail_cap`` never stay; the others are drawn without replacement in the
    order of a hash, exactly as many as wanted, by a range-sorted position.
    """
    rows = materialize(lengths.select(F.col(row_id).alias("row_id"), F.col(length).alias("orig_len")))
    plan = plan_keep(rows, cfg)
    short = rows.where(F.col("orig_len") < cfg.short_below).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(cfg.oversample - 1))))
    pool = rows.where((F.col("orig_len") >= cfg.short_below) & (F.col("orig_len") <= cfg.tail_cap))
    drawn = global_position(pool, [hash_key(cfg.seed, "row_id"), "row_id"], "_at").where(F.col("_at") < plan.n_long_kept).drop("_at")
    return short.unionByName(drawn.withColumn("copy", F.lit(0))).select("row_id", "copy", "orig_len")


def keep_report(lengths: DataFrame, cfg: KeepConfig, length: str = "orig_len") -> DataFrame:
    plan = plan_keep(lengths, cfg, length)
    shorts = plan.n_short * cfg.oversample
    kept = shorts + plan.n_long_kept
    row = (plan.n_rows, plan.n_short, shorts, plan.n_eligible, plan.n_tail, plan.n_long_kept, kept, shorts / max(kept, 1))
    return lengths.sparkSession.createDataFrame([row], "n_rows bigint, n_short bigint, n_short_kept bigint, n_long_eligible bigint, n_tail_dropped bigint, n_long_kept bigint, n_kept bigint, short_share double")


def gather(table: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The rows of ``table`` named by the index, as often as it names them."""
    return table.join(index.select(F.col("row_id").alias(row_id), "copy"), row_id)


def sorted_index(index: DataFrame) -> DataFrame:
    """The index with ``position``, its rows in the order of ``row_id`` and copy."""
    return global_position(index, ["row_id", "copy"], "position")


def index_tag(cfg: KeepConfig) -> str:
    """Name of the mixture in the names of its files."""
    return f"short{cfg.short_below}_t{round(100 * cfg.fraction)}"
