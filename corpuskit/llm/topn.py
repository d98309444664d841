"""The N best items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, version: str | None = None, salts: int = 64) -> DataFrame:
    """``group, item, score, rank`` of the ``n`` highest scores in each group, the smaller item first among equals.

    Stage one hashes each group into ``salts`` subgroups by the item and keeps ``n`` rows of
    each; stage two ranks the survivors, at most ``n * salts`` a group. All rows of an item
    lie in one subgroup, so the one shuffle of stage one also serves to find the item's
    latest row by ``version``.

    Only an item's row with the greatest ``version`` counts (a null version is older than
    any other; among equal versions the greatest score counts, where null is least and NaN
    greatest); without ``version`` the greatest score does. Then null and NaN scores are
    out, and -0.0 equals 0.0. Rows without a group or item are out. Groups with fewer
    items give fewer rows.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("_g"), F.col(item).alias("_i"), (F.col(score) + F.lit(0.0)).alias("_s"), (F.col(version) if version else F.lit(0)).alias("_v")
    )
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)).cast("int")).repartition("_g", "_salt")
    latest = rows.groupBy("_g", "_salt", "_i").agg(F.max(F.struct("_v", "_s")).alias("_m")).select("_g", "_salt", "_i", F.col("_m._s").alias("_s"))
    valid = latest.where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    order = [F.col("_s").desc(), F.col("_i").asc()]
    survivors = valid.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order))).where(F.col("_r") <= n)
    ranked = survivors.withColumn("rank", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "rank")
