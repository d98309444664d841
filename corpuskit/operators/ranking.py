"""Ranks and running sums inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.skew import heavy_hitters, skew_join
from corpuskit.session import materialize


def hash_running_sum(df: DataFrame, keys: Sequence[str], identity: Sequence[str], value: Column | str, seed: int = 0, buckets: int = 2048, out: str = "running") -> DataFrame:
    """Sum of ``value`` over the rows of a group up to and with each row, in the order of a hash of ``identity``.

    Each group is cut into ``buckets`` parts by the hash; a row's sum is that inside its
    part plus those of the parts before. One shuffle of the rows, by group and part; the
    parts' sums are at most ``buckets`` small rows a group. Rows equal in ``identity`` come
    in an undefined order. Null keys form a group, null values count as 0.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    amount = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    # keys that are never null: the join back then uses the partitioning of the window
    names = [f"_k{i}" for i in range(len(keys))]
    whole = {n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for n, k in zip(names, keys)}
    part = df.withColumns({"_h": h, "_a": amount, **whole}).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 40).cast("int") % buckets)
    part = part.repartition(*names, "_b")
    # the parts follow each other by number, the rows of a part by the whole hash
    inside = Window.partitionBy(*names, "_b").orderBy("_h", *identity).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*names, "_b").agg(F.sum("_a").alias("_t"))
    offsets = sums.select(*names, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    summed = part.withColumn("_r", F.sum("_a").over(inside))
    return summed.join(offsets, [*names, "_b"]).withColumn(out, F.col("_r") + F.col("_o")).select(*df.columns, out)


def hash_rank(df: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: int = 0, buckets: int = 2048, out: str = "rank") -> DataFrame:
    """0-based rank of each row inside its group, in the order of a hash of ``identity``; see :func:`hash_running_sum`."""
    return hash_running_sum(df, keys, identity, F.lit(1).cast("bigint"), seed, buckets, out).withColumn(out, (F.col(out) - 1).cast("bigint"))


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows in total order, written with the number of their range partition and their place in it."""
    placed = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    return placed.withColumn("_p", F.shiftright("_m", 33))


def _starts(placed: DataFrame, amount: Column) -> DataFrame:
    """What the partitions before each partition add up to; the driver receives one row a partition."""
    rows, total = [], 0
    for r in sorted(placed.groupBy("_p").agg(amount.alias("n")).collect()):
        rows.append((r["_p"], total))
        total += r["n"]
    return F.broadcast(placed.sparkSession.createDataFrame(rows, "_p bigint, _s bigint"))


def global_position(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """0-based position of every row in the total order ``order``: one range sort, no single-partition window."""
    placed = _placed(df, order)
    at = F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return placed.join(_starts(placed, F.count("*")), "_p").withColumn(out, at).select(*df.columns, out)


def global_running_sum(df: DataFrame, order: Sequence[Column | str], value: str, out: str = "running") -> DataFrame:
    """Sum of the integer ``value`` over all rows up to and with each row in the total order ``order``."""
    placed = _placed(df, order)
    inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_r", F.sum(value).over(inside))
    return summed.join(_starts(placed, F.coalesce(F.sum(value), F.lit(0))), "_p").withColumn(out, F.col("_s") + F.col("_r")).select(*df.columns, out)


def ordered_rank(df: DataFrame, key: str, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """0-based rank of each row among the rows with its ``key``, in the order ``order``.

    The rows are range-sorted by key and order, so a large group lies in many partitions; a
    row's rank is its position less the first position of its key. Null keys form a group.
    """
    tagged = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")))
    placed = global_position(tagged, ["_key", *order], "_at")
    firsts = placed.groupBy("_key").agg(F.min("_at").alias("_first"))
    heavy, _ = heavy_hitters(placed, "_key")
    return skew_join(placed, firsts, "_key", heavy).withColumn(out, F.col("_at") - F.col("_first")).select(*df.columns, out)
