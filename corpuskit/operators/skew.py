"""Keys that own most rows: finding them, and joining and aggregating in spite of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import shuffle_width

#: A mergeable sketch keeps this many counters; its error is at most about 3.5 / SKETCH_SIZE of
#: all rows, so no key with more than that share can be missed.
SKETCH_SIZE = 8192


def heavy_share(spark: SparkSession) -> float:
    """Share of all rows from which a key is heavy: a quarter of an average shuffle partition, from 0.1 % to 2 %."""
    return min(0.02, max(0.001, 0.25 / shuffle_width(spark)))


def heavy_hitters(df: DataFrame, key: str, min_share: float | None = None, sketch_size: int = SKETCH_SIZE) -> tuple[list, int]:
    """Keys that may own at least ``min_share`` (default: :func:`heavy_share`) of the rows with a non-null key, and the number of those rows.

    One scan with a frequent-items sketch, merged map-side; the driver receives at most
    ``1 / min_share`` keys plus those within the sketch's error. There are no false
    negatives as long as ``min_share`` is above the sketch's error (checked); false
    positives are harmless because callers count exactly. An empty table gives ``([], 0)``.
    """
    min_share = heavy_share(df.sparkSession) if min_share is None else min_share
    error = 3.5 / sketch_size
    if not error < min_share <= 1:
        raise ValueError(f"min_share must lie in ({error:.5f}, 1]")
    k = min(int(1 / (min_share - error)) + 1, sketch_size // 2)
    known = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    row = known.agg(F.expr(f"approx_top_k(k, {k}, {sketch_size})").alias("top"), F.count("*").alias("n")).first()
    floor = (min_share - error) * row["n"]
    return sorted(x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] >= floor), row["n"]


def heavy_frame(df: DataFrame, key: str, keys: list) -> DataFrame:
    """The heavy keys as a one-column DataFrame of the key's own type; at most ``1 / min_share`` rows."""
    field = df.schema[key]
    return df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` {field.dataType.simpleString()}")


def salt_of(*identity: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int")


def per_key_records(df: DataFrame, key: str, record: str, measure: str, min_share: float | None = None, salts: int = 64) -> DataFrame:
    """Per key: delivered rows, distinct records, and sum and maximum of a measure over distinct records.

    Columns: ``<key>, n_rows, n_records, total, longest, n_all``, the last being the number of
    rows of all keys together. A record delivered more
    than once counts once, with the largest measure of its deliveries; a null measure adds
    nothing (``total`` 0 and ``longest`` null if all are null); rows without a key form no
    key, rows without a record id count in ``n_rows`` only.

    Heavy keys, found by :func:`heavy_hitters`, are picked out by a broadcast join and their
    rows spread over ``salts`` subgroups by the record's hash: a record lies wholly in one
    subgroup, so the distinct counts of the subgroups add up. All other keys go through one
    ordinary shuffle by key. The union has each key once.
    """
    known = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(record).alias("_rec"), F.col(measure).alias("_m"))
    keys, n_all = heavy_hitters(df, key, min_share)
    heavy_keys = F.broadcast(heavy_frame(known, key, keys))

    def finish(grouped) -> DataFrame:
        return grouped.agg(
            F.sum("n").alias("n_rows"),
            F.count("_rec").alias("n_records"),
            F.coalesce(F.sum(F.when(F.col("_rec").isNotNull(), F.col("m"))), F.lit(0)).alias("total"),
            F.max(F.when(F.col("_rec").isNotNull(), F.col("m"))).alias("longest"),
        )

    once = (F.count("*").alias("n"), F.max("_m").alias("m"))
    heavy = known.join(heavy_keys, key).withColumn("_salt", salt_of("_rec", salts=salts)).repartition(key, "_salt")
    heavy = finish(heavy.groupBy(key, "_salt", "_rec").agg(*once).groupBy(key, "_salt"))
    heavy = heavy.groupBy(key).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"), F.sum("total").alias("total"), F.max("longest").alias("longest"))
    light = known.join(heavy_keys, key, "left_anti").repartition(key)
    light = finish(light.groupBy(key, "_rec").agg(*once).groupBy(key))
    return heavy.unionByName(light).withColumn("n_all", F.lit(n_all).cast("bigint"))


def skew_join(big: DataFrame, small: DataFrame, key: str, heavy: Sequence, how: str = "inner") -> DataFrame:
    """Equi-join in which the rows of ``big`` with a heavy key are not gathered in one task.

    ``small`` has at most one row per key. Its rows of the heavy keys (at most as many as
    ``heavy`` has, which :func:`heavy_hitters` bounds) are broadcast; the rest is joined by
    an ordinary shuffle. ``how`` is inner or left; null keys match nothing and stay out of
    the shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = heavy_frame(big, key, list(heavy))
    few = F.broadcast(small.join(F.broadcast(keys), key, "left_semi"))
    is_heavy = F.col(key).isin(*heavy) if len(heavy) else F.lit(False)
    out = big.where(is_heavy).join(few, key, how).unionByName(big.where(F.col(key).isNotNull() & ~is_heavy).join(small, key, how))
    if how == "left":
        missing = big.where(F.col(key).isNull())
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name != key]
        out = out.unionByName(missing.select(key, *[c for c in big.columns if c != key], *extra))
    return out


def sized_join(big: DataFrame, small: DataFrame, key: str, limit_bytes: int = 32 << 20) -> DataFrame:
    """Inner join that broadcasts ``small`` only if its measured size allows.

    ``small`` is a written table of fixed-width columns with one row per key; its row count
    comes from the file footers. Above ``limit_bytes`` the join is :func:`skew_join`.
    """
    width = sum(4 if t in ("int", "float") else 8 for _, t in small.dtypes) + 16
    if small.count() * width <= limit_bytes:
        return big.join(F.broadcast(small), key)
    heavy, _ = heavy_hitters(big, key)
    return skew_join(big, small, key, heavy)
