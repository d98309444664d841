"""Deterministic randomness: every draw is a hash of a seed and a row's key.

The result depends neither on partitioning nor on task order, and any SQL engine with md5
can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int | str, *parts: ColumnLike) -> Column:
    """32 hex digits of md5('seed:part:part'); null parts count as the word ``null``."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def hash_int(seed: int | str, *parts: ColumnLike) -> Column:
    """The first 32 bits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def hash01(seed: int | str, *parts: ColumnLike) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, *parts).cast("double") / F.lit(4294967296.0)


def pick_index(n: ColumnLike, seed: int | str, *parts: ColumnLike) -> Column:
    """Uniform index in [0, n); null where n is not positive."""
    size = _col(n).cast("bigint")
    return F.when(size > 0, F.pmod(hash_int(seed, *parts), size))
