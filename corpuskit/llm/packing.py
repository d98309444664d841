"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ranking import hash_rank
from corpuskit.session import materialize


def pieces(items: DataFrame, identity: Sequence[str], length: str, capacity: int) -> DataFrame:
    """``identity, length, n_pieces, piece, piece_length``: items longer than a container are cut, others stay whole.

    Repeated rows of an item are one item, with its greatest known length. Items whose
    length is null or negative are no items. A long item gives full pieces and one
    remainder, if any. An item of length 0 is a piece of length 0.
    """
    once = items.where(F.col(length).isNotNull() & (F.col(length) >= 0)).groupBy(*identity).agg(F.max(length).cast("bigint").alias("length"))
    count = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("length") / F.lit(capacity)).cast("bigint"))
    cut = once.withColumn("n_pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
    return cut.withColumn("piece_length", F.least(F.lit(capacity).cast("bigint"), F.col("length") - F.col("piece") * capacity))


def length_histogram(parts: DataFrame) -> dict[int, int]:
    """Number of pieces by length; at most ``capacity + 1`` rows reach the driver."""
    return {int(r["piece_length"]): int(r["count"]) for r in parts.groupBy("piece_length").count().collect()}


def optimal_buckets(histogram: Mapping[int, int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` length buckets with the least total padding.

    Dynamic programming over the distinct lengths: padding of a bucket is its item count
    times its longest length, less the summed lengths.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    c, f = np.concatenate(([0.0], np.cumsum(counts))), np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = np.full(len(lengths) + 1, np.inf)
    best[0] = 0.0
    choice: list[np.ndarray] = []
    for _ in range(min(n_buckets, len(lengths))):
        # cost[j, i]: the first i lengths are in earlier buckets, this one holds lengths i..j-1
        cost = best[None, :-1] + (c[1:, None] - c[None, :-1]) * lengths[:, None] - (f[1:, None] - f[None, :-1])
        cost = np.where(np.tri(len(lengths), dtype=bool), cost, np.inf)
        pick = cost.argmin(1)
        choice.append(pick)
        best = np.concatenate(([0.0], cost[np.arange(len(lengths)), pick]))
    bounds, j = [], len(lengths)
    for pick in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(pick[j - 1])
    return sorted(bounds)


def best_fit_patterns(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram, whole groups of equal containers at a time.

    Returns rows ``(length, first_rank, last_rank + 1, per_container, first_container)``:
    the items of that length with these ranks go ``per_container`` at a time into
    consecutive containers. The containers are numbered from 0. The work depends on the
    number of distinct lengths, not of items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    free: list[tuple[int, int, int]] = []  # (room, first container, number of containers), sorted
    n_containers = 0
    for length in sorted((k for k in histogram if histogram[k] > 0), reverse=True):
        left, rank = histogram[length], 0
        size = max(1, length)
        while left:
            at = bisect_left(free, (size, -1, -1))
            if at < len(free):
                room, first, many = free.pop(at)
            else:
                room, first = capacity, n_containers
                many = -(-left // max(1, room // size))
                n_containers += many
            per = max(1, room // size)
            full = min(many, left // per)
            if full:
                rows.append((length, rank, rank + full * per, per, first))
                insort(free, (max(0, room - per * size), first, full))
                rank, left = rank + full * per, left - full * per
            rest_first, rest = first + full, many - full
            if rest and left:
                # fewer than per items are left: they share the next container
                rows.append((length, rank, rank + left, left, rest_first))
                insort(free, (room - left * size, rest_first, 1))
                rank, left = rank + left, 0
                rest_first, rest = rest_first + 1, rest - 1
            if rest:
                insort(free, (room, rest_first, rest))
    return rows


def _placed(parts: DataFrame, identity: Sequence[str], slots: Sequence[tuple], seed: int) -> DataFrame:
    """Pieces with ``_name`` and the ``_number`` of their container, by their hash rank among the pieces of their length.

    ``slots`` has a few rows ``name, length, first rank, last rank + 1, per container, first
    container`` for each distinct length, so its size is bounded by the capacity.
    """
    table = parts.sparkSession.createDataFrame(slots, "_name string, _l bigint, _from bigint, _to bigint, _per bigint, _first bigint")
    ranked = hash_rank(parts, ["piece_length"], [*identity, "piece"], seed, out="_rank")
    hit = (F.col("piece_length") == F.col("_l")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(table), hit)
    return placed.withColumn("_number", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_per")))


def bucket_containers(parts: DataFrame, identity: Sequence[str], capacity: int, n_buckets: int = 32, seed: int = 0) -> DataFrame:
    """Token-budget batches inside optimal length buckets; adds ``container`` (string).

    The batches of a bucket take pieces by their exact lengths up to the capacity, the best
    fit first, and never from another bucket. Both the buckets and the batches come from
    the histogram, so no bucket is gathered anywhere.
    """
    parts = materialize(parts)
    histogram = length_histogram(parts)
    slots, lower = [], -1
    for bound in optimal_buckets({max(1, k): v for k, v in histogram.items()}, n_buckets):
        own = {k: n for k, n in histogram.items() if lower < k <= bound}
        slots += [(str(bound), *row) for row in best_fit_patterns(own, capacity)]
        lower = bound
    placed = _placed(parts, identity, slots, seed)
    return placed.withColumn("container", F.concat_ws("-", "_name", "_number")).select(*parts.columns, "container")


def pattern_containers(parts: DataFrame, identity: Sequence[str], capacity: int, seed: int = 0) -> DataFrame:
    """Best-fit decreasing packing of all pieces; adds ``container`` (bigint).

    The driver packs the histogram (at most ``capacity + 1`` lengths); each piece finds its
    container by its hash rank among the pieces of its length.
    """
    parts = materialize(parts)
    slots = [("", *row) for row in best_fit_patterns(length_histogram(parts), capacity)]
    return _placed(parts, identity, slots, seed).withColumn("container", F.col("_number")).select(*parts.columns, "container")
