"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.skew import heavy_hitters, skew_join
from corpuskit.session import materialize


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")


def _least_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task to (vertex, component) by union-find; the component is its least vertex."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    members = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array([find(x) for x in members], pa.int64())], ["v", "to"])


def connected_components(edges: DataFrame, max_rounds: int = 100, finish_below: int = 50_000) -> DataFrame:
    """``v, component`` for every vertex that occurs in ``edges (a bigint, b bigint)``.

    Each round orders the vertices by a fresh hash; every vertex points to the first vertex
    of its closed neighbourhood, the edges are drawn between these representatives, and
    loops and repeats go. A constant share of the vertices vanishes each round, so all
    rounds together cost a small multiple of the first, and the number of rounds is
    logarithmic. The pointers of the rounds, joined from the last to the first, give the
    component, which is named by its least vertex however it was found.

    The first vertex of a neighbourhood is a minimum, combined before the shuffle; a vertex
    with a large share of all edges is joined by :func:`skew_join`. Rounds are cut by
    written tables. Once no more than ``finish_below`` edges are left, whose number is known
    from the table, one task finishes them, as the last rounds would be nothing but overhead.
    """
    rest = materialize(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointers: list[DataFrame] = []
    for number in range(max_rounds):
        n_edges = rest.count()
        if not n_edges:
            break
        if n_edges <= finish_below:
            pointers.append(materialize(rest.coalesce(1).mapInArrow(_least_members, "v bigint, to bigint")))
            break
        nearest = _ends(rest).groupBy("v").agg(F.min(F.struct(F.xxhash64(F.lit(number), F.col("w")).alias("h"), F.col("w").alias("x"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(number), F.col("v")).alias("h"), F.col("v").alias("x"))
        pointer = materialize(nearest.select("v", F.least("m", own).getField("x").alias("to")))
        pointers.append(pointer)
        heavy, _ = heavy_hitters(_ends(rest), "v")
        step = pointer
        one = skew_join(rest.withColumnRenamed("a", "v"), step, "v", heavy).select(F.col("to").alias("a"), F.col("b").alias("v"))
        two = skew_join(one, step, "v", heavy).select("a", F.col("to").alias("b"))
        rest = materialize(two.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    if not pointers:
        return edges.sparkSession.createDataFrame([], "v bigint, component bigint")

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        # in a star or a giant component most pointers share one target
        target = later.select(F.col("v").alias("to"), F.col("component"))
        heavy, _ = heavy_hitters(earlier, "to")
        return materialize(skew_join(earlier, target, "to", heavy, "left").select("v", F.coalesce("component", "to").alias("component")))

    found = reduce(compose, reversed(pointers[:-1]), pointers[-1].select("v", F.col("to").alias("component")))
    least = found.groupBy("component").agg(F.min("v").alias("least"))
    heavy, _ = heavy_hitters(found, "component")
    return skew_join(found, least, "component", heavy).select("v", F.col("least").alias("component"))
