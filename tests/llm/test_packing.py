import math
from collections import defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskit.llm.packing import best_fit_patterns, bucket_containers, optimal_buckets, pattern_containers, pieces

histograms = st.dictionaries(st.integers(0, 100), st.integers(1, 60), max_size=12)


@settings(max_examples=150, deadline=None)
@given(histograms)
def test_patterns_hold_every_item_once_and_fit(histogram):
    rows = best_fit_patterns(histogram, 100)
    load, ranks = defaultdict(int), defaultdict(list)
    for length, lo, hi, per, first in rows:
        for r in range(lo, hi):
            load[first + (r - lo) // per] += max(1, length)
            ranks[length].append(r)
    assert all(sorted(ranks[k]) == list(range(n)) for k, n in histogram.items())
    assert all(v <= 100 for v in load.values()) and set(load) == set(range(len(load)))
    # any-fit bound: on average containers are more than half full
    total = sum(max(1, k) * n for k, n in histogram.items())
    assert len(load) <= 2 * total / 100 + 1


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), min_size=1, max_size=7), st.integers(1, 4))
def test_buckets_are_optimal(histogram, k):
    lengths = sorted(histogram)

    def padding(bounds):
        return sum((min(b for b in bounds if b >= x) - x) * n for x, n in histogram.items())

    best = min(padding([*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1], min(r, len(lengths) - 1)))
    got = optimal_buckets(histogram, k)
    assert len(got) <= k and padding(got) == best


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b int, frames bigint").withColumns({"piece": F.lit(99), "container": F.lit("x"), "_rank": F.lit(0)})


def test_pieces_nulls_repeats_and_cuts(spark):
    df = frame(spark, [("x", 1, 2500), ("x", 1, 2500), ("y", 1, None), ("z", 1, 1024), ("z", 2, 2048), ("n", 1, None), ("n", 1, 5), ("o", 1, 0), ("m", 1, -4)])
    got = sorted((r["a"], r["b"], r["piece"], r["piece_length"]) for r in pieces(df, ["a", "b"], "frames", 1024).collect())
    assert got == [("n", 1, 0, 5), ("o", 1, 0, 0), ("x", 1, 0, 1024), ("x", 1, 1, 1024), ("x", 1, 2, 452), ("z", 1, 0, 1024), ("z", 2, 0, 1024), ("z", 2, 1, 1024)]


def test_containers_fit_and_lose_nothing(spark):
    rows = [(f"g{i}", i % 3, 300 if i % 3 == 0 else (i * 37) % 1500) for i in range(2000)]
    parts = pieces(frame(spark, rows), ["a", "b"], "frames", 1024)
    n, total = parts.agg(F.count("*"), F.sum("piece_length")).first()
    used = {}
    for pack in (pattern_containers, bucket_containers):
        packed = pack(parts, ["a", "b"], 1024).cache()
        assert packed.count() == n and packed.select("a", "b", "piece").distinct().count() == n
        loads = packed.groupBy("container").agg(F.sum("piece_length").alias("n")).collect()
        assert max(r["n"] for r in loads) <= 1024
        used[pack] = len(loads)
    assert used[pattern_containers] <= 1.02 * math.ceil(total / 1024) + 1 <= used[bucket_containers]


def test_nothing_to_pack(spark):
    parts = pieces(frame(spark, []), ["a", "b"], "frames", 1024)
    assert pattern_containers(parts, ["a", "b"], 1024).count() == 0
    assert bucket_containers(parts, ["a", "b"], 1024).count() == 0
