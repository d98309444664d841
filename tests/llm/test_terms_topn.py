import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuskit.llm.terms import mark_terms, term_frequencies
from corpuskit.llm.topn import top_n_per_group


@pytest.mark.parametrize("parts", [1, 5])
def test_frequencies_against_brute_force(spark, parts):
    rows = [(f"t{i % 7 if i % 3 else 0}", i % 11 if i % 5 else None, f"d{i % 4}") for i in range(900)] + [(None, 1, "d"), ("once", None, None), ("", 3, "d")]
    df = spark.createDataFrame(rows, "term string, rec int, doc string").repartition(parts).withColumn("kind", F.lit("clash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["term"]: (r["occurrences"], r["recs"], r["docs"]) for r in term_frequencies(df, "term", {"recs": "rec", "docs": "doc"}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, recs, docs = defaultdict(int), defaultdict(set), defaultdict(set)
    for t, r, d in rows:
        if t is not None:
            n[t] += 1
            recs[t] |= {r} - {None}
            docs[t] |= {d} - {None}
    assert got == {t: (n[t], len(recs[t]), len(docs[t])) for t in n}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_hot_pair_lies_in_many_partitions(spark, adaptive):
    rows = [("hot", 7)] * 4000 + [("hot", None)] * 3000 + [("hot", i) for i in range(5, 9)] + [(f"t{i % 50}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "term string, rec int").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r["term"]: (r["occurrences"], r["recs"]) for r in term_frequencies(df, "term", {"recs": "rec"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {"hot": (7004, 4)} | {f"t{i}": (10, 10) for i in range(50)}


def test_empty_and_marks(spark):
    empty = spark.createDataFrame([], "term string, rec int")
    assert term_frequencies(empty, "term", {"recs": "rec"}).count() == 0
    df = spark.createDataFrame([("a", 1, 1), ("b", 3, 30)], "term string, x int, y int")
    marks = {r["term"]: (r["is_rare"], r["is_common"]) for r in mark_terms(df, ("x", 3), ("y", 100, 0.2)).collect()}
    assert marks == {"a": (True, False), "b": (False, True)}


def test_long_terms(spark):
    df = spark.createDataFrame([("x" * 300_000, 1), ("x" * 300_000, 2), ("x" * 299_999, 1)], "term string, rec int")
    assert sorted((len(r["term"]), r["recs"]) for r in term_frequencies(df, "term", {"recs": "rec"}).collect()) == [(299_999, 1), (300_000, 2)]


def test_top_n_rules(spark):
    rows = [
        ("g", 0, 1.0, 1), ("g", 0, 9.0, 2), ("g", 0, 9.0, 2),  # the latest line counts, repeats do not
        ("g", 1, 0.0, 1), ("g", 2, -0.0, 1), ("g", 3, math.nan, 1), ("g", 4, None, 1), ("g", 5, 8.0, 1), ("g", 5, None, 3),
        ("h", 1, -1.0, None), ("h", 1, -5.0, 0), (None, 1, 1.0, 1), ("h", None, 1.0, 1), ("n", 1, math.nan, 1),
    ]
    df = spark.createDataFrame(rows, "g string, i int, s double, at int").withColumns({"rank": F.lit(1), "_g": F.lit("x"), "_salt": F.lit(7)})
    got = [tuple(r) for r in top_n_per_group(df, "g", "i", "s", 3, "at").orderBy("g", "rank").collect()]
    assert got == [("g", 0, 9.0, 1), ("g", 1, 0.0, 2), ("g", 2, 0.0, 3), ("h", 1, -5.0, 1)]
    assert all(math.copysign(1, r[2]) == 1 for r in got if r[2] == 0)


def test_top_n_in_a_large_group_with_ties(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("s"))
    got = defaultdict(list)
    for r in top_n_per_group(df, "g", "i", "s", 4, salts=8).orderBy("g", "rank").collect():
        got[r["g"]].append(r["i"])
    want = defaultdict(list)
    for i in sorted(range(20_000), key=lambda i: (-(i % 5), i)):
        g = "hot" if i % 3 == 0 else f"g{i % 50}"
        if len(want[g]) < 4:
            want[g].append(i)
    assert got == want


def test_top_n_of_nothing(spark):
    assert top_n_per_group(spark.createDataFrame([], "g string, i int, s double"), "g", "i", "s", 3).count() == 0
