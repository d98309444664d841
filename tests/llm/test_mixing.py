import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskit.llm.mixing import Target, fair_finish, weighted_mix
from corpuskit.llm.tokens import count_tokens, load_encoder, TOKENIZER, with_token_counts

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, src string, n bigint").withColumns({"size": F.lit(3), "copy": F.lit("x"), "source": F.lit("clash"), "key": F.lit(0)})


def test_fair_time_fills_the_budget():
    ts = [Target("a", 0.5, 2, 10), Target("b", 0.3, 1, 100), Target("c", 0.2, 3, 5)]
    v = fair_finish(ts, 90)
    assert abs(sum(min(t.share * v, t.most) for t in ts) - 90) < 1e-9


def test_shares_repeats_and_budget(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 12) for i in range(100)] + [(20_000 + i, "tiny", 9) for i in range(20)]
    rows += [(30_000, None, 50), (30_001, "unlisted", 50), (30_002, "big", None), (30_003, "small", 0)]
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 40), ("tiny", 0.2, 3), ("absent", 0.01, 2), ("big", 0.4, 1), (None, 0.1, 1)], TARGETS)
    mix, report = weighted_mix(docs(spark, rows), "id", "src", "n", targets)
    budget = sum(n or 0 for _, s, n in rows if s in ("big", "small", "tiny"))
    mix = mix.cache()
    used = {r["source"]: r for r in report.collect()}
    assert mix.agg(F.sum("size")).first()[0] == sum(r["used"] for r in used.values()) <= budget
    assert budget - sum(r["used"] for r in used.values()) <= 30
    assert mix.count() == mix.select("id", "copy").distinct().count()
    assert {r["source"]: r["n"] for r in mix.groupBy("source").agg((F.max("copy") + 1).alias("n")).collect()}["tiny"] == 3
    assert {s for s, r in used.items() if r["is_short"]} == {"tiny", "absent"}
    rest = used["big"]["used"] / used["small"]["used"]
    assert abs(rest - 0.5 / 0.3) < 0.02
    # the queues are fair at any point, not only at the end
    half = {r["source"]: r["n"] for r in mix.where(F.col("running") <= budget // 10).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert abs(half["big"] / half["small"] - 0.5 / 0.3) < 0.15


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mix, report = weighted_mix(docs(spark, []), "id", "src", "n", targets)
    assert mix.count() == 0 and [(r["used"], r["actual_share"], r["is_short"]) for r in report.collect()] == [(0, None, False)]
    mix, report = weighted_mix(docs(spark, [(1, "a", 5)]), "id", "src", "n", spark.createDataFrame([], TARGETS))
    assert mix.count() == 0 and report.count() == 0


def test_token_counts(spark):
    encoder = load_encoder(TOKENIZER)
    text = "Well, we spoke about 12 of them yesterday. " * 500
    assert count_tokens(encoder, None) == count_tokens(encoder, "") == 0
    assert abs(count_tokens(encoder, text) - len(encoder.encode_ordinary(text))) <= 6
    assert count_tokens(encoder, "a" * 100_000) > 0 and count_tokens(encoder, "<|endoftext|>") > 1
    df = spark.createDataFrame([(1, text[:43]), (2, None)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(df, "text").collect()}
    assert got == {1: len(encoder.encode_ordinary(text[:43])), 2: 0}


@pytest.mark.parametrize("parts", [1, 7])
def test_the_mixture_does_not_depend_on_partitions(spark, parts):
    rows = [(i, "ab"[i % 2], 5 + i % 3) for i in range(400)]
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 3)], TARGETS)
    mix, _ = weighted_mix(docs(spark, rows).repartition(parts), "id", "src", "n", targets)
    got = sorted((r["id"], r["copy"]) for r in mix.collect())
    test_the_mixture_does_not_depend_on_partitions.seen = getattr(test_the_mixture_does_not_depend_on_partitions, "seen", got)
    assert got == test_the_mixture_does_not_depend_on_partitions.seen


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé漢1 \n\t\u2003\x1c\u200b.!?")), min_size=1, max_size=40), st.integers(120, 200))
def test_long_texts_have_the_tokens_of_the_whole(part, times):
    encoder = load_encoder(TOKENIZER)
    text = (part + "x ") * times
    assert count_tokens(encoder, text) == len(encoder.encode_ordinary(text))


def test_long_runs():
    encoder = load_encoder(TOKENIZER)
    assert count_tokens(encoder, " " * 1_000_000 + "x") > 0 and count_tokens(encoder, "a" * 1_000_000) == len(encoder.encode_ordinary("a" * 1_000_000))
