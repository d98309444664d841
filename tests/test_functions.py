import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskit.config import CodecConfig, LayoutConfig, PreferenceConfig, RewardConfig, RolloutConfig, TokenConfig
from corpuskit.functions import codec, numeric, sequence, text
from corpuskit.functions.hashing import hash01, pick_index
from corpuskit.functions.speaker_ids import known_speaker, speaker_normal_form

LEVELS = (8, 7, 6, 6)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(xs, kind="int"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def test_unfold_golden(spark):
    got = one(spark, *codec.unfold(arr([0, 1, 7, 8, 1234, 2015]), LEVELS))
    assert [list(x) for x in zip(*got)] == [[0, 0, 0, 0], [1, 0, 0, 0], [7, 0, 0, 0], [0, 1, 0, 0], [2, 0, 4, 3], [7, 6, 5, 5]]


def test_fold_inverts_unfold_on_every_code_and_both_forms_agree(spark):
    cfg = CodecConfig(num_layers=1)
    df = spark.createDataFrame([(1, list(range(2016))), (2, []), (3, None)], "row_id int, nano_layer_1 array<int>")
    wide = df.select("row_id", *codec.channel_columns(cfg)).orderBy("row_id").collect()
    assert wide == codec.unfold_batches(df, cfg, keep=["row_id"]).orderBy("row_id").collect()
    back = df.select(codec.fold(codec.unfold(F.col("nano_layer_1"), LEVELS), LEVELS).alias("k")).collect()
    assert [r["k"] for r in back] == [list(range(2016)), [], None]


def test_dequantise_golden(spark):
    ends = [(8, 7), (7, 6), (6, 5)]
    got = one(spark, *[codec.dequantise(arr([0, hi]), n).alias(str(n)) for n, hi in ends])
    assert [[round(x, 4) for x in r] for r in got] == [[-1, 0.75], [-1, 1], [-1, 0.6667]]


def test_frame_bound():
    assert CodecConfig().max_frames(40.0) == 860 and CodecConfig().max_frames(40.0) / 21.5 <= 40 < 861 / 21.5
    assert list(CodecConfig(num_layers=1).heads().items())[:2] == [("level_audio_0", 8), ("level_audio_1", 7)]


def test_repeat_counts(spark):
    n = [0, 1, 2, 3, 5, 6, 12, 13, 40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n int").orderBy("i")
    assert [r[0] for r in df.select(text.repeat_count(F.col("n"), LayoutConfig())).collect()] == [1, 8, 8, 6, 4, 3, 2, 1, 1]
    assert {r[0] for r in df.select(text.repeat_count(F.col("n"), LayoutConfig(enabled=False))).collect()} == {1}


def test_layout_and_recovery(spark):
    t = TokenConfig(start_of_text=1, end_of_text=2, start_of_speech=3)
    laid = text.layout(arr([10, 11]), F.lit(2), t)
    assert list(one(spark, laid)[0]) == [1, 10, 11, 2, 1, 10, 11, 2, 3]
    df = spark.range(0, 25).crossJoin(spark.range(1, 9).withColumnRenamed("id", "r"))
    df = df.withColumn("ids", F.when(F.col("id") > 0, F.sequence(F.lit(10), F.col("id").cast("int") + 9)).otherwise(F.array().cast("array<int>")))
    assert df.where(text.original_length(text.layout(F.col("ids"), F.col("r").cast("int"), t), t) != F.col("id")).count() == 0


def test_labels_golden(spark):
    codes = sequence.with_last_twice(arr([5, 6]))
    n = F.lit(3)
    got = one(spark, codes, sequence.channel_labels(n, codes), sequence.stop_labels(n, F.size(codes)), sequence.attention_mask(n, F.size(codes)))
    assert [list(x) for x in got] == [[5, 6, 6], [-100, -100, -100, 5, 6, 6, -100], [-100, -100, -100, 0, 0, 0, 1], [1] * 7]
    assert list(one(spark, sequence.with_last_twice(arr([])))[0]) == []


def test_padding(spark):
    got = one(
        spark, sequence.left_padded(arr([1, 2]), F.lit(4), 9), sequence.right_padded(arr([1, 2]), F.lit(3), 0),
        sequence.rebased_labels(arr([-100, -100, 5, 6, -100]), F.lit(2), F.lit(3), F.lit(7)), sequence.padded_mask(F.lit(2), F.lit(3), F.lit(2), F.lit(4)),
        sequence.stacked([arr([1, 2, 3]), arr([4, 5])]),
    )
    assert [list(x) for x in got[:4]] == [[9, 9, 1, 2], [1, 2, 0], [-100, -100, -100, 5, 6, -100, -100], [0, 1, 1, 1, 1, 0, 0]]
    assert [list(r) for r in got[4]] == [[1, 4], [2, 5]]


def test_durations_and_caps(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate([0, 1, 3, 10, 40])], "i int, t string").orderBy("i")
    got = df.select(text.expected_seconds(F.col("t"), RewardConfig()).alias("s"), text.frame_cap(F.col("t"), RewardConfig(), RolloutConfig(), 21.5).alias("c")).collect()
    assert [round(r["s"], 6) for r in got] == [1.1, 1.1, 1.9, 4.7, 16.7] and [r["c"] for r in got] == [94, 94, 163, 300, 300]


def test_normal_form_words_and_stems(spark):
    got = one(spark, text.normalise(F.lit("  Don't —  STOP!\t(é)")), text.normalise(F.lit("?!")), text.word_count(F.lit(" a  b ")), text.file_stem(F.lit("a/b.c/voice.1.wav")), text.file_stem(F.lit(".hidden")))
    assert list(got) == ["don t stop é", "", 2, "voice.1", ".hidden"]


words = st.lists(st.sampled_from("a b c ab ü 東 x1".split()), max_size=7)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=40, max_size=40))
def test_edit_distance(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>").orderBy("i")
    assert [r[0] for r in df.select(text.edit_distance(F.col("a"), F.col("b"))).collect()] == [distance(a, b) for a, b in pairs]


def test_edit_distance_of_many_distinct_words(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda x: x.cast("string")).alias("a"))
    assert df.select(text.edit_distance(F.col("a"), F.reverse(F.slice("a", 1, 2)))).first()[0] == 2999


def test_error_rates_of_empty_texts(spark):
    got = one(spark, text.word_error_rate(F.lit("a b"), F.lit("")), text.word_error_rate(F.lit(""), F.lit("a")), text.character_error_rate(F.lit("é"), F.lit("e")), text.word_error_rate(F.lit("a b c d"), F.lit("a x c d")))
    assert list(got) == [1.0, None, 1.0, 0.25]


def test_speaker_forms(spark):
    raw = [" 3F9A - Linsa_1\t", "3f9a-linsa_1", "__null__", "AB12_none", "ab12_nones", " \t", None, "__NULL_REF__", "a--b \t c"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(speaker_normal_form("s")).collect()][:2] == ["3f9a_linsa_1"] * 2
    assert [r[0] for r in df.select(known_speaker("s")).collect()] == ["3f9a_linsa_1", "3f9a_linsa_1", None, None, "ab12_nones", None, None, None, "a_b_c"]


def test_numbers(spark):
    big = 800.0
    got = one(spark, numeric.softplus(F.lit(big)), numeric.softplus(F.lit(-big)), numeric.log_sigmoid(F.lit(0.0)), numeric.cosine(arr([0, 0]), arr([1, 2])), numeric.cosine(arr([3, 4]), arr([3, 4])), numeric.round_half_up(F.lit(-0.00001), 4))
    assert got[0] == big and got[1] == 0.0 and abs(got[2] + math.log(2)) < 1e-12 and got[3] is None and abs(got[4] - 1) < 1e-12
    assert got[5] == 0.0 and math.copysign(1, got[5]) == 1
    logits = one(spark, numeric.top_k_filter(arr([1, 5, 3, 5], "double"), 2, 0.5), numeric.log_softmax(arr([0, 0], "double")))
    assert list(logits[0]) == [None, 10.0, None, 10.0] and abs(logits[1][0] + math.log(2)) < 1e-12


def test_schedules(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 999, 1000, 1750, 9000)], "s int")
    got = [r[0] for r in steps.select(numeric.ramp(F.col("s"), 0.3, 1000, 1500)).collect()]
    assert got == pytest.approx([0, 0, 0, 0.15, 0.3])
    got = [r[0] for r in steps.select(numeric.cosine_schedule(F.col("s"), 1.0, 1000, 2500)).collect()]
    assert got == pytest.approx([0.001, 1.0, 1.0, 0.5, 0.0])


def test_draws_do_not_depend_on_partitions(spark):
    draws = [spark.range(200).repartition(n).select("id", hash01(3, "id").alias("u"), pick_index(F.lit(7), 3, "id").alias("k")).orderBy("id").collect() for n in (1, 9)]
    assert draws[0] == draws[1] and all(0 <= r["u"] < 1 and 0 <= r["k"] < 7 for r in draws[0])
    assert one(spark, pick_index(F.lit(0), 1, F.lit("x")))[0] is None


def test_preference_floor():
    with pytest.raises(ValueError):
        PreferenceConfig().validate([1e-3])
