from functools import reduce
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.config import BatchConfig, BuildConfig, ConfigError, KeepConfig, LayoutConfig, PairConfig, PreferenceConfig, ReferenceConfig, RewardConfig, RolloutConfig, SourceConfig
from corpuskit.operators import build, keep_index, losses, pairs, providers, ranking, rollouts, sampling, scoring, seeds, skew, speakers


# ---- skew

def test_per_key_records(spark):
    rows = [("hot", i % 700, i % 50) for i in range(3000)] + [("b", 1, 5), ("b", 1, None), ("b", None, 99), ("c", 7, None), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, r int, m int").withColumns({"_salt": F.lit(1), "n": F.lit(2), "total": F.lit("x")})
    got = {r["k"]: tuple(r)[1:] for r in skew.per_key_records(df, "k", "r", "m").collect()}
    best = {}
    for k, r, m in rows[:3000]:
        best[r] = max(best.get(r, -1), m)
    assert got == {"hot": (3000, 700, sum(best.values()), 49, 3004), "b": (3, 1, 5, 5, 3004), "c": (1, 1, 0, None, 3004)}


def test_heavy_hitters(spark):
    df = spark.createDataFrame([("a" if i % 3 == 0 else f"k{i}",) for i in range(6000)] + [(None,)] * 500, "k string")
    keys, n = skew.heavy_hitters(df, "k", 0.01)
    assert keys == ["a"] and n == 6000
    assert skew.heavy_hitters(df.limit(0), "k") == ([], 0)
    with pytest.raises(ValueError):
        skew.heavy_hitters(df, "k", 1e-5)


@pytest.mark.parametrize("heavy", [[], ["a"], ["a", "nobody"]])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, heavy, how):
    big = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, x int")
    small = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D")], "k string, y string")
    assert Counter(skew.skew_join(big, small, "k", heavy, how).select("k", "x", "y").collect()) == Counter(big.join(small, "k", how).select("k", "x", "y").collect())


def test_sized_join_both_ways(spark):
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    want = sorted(big.join(small, "k").collect())
    assert sorted(skew.sized_join(big, small, "k").collect()) == want == sorted(skew.sized_join(big, small, "k", 0).collect())


# ---- ranks

@pytest.mark.parametrize("parts", [1, 6])
def test_ranks_and_sums(spark, parts):
    rows = [(i, f"g{i % 5 if i % 2 else 0}" if i % 11 else None, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(parts)
    for r in (ranking.hash_rank(df, ["g"], ["i"], buckets=8), ranking.ordered_rank(df, "g", ["v", "i"])):
        by = {}
        for x in r.collect():
            by.setdefault(x["g"], []).append(x["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 500
    ordered = {x["i"]: x["rank"] for x in ranking.ordered_rank(df, "g", ["v", "i"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((v, i) for i, k, v in rows if k == g)
        assert [ordered[i] for _, i in own] == list(range(len(own)))
    total, want = 0, []
    for i, _, v in sorted(rows):
        total += v
        want.append(total)
    assert [x["running"] for x in ranking.global_running_sum(df, ["i"], "v").orderBy("i").collect()] == want
    assert [x["position"] for x in ranking.global_position(df, ["i"]).orderBy("i").collect()] == list(range(500))
    assert ranking.global_position(df.limit(0), ["i"]).count() == 0


# ---- speakers and build

def clips(spark, rows):
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "row_id bigint, speaker_id string, encoded_len int")


def test_policies(spark):
    df = clips(spark, [("a", 1)] * 3 + [("b", 1)] + [(None, 1)] * 3 + [(speakers.SENTINEL, 1)] * 4 + [("None", 1)])
    got = Counter(r["speaker_id"] for r in speakers.null_rare(df, 3, F.lit("p")).collect())
    assert got == {"p_a": 3, "p_None": 3, speakers.SENTINEL: 6}
    assert Counter(r["speaker_id"] for r in speakers.remove_rare(df, 3).collect()) == {"a": 3, None: 3, speakers.SENTINEL: 4}
    rare_null = clips(spark, [("a", 1)] * 3 + [(None, 1)])
    assert Counter(r["speaker_id"] for r in speakers.remove_rare(rare_null, 3).collect()) == {"a": 3}
    assert speakers.with_rarity(df, 1).where("is_rare").count() == 0


def test_histogram_is_zero_filled(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 5), ("c", 21), ("d", 400)], "speaker_id string, n_clips bigint")
    assert speakers.histogram(counts).first().asDict() == {"1": 1, "2": 0, "3": 0, "4-5": 1, "6-10": 0, "11-20": 0, "21+": 2}
    assert set(speakers.histogram(counts.limit(0)).first()) == {0}


def test_statistics_keep_and_correct_the_quirk(spark):
    df = spark.createDataFrame([("x", "a")] * 3 + [("x", "b")] + [("y", speakers.SENTINEL)] * 4, "source string, speaker_id string")
    rows = {r["source"]: r for r in speakers.speaker_statistics(df, "source", 3).collect()}
    assert (rows["y"]["n_eligible_speakers"], rows["y"]["pct_null_exposure"], rows["y"]["pct_null_exposure_corrected"]) == (1, 0.0, 100.0)
    assert (rows[None]["n_rows"], rows[None]["n_rare_speakers"], rows[None]["pct_null_exposure"]) == (8, 1, 12.5)


def test_filter_comes_before_counting_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "clips")
    clips(spark, [("a", 5), ("a", 5), ("a", 9000), ("b", None)]).write.parquet(path)
    usable = build.usable(spark.read.parquet(path), BuildConfig(), filled=None)
    assert [r["speaker_id"] for r in speakers.null_rare(usable, 3, F.lit("p")).collect()] == [speakers.SENTINEL] * 2
    assert "LessThanOrEqual(encoded_len,860)" in usable._jdf.queryExecution().executedPlan().toString()


def test_cap_clamps_and_is_partition_free(spark):
    df = clips(spark, [("a", i) for i in range(40)])
    assert build.capped(df, 99, 1, "row_id").count() == 40
    got = [sorted(r["row_id"] for r in build.capped(df.repartition(n), 7, 1, "row_id").collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 7


def corpus(spark, n, speaker):
    layers = ", ".join(f"array(int(id % 2016), int(id * 7 % 2016)) AS nano_layer_{i}" for i in range(1, 9))
    return spark.sql(f"SELECT id AS row_id, concat('word number ', id) AS text, 2 AS encoded_len, {layers}, {speaker} AS speaker_id FROM range({n})")


def test_build_corpus(spark):
    cfg = BuildConfig(layout=LayoutConfig(mixed_keep=0.0))
    parts = [(SourceConfig("one", language_tag="EN"), corpus(spark, 6, "concat('s', id % 2)")), (SourceConfig("two", speaker_column=None, max_rows=2), corpus(spark, 4, "'x'"))]
    rows = build.build_corpus(parts, cfg).collect()
    assert Counter(r["source"] for r in rows) == {"one": 6, "two": 2}
    prefix = build.speaker_prefixes([s for s, _ in parts])
    assert {r["speaker_id"] for r in rows if r["source"] == "one"} == {f"{prefix['one']}_s0", f"{prefix['one']}_s1"}
    assert {r["speaker_id"] for r in rows if r["source"] == "two"} == {speakers.SENTINEL}
    for r in rows:
        n, m = len(r["text_ids"]), len(r["level_audio_0"])
        assert m == 3 and all(len(r[f"labels_level_audio_{i}"]) == n + m + 1 == len(r["attention_mask"]) == len(r["labels_stop"]) for i in range(32))
    assert {len(r["text_ids"]) for r in rows if r["source"] == "one"} == {4 * (4 + 2) + 1}  # the tag counts as a word
    ids = sorted((r["source"], r["corpus_row"]) for r in build.with_row_ids(build.build_corpus(parts, cfg), ["source", "row_id"], "corpus_row").collect())
    assert [i for _, i in ids] == list(range(8))
    with pytest.raises(ConfigError):
        build.canonical(corpus(spark, 1, "'x'"), {"missing": "text"})


@pytest.mark.parametrize("policy", ["null_prefix", "remove"])
def test_one_pass_build_gives_the_same_table(spark, policy):
    cfg = BuildConfig(layout=LayoutConfig(mixed_keep=0.0), policy=policy)
    one, two = SourceConfig("one", language_tag="EN"), SourceConfig("two", speaker_column="speaker_id" if policy == "remove" else None, max_rows=2)
    parts = [(one, corpus(spark, 9, "CASE WHEN id < 7 THEN concat('s', id % 2) WHEN id = 7 THEN 'rare' END")), (two, corpus(spark, 5, "'x'"))]
    tagged = reduce(lambda a, b: a.unionByName(b), [df.withColumn("source", F.lit(s.name)) for s, df in [*parts, (SourceConfig("other"), corpus(spark, 3, "'y'"))]])
    want = build.build_corpus(parts, cfg)
    got = build.build_tagged(tagged, [one, two], cfg, number="corpus_row")
    rows = {(r["source"], r["row_id"]): r.asDict() for r in got.collect()}
    assert sorted(r.pop("corpus_row") for r in rows.values()) == list(range(len(rows)))
    assert rows == {(r["source"], r["row_id"]): r.asDict() for r in want.collect()}


def test_file_tokenizer(spark):
    add = providers.file_tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    got = add(spark.createDataFrame([(1, "Hello world"), (2, None), (3, "<|endoftext|>")], "i int, text string"), "text", "ids").orderBy("i").collect()
    assert len(got[0]["ids"]) == 2 and got[1]["ids"] == [] and len(got[2]["ids"]) > 1


# ---- keep index

def lengths(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "row_id bigint, orig_len int")


def test_keep_index_golden(spark):
    df = lengths(spark, [3, 5, 20, 30, 200, 40, 50, 60, 70, 80])
    got = keep_index.keep_index(df, KeepConfig()).collect()
    ids = [r["row_id"] for r in got]
    assert len(got) == 5 and {0, 1} <= set(ids) and 4 not in ids
    thrice = sorted(r["row_id"] for r in keep_index.keep_index(df, KeepConfig(oversample=3)).collect())
    assert thrice == [0, 0, 0, 1, 1, 1]
    assert keep_index.keep_report(df, KeepConfig()).first().asDict() | {} == {"n_rows": 10, "n_short": 2, "n_short_kept": 2, "n_long_eligible": 7, "n_tail_dropped": 1, "n_long_kept": 3, "n_kept": 5, "short_share": 0.4}
    assert keep_index.gather(df, keep_index.keep_index(df, KeepConfig(oversample=3))).count() == 6
    assert keep_index.keep_index(lengths(spark, []), KeepConfig()).count() == 0


# ---- sampling

def index_of(spark, rows):
    return sampling.speaker_index(clips(spark, rows), ReferenceConfig(), 21.5)


def test_reference_policy(spark):
    rows = [("a", 100), ("a", 200), ("a", 10), ("one", 50), ("solo", 400), ("short", 10), ("short", 12), (None, 99), (speakers.SENTINEL, 99)]
    got = {r["row_id"]: r for r in sampling.pick_references(index_of(spark, rows), ReferenceConfig(), 21.5).collect()}
    assert set(got) == set(range(9))
    assert got[0]["ref_row_id"] == 1 and got[1]["ref_row_id"] == 0 and got[2]["ref_row_id"] in (0, 1)
    assert (got[3]["kind"], got[3]["ref_row_id"], got[3]["ref_len"]) == ("self", 3, 51)
    assert got[4]["kind"] == "self" and 64 <= got[4]["ref_len"] <= 322 and got[4]["ref_start"] + got[4]["ref_len"] <= 401
    assert got[5]["ref_row_id"] == 6 and got[5]["ref_len"] == 13
    assert {got[7]["kind"], got[8]["kind"]} == {"null"} and got[7]["ref_len"] == 1
    own = sampling.pick_references(index_of(spark, rows), ReferenceConfig(self_reference=True), 21.5).where("kind <> 'null'")
    assert own.where("kind <> 'self' OR ref_row_id <> row_id").count() == 0


def test_speaker_batches(spark):
    rows = [(f"s{i % 23}", 100) for i in range(23 * 5)] + [("rare", 100)] * 2 + [(None, 1)] * 9
    cfg = BatchConfig(speakers=4, clips=3, fillers=5)
    idx = index_of(spark, rows)
    got = sampling.speaker_batches(idx, cfg).collect()
    who = {r["row_id"]: r["speaker_int"] for r in idx.collect()}
    assert len(got) == 5 * cfg.size
    for b in range(5):
        own = [r for r in got if r["batch_id"] == b]
        assert sorted(r["slot"] for r in own) == list(range(cfg.size))
        by = Counter(who[r["row_id"]] for r in own if not r["is_filler"])
        assert sorted(by.values()) == [3] * 4 and len({r["row_id"] for r in own}) == cfg.size
        assert {who[r["row_id"]] for r in own if r["is_filler"]} == {-1}
    assert sorted(got) != sorted(sampling.speaker_batches(idx, cfg, epoch=1).collect())
    without = sampling.speaker_batches(index_of(spark, rows[:115]), cfg).where("is_filler").collect()
    assert len(without) == 25
    with pytest.raises(ConfigError):
        sampling.speaker_batches(index_of(spark, [("a", 1)]), cfg)


def test_epoch_batches_hold_a_whole_epoch(spark):
    rows = [("big", 100)] * 300 + [(f"s{i % 7}", 100) for i in range(7 * 3)] + [("rare", 100)] * 2 + [(None, 1)] * 9
    cfg = BatchConfig(speakers=4, clips=3, fillers=5)
    idx = index_of(spark, rows)
    got = sampling.epoch_batches(idx, cfg).collect()
    who = {r["row_id"]: r["speaker_int"] for r in idx.collect()}
    n = 321 // 12
    assert sampling.batch_count(idx, cfg).first()["n_batches"] == n and len(got) == n * cfg.size
    for b in range(n):
        own = [r for r in got if r["batch_id"] == b]
        assert sorted(r["slot"] for r in own) == list(range(cfg.size)) and len({r["row_id"] for r in own}) == cfg.size
        assert sorted(Counter(who[r["row_id"]] for r in own if not r["is_filler"]).values()) == [3] * 4
        assert {who[r["row_id"]] for r in own if r["is_filler"]} == {-1}
    big = who[0]
    assert len({r["row_id"] for r in got if who[r["row_id"]] == big}) > 3
    assert len({who[r["row_id"]] for r in got if not r["is_filler"]}) == 8
    assert sorted(got) != sorted(sampling.epoch_batches(idx, cfg, epoch=1).collect())
    assert sampling.epoch_batches(idx, cfg, world=2).agg({"batch_id": "max"}).first()[0] == n // 2 - 1
    few = sampling.epoch_batches(index_of(spark, rows[:323] + [(None, 1)] * 2), cfg).where("is_filler").collect()
    assert len(few) == n * 5 and len({r["row_id"] for r in few}) == 2
    assert sampling.epoch_batches(index_of(spark, rows[:321]), cfg).where("is_filler").count() == n * 5
    assert sampling.epoch_batches(index_of(spark, [(f"s{i % 4}", 9) for i in range(12)]), cfg, world=9).where("NOT is_filler").count() == 12
    with pytest.raises(ConfigError):
        sampling.epoch_batches(index_of(spark, [(f"s{i % 3}", 9) for i in range(12)]), cfg)


def test_reference_codes_and_padding(spark):
    table = spark.createDataFrame([(1, [1, 2, 3], [4, 5, 6]), (2, [7, 8], [9, 9])], "row_id bigint, c0 array<int>, c1 array<int>")
    refs = spark.createDataFrame([(1, 2, "cross", 1, 1), (2, 1, "cross", 0, 2), (3, None, "null", 0, 1)], "row_id bigint, ref_row_id bigint, kind string, ref_start int, ref_len int")
    got = {r["row_id"]: r for r in sampling.pad_references(sampling.reference_codes(refs, table, ["c0", "c1"]).withColumn("batch_id", F.lit(0)), 2).collect()}
    assert [[list(x) for x in got[i]["ref_codes"]] for i in (1, 2, 3)] == [[[8, 9], [0, 0]], [[1, 4], [2, 5]], [[0, 0], [0, 0]]]
    assert [list(got[i]["ref_mask"]) for i in (1, 2, 3)] == [[1, 0], [1, 1], [1, 0]] and got[3]["force_null"] == 1


# ---- rollouts, scores, pairs

def test_fan_out_and_resume(spark):
    texts = spark.createDataFrame([(i, f"uuid{i:04d}-x", f"t {i}", None) for i in range(40)], "id int, uuid string, text string, category string")
    pool = rollouts.without_holdouts(spark.createDataFrame([(f"pool_{i:02d}",) for i in range(6)], "speaker string"), spark.createDataFrame([("pool_03",)], "speaker string"))
    groups = rollouts.fan_out(texts, pool, RolloutConfig(), shards=3).cache()
    rows = groups.orderBy("gi").collect()
    names = [f"pool_{i:02d}" for i in (0, 1, 2, 4, 5)]
    assert [r["gi"] for r in rows] == list(range(200)) and all(r["speaker"] in (names[(r["id"] + r["slot"]) % 5], "__null__") for r in rows)
    assert 10 <= sum(r["speaker"] == "__null__" for r in rows) <= 60 and [r["shard"] for r in rows[:4]] == [0, 1, 2, 0]
    assert rollouts.shard_totals(10, 4) == [3, 3, 2, 2]
    done = [(rows[0]["group_id"], i) for i in range(8)] + [(rows[1]["group_id"], i) for i in [0, 1, 2, 3, 3, 3, 3, 3]]
    left = rollouts.unfinished(groups, spark.createDataFrame(done, "group_id string, sample_idx int"), 8)
    assert left.count() == 199
    assert {r["speaker"] for r in rollouts.fan_out(texts, pool.limit(0), RolloutConfig()).collect()} == {"__null__"}


def test_reward_golden(spark):
    rows = [(1, 0.0, False, 1.5, 0.9), (2, 0.5, False, 1.0, None), (3, 1.0, True, 0.2, None), (4, 2.0, False, 10.0, 0.5), (5, 0.0, False, 1.5, None)]
    df = spark.createDataFrame(rows, "i int, wer double, empty boolean, duration_sec double, sim double").withColumns({"text": F.lit("a b c"), "truncated": F.lit(False), "cer": F.lit(0.0)})
    got = scoring.rewards(scoring.duration_bounds(df, RewardConfig()), RewardConfig(), PairConfig()).orderBy("i").collect()
    assert [round(r["raw_reward"], 9) for r in got] == [-0.05, -0.5, -5.0, -5.35, 0.0] and np.copysign(1, got[4]["raw_reward"]) == 1
    assert [r["is_clean"] for r in got] == [True, False, False, False, True]


def test_rounded_gate_differs_from_clean(spark):
    df = spark.createDataFrame([(0.20004, False, 1.0, None, 0.5, 2.0, False)], "wer double, empty boolean, duration_sec double, sim double, low double, high double, truncated boolean").withColumn("cer", F.lit(0.0))
    row = scoring.written(scoring.rewards(df, RewardConfig(), PairConfig()))
    assert not row.first()["clean"] and row.where(pairs.acceptable(PairConfig())).count() == 1


def test_similarity_and_latest(spark):
    df = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("a", 0.1, [1.0, 0.0]), ("zz", 1.0, [1.0, 0.0])], "speaker string, duration_sec double, vector array<double>")
    voices = spark.createDataFrame([("a", [1.0, 1.0])], "speaker string, vector array<double>")
    assert [r["sim"] and round(r["sim"], 6) for r in scoring.with_similarity(df, voices).orderBy("speaker", F.desc("duration_sec")).collect()] == [0.707107, None, None]
    lines = spark.createDataFrame([("g", 1, 5, "old"), ("g", 1, 6, "new"), ("g", 1, None, "never"), ("g", 2, None, "only")], "g string, i int, at int, x string")
    assert sorted(r["x"] for r in scoring.latest_lines(lines, ["g", "i"], "at").collect()) == ["new", "only"]


def greedy(rows, cfg):
    out = []
    for g in sorted({r[0] for r in rows}):
        recs = sorted(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), key=lambda r: -r[2])
        good = [r for r in recs if r[3] <= cfg.max_wer]
        used = set()
        for k in range(min(cfg.max_pairs, len(good))):
            bad = next((r for r in reversed(recs) if r[1] not in used and r[3] > cfg.max_wer), None)
            if bad is None or good[k][2] - bad[2] < cfg.min_margin:
                break
            used |= {good[k][1], bad[1]}
            out.append((g, good[k][1], bad[1]))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_rank_join_equals_the_greedy_loop(spark, most):
    rng = np.random.default_rng(most)
    rows = [(f"g{g}", i, float(rng.integers(-4, 1)) / 2, float(rng.choice([0.1, 0.5]))) for g in range(60) for i in range(int(rng.integers(1, 9)))]
    rows += [("nan", 0, float("nan"), 0.1), ("nan", 1, -3.0, 0.9)]
    df = spark.createDataFrame(rows, "group_id string, sample_idx int, reward double, wer double")
    df = df.withColumns({"uuid": F.lit("u"), "text": F.lit("t"), "category": F.lit(None).cast("string"), "speaker": F.lit("s"), "n_frames": F.lit(1), "truncated": F.lit(False), "empty_asr": F.lit(False), "duration_sec": F.lit(1.0), "dur_min": F.lit(0.5), "dur_max": F.lit(2.0)})
    cfg = PairConfig(max_pairs=most)
    got = sorted((r["group_id"], r["chosen_idx"], r["rejected_idx"]) for r in pairs.mine_pairs(df, cfg).collect())
    assert got == greedy([r for r in rows if r[0] != "nan"], cfg)
    report = pairs.pair_report(df, cfg).first()
    assert report["n_groups"] == 61 and report["n_pairs"] == len(got)
    assert Counter(r["side"] for r in pairs.pair_sides(pairs.mine_pairs(df, cfg)).collect()) == ({"chosen": len(got), "rejected": len(got)})


def test_categories(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "category string")
    assert {r["category"]: r["n"] for r in pairs.category_counts(df).collect()} == {"a": 1, "?": 2}


# ---- losses

def test_pair_weights_golden(spark):
    df = spark.createDataFrame([(0.5,), (3.5,), (12.0,)], "m double")
    for mode, want in (("linear", [0.48, 0.84, 1.68]), ("clip", [0.1603, 0.6412, 2.1985]), ("none", [1.0, 1.0, 1.0])):
        w = [r[0] for r in df.select(losses.pair_weight(F.col("m"), PreferenceConfig(weight_mode=mode))).collect()]
        assert [round(x / (sum(w) / 3), 4) for x in w] == want


def test_preference_loss_golden(spark):
    df = spark.createDataFrame([(-1.0, -2.0, -1.2, -1.9, 1.0)], "pi_chosen double, pi_rejected double, ref_chosen double, ref_rejected double, weight double")
    assert round(losses.preference_loss(df, PreferenceConfig()).first()["loss"], 6) == 0.437488


def test_contrastive_edge_cases(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, -1, [1.0, 0.0]), (3, 5, [1.0, 0.0])], "b int, s int, v array<float>")
    got = {r["b"]: r for r in losses.contrastive_loss(losses.contrastive_parts(df, "b", "v", "s"), "b").collect()}
    assert set(got) == {1, 3} and got[1]["loss"] == 0.0 and got[3]["n_anchors"] == 0


def test_masked_losses(spark):
    df = spark.createDataFrame([("h", [0.0, 0.0], -100), ("k", [0.0, 0.0], 1), ("k", [0.0, 0.0], -100)], "head string, logits array<double>, y int")
    got = {r["head"]: (round(r["loss"], 6), r["n_labels"]) for r in losses.masked_cross_entropy(df, "logits", "y", ("head",)).collect()}
    assert got == {"h": (0.0, 0), "k": (0.693147, 1)}
    stops = spark.createDataFrame([(0.0, 1), (0.0, 0), (3.0, -100)], "z double, y int")
    assert round(losses.masked_stop_loss(stops, "z", "y", 25.0).first()["loss"], 6) == round(26 * np.log(2) / 2, 6)


def test_trajectory(spark):
    df = spark.createDataFrame([(1, [[-1.0, -2.0], [-3.0]], [0.0, 0.0], False), (2, [[-1.0]], [50.0], True), (3, [], [], False)], "i int, t array<array<double>>, z array<double>, tr boolean")
    got = {r["i"]: (round(r["logp_tokens"], 6), round(r["logp_stop"], 6)) for r in losses.trajectory_logprob(df, "t", "z", "tr", 1e-4).collect()}
    assert got == {1: (-6.0, round(2 * np.log(0.5), 6)), 2: (-1.0, 0.0), 3: (0.0, 0.0)}


# ---- seeds

def test_seeds(spark):
    old = spark.createDataFrame([(1, "u1", "x", "c", "en", "v1"), (7, "u7", "y", "c", "en", "v1"), (9, "u9", "x", "c", "en", "v1"), (10, "u", None, "c", "en", "v1")], "id int, uuid string, text string, category string, lang string, source string")
    once = seeds.distinct_texts(old, "id").orderBy("position").collect()
    assert [(r["position"], r["text"], r["id"]) for r in once] == [(0, "x", 1), (1, "y", 7)]
    assert seeds.distinct_texts(old, "id", cap=1).count() == 1
    filled = seeds.fill_templates(spark.range(30).withColumnRenamed("id", "k"), "k", ["see {a}", "go to {a}"], {"a": ["p", "q"]}, 3)
    assert {r["text"] for r in filled.collect()} == {"see p", "see q", "go to p", "go to q"}
    new = seeds.distinct_texts(filled, "k").drop("k").withColumns({"category": F.lit("urls"), "lang": F.lit("en")})
    both = seeds.continue_seeds(old, new, 1, "v2").collect()
    assert sorted(r["id"] for r in both) == [1, 7, 9, 10, 11, 12, 13, 14] and len({r["uuid"] for r in both}) == 8
    assert all(len(r["uuid"]) == 36 for r in both if r["source"] == "v2")


def test_training_pairs_draw_wanted_samples_and_never_broadcast_tokens(spark):
    mined = spark.createDataFrame([("g1", 0, 2, "a"), ("g1", 1, 2, "a"), ("g2", 1, 7, "a"), ("g3", 0, 1, None), ("g4", 0, 1, "a")], "group_id string, chosen_idx int, rejected_idx int, speaker string")
    groups = spark.createDataFrame([("g1", 50), ("g2", 80), ("g3", 90), ("g5", 20)], "group_id string, max_frames int")
    prefixes = providers.stand_in_prefixes(mined.select("speaker").where("speaker IS NOT NULL"))
    draw = providers.stand_in_policy()
    wanted = pairs.wanted_samples(mined)
    drawn = draw(groups, 3, wanted)
    assert {(r["group_id"], r["sample_idx"]) for r in drawn.collect()} == {("g1", 0), ("g1", 1), ("g1", 2), ("g2", 1), ("g3", 0), ("g3", 1)}
    whole = {(r["group_id"], r["sample_idx"]): r["tokens"] for r in draw(groups, 3).collect()}
    found = pairs.training_pairs(mined, drawn, prefixes)
    assert {(r["group_id"], r["chosen_idx"], r["rejected_idx"]): (r["chosen_tokens"], r["rejected_tokens"]) for r in found.collect()} == {("g1", i, 2): (whole["g1", i], whole["g1", 2]) for i in (0, 1)}
    for tokens in (drawn, draw(groups, 3)):
        plan = pairs.training_pairs(mined, tokens, prefixes)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [group_id" in plan and "BroadcastHashJoin [group_id" not in plan
