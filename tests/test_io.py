import json

import pytest
from pyspark.sql import functions as F

from corpuskit import schemas
from corpuskit.operators import speakers
from corpuskit.sources import readers, sinks
from corpuskit.streaming import progress


def manifest(spark, shard, groups, samples=8):
    rows = [(f"g{shard}-{g}", "u", "t", None, "s", i, 10, 0.5, False, 80, shard) for g in range(groups) for i in range(samples)]
    return spark.createDataFrame(rows, schemas.MANIFEST + ", shard int")


def test_manifest_shards_append_resume_and_stream(spark, tmp_path):
    path = str(tmp_path / "manifest")
    for shard in (0, 1):
        sinks.append_manifest(manifest(spark, shard, 2), path)
    sinks.append_manifest(manifest(spark, 1, 1, 3).withColumn("group_id", F.lit("broken")), path)
    lines = spark.read.schema(schemas.MANIFEST + ", shard int").json(path)
    assert lines.count() == 35 and lines.where("category IS NOT NULL").count() == 0
    stream = spark.readStream.schema(schemas.MANIFEST + ", shard int").json(path)
    progress.watch_shards(stream, 8, "watched").awaitTermination()
    assert {r["shard"]: (r["n_lines"], r["n_groups_done"]) for r in spark.table("watched").collect()} == {0: (16, 2), 1: (19, 2)}


def test_manifest_glob_and_counts(spark, tmp_path):
    base = str(tmp_path / "m.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.read_manifest(spark, base, schemas.MANIFEST)
    for name in (base, base + ".shard0", base + ".shard1", base + ".other"):
        with open(name, "w") as f:
            f.write(json.dumps({"group_id": name[-6:], "sample_idx": 1, "text": "é", "extra": 1}) + "\n")
    rows = readers.read_manifest(spark, base, schemas.MANIFEST).collect()
    assert sorted(r["file"] for r in rows) == ["m.jsonl", "m.jsonl.shard0", "m.jsonl.shard1"] and {r["text"] for r in rows} == {"é"}
    assert readers.count_lines(spark, base) == 1 and readers.count_lines(spark, base + "x") == 0


def test_jsonl_round_trip_with_nested_pairs(spark, tmp_path):
    path = str(tmp_path / "pairs")
    row = ("g", "u", 'quote " and ü', None, "s", 1, 2, 3, 4, False, True, 0.1, -0.2, (-1.5, -0.1, 3), None)
    df = spark.createDataFrame([row], schemas.PAIRS)
    sinks.write_jsonl(df, path)
    assert readers.read_jsonl(spark, path, schemas.PAIRS).collect() == df.collect()


def test_tables_refuse_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(4), path, replace=True)
    assert readers.read_table(spark, path, "id bigint").count() == 4


def test_statistics_document(spark, tmp_path):
    df = spark.createDataFrame([("x", "a")] * 3 + [("y", "b")], "source string, speaker_id string")
    path = str(tmp_path / "speaker_statistics.json")
    sinks.write_statistics(speakers.speaker_statistics(df, "source", 3), path, {"min_clips": 3})
    got = json.load(open(path))
    assert got["global"]["n_rows"] == 4 and [r["source"] for r in got["per_source"]] == ["x", "y"] and got["config"] == {"min_clips": 3}
    assert sinks.provenance("build", {})["stage"] == "build"


def test_audio_references(spark, tmp_path):
    for name in ("anna.wav", "ben.v2.wav", "notes.txt"):
        (tmp_path / name).write_bytes(b"RIFF")
    assert sorted(r["speaker"] for r in readers.audio_references(spark, str(tmp_path)).collect()) == ["anna", "ben.v2"]
    assert [r["speaker"] for r in readers.pool_references(spark.range(2).withColumnRenamed("id", "row_id")).collect()] == ["pool_00", "pool_01"]


def test_split_slices(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(5)] + [("c", 1), (None, 2)], "source string, row_id int")
    got = readers.split_slices(df, "source", {"a": "train[:25%]", "b": "train", "d": "train[:3]"}, ["row_id"]).collect()
    assert sorted((r["source"], r["row_id"]) for r in got) == [("a", 0), ("a", 1)] + [("b", i) for i in range(5)]


def test_windowed_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y"), ("2024-01-03 00:00:00", "z")]
    spark.createDataFrame(rows, "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind").write.parquet(path)
    counted = progress.windowed_counts(progress.read_stream(spark, path, spark.read.parquet(path)), "ts", "kind", "1 hour", "1 hour")
    counted.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert {(r["kind"], r["n"]) for r in spark.table("windows").collect()} == {("x", 2), ("y", 1)}


def test_training_settings():
    from corpuskit.config import AdapterConfig, BuildConfig, CodecConfig, ConfigError, TrainingConfig

    codec = CodecConfig()
    TrainingConfig(heads=tuple(codec.heads()), adapter=AdapterConfig()).validate(codec, BuildConfig())
    wrong = [
        TrainingConfig(heads=("one",)), TrainingConfig(dtype="int8", bf16=False), TrainingConfig(fp16=True), TrainingConfig(dtype="float16"), TrainingConfig(bf16=False),
        TrainingConfig(voice_cloning=False), TrainingConfig(adapter=AdapterConfig(rank=0)), TrainingConfig(adapter=AdapterConfig(alpha=0)), TrainingConfig(adapter=AdapterConfig(dropout=1.0)),
        TrainingConfig(adapter=AdapterConfig(targets=())), TrainingConfig(adapter=AdapterConfig(last_layers=0)),
    ]
    for config in wrong:
        with pytest.raises(ConfigError):
            config.validate(codec)
    with pytest.raises(ConfigError):
        TrainingConfig().validate(codec, BuildConfig(add_speaker=False, policy="remove"))


def test_built_tables_and_file_counts(spark, tmp_path):
    from corpuskit.config import ConfigError
    from corpuskit.sources.readers import count_files, require_built, require_rows

    table = f"{tmp_path}/table"
    with pytest.raises(ConfigError):
        require_built(spark, table)
    spark.range(3).write.parquet(table)
    require_built(spark, table, checkpoint="some/name")
    for more in ({"keep_index": f"{tmp_path}/none"}, {"checkpoint": "./nowhere"}, {"checkpoint": f"{tmp_path}/none"}):
        with pytest.raises(ConfigError):
            require_built(spark, table, **more)
    (tmp_path / "table" / "_SUCCESS").unlink()
    with pytest.raises(ConfigError):
        require_built(spark, table)
    assert count_files(spark, table, ".parquet") >= 1 and count_files(spark, f"{tmp_path}/none") == 0
    assert require_rows(spark.range(1), True, 21.5, ["a"]).count() == 1
    for bad in ((spark.range(0),), (spark.range(1), True, None, ["a"]), (spark.range(1), True, 21.5, [])):
        with pytest.raises(ConfigError):
            require_rows(*bad)


def test_keep_index_tokens_and_prefixes(spark, tmp_path):
    from corpuskit.config import KeepConfig
    from corpuskit.operators.keep_index import index_tag
    from corpuskit.operators.providers import stand_in_policy, stand_in_prefixes
    from corpuskit.sources.sinks import write_keep_index, write_prefixes, write_tokens

    index = spark.createDataFrame([(3, 0, 5), (1, 1, 4), (1, 0, 4)], "row_id bigint, copy int, orig_len int")
    path = write_keep_index(index, str(tmp_path), index_tag(KeepConfig()))
    assert path.endswith("keep_index_short13_t50")
    assert [(r["row_id"], r["copy"]) for r in spark.read.parquet(path).collect()] == [(1, 0), (1, 1), (3, 0)]
    groups = spark.createDataFrame([("g1", 50), ("g2", 80)], "group_id string, max_frames int")
    tokens = stand_in_policy()(groups, 3)
    for shard in (0, 1, 1):
        write_tokens(tokens, f"{tmp_path}/tokens", shard)
    rows = spark.read.parquet(f"{tmp_path}/tokens").collect()
    assert len(rows) == 12 and all(len(r["tokens"]) == r["n_frames"] <= r["max_frames"] and (r["n_frames"] == r["max_frames"] or not r["truncated"]) for r in rows)
    prefixes = stand_in_prefixes(spark.createDataFrame([("a",), ("a",), ("__null__",)], "speaker string"))
    assert not write_prefixes(prefixes, f"{tmp_path}/prefixes", 1) and write_prefixes(prefixes, f"{tmp_path}/prefixes", 0)
    assert spark.read.parquet(f"{tmp_path}/prefixes").count() == 2


def test_wave_files_are_decoded_to_the_codec_rate(spark, tmp_path):
    import wave

    import numpy as np

    from corpuskit.operators.providers import wave_decoder
    from corpuskit.sources.readers import audio_references

    for name, rate, channels in (("a", 16_000, 1), ("b", 48_000, 2)):
        tone = np.sin(np.arange(rate // 2) * 2 * np.pi * 50 / rate) * 20_000
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes(np.repeat(tone.astype("<i2"), channels).tobytes())
    (tmp_path / "c.wav").write_bytes(b"no sound")
    rows = {r["speaker"]: r["samples"] for r in wave_decoder(8_000)(audio_references(spark, str(tmp_path)), "samples").collect()}
    assert rows["c"] is None
    for name in "ab":
        assert len(rows[name]) == 4_000
        assert np.abs(np.array(rows[name]) - np.sin(np.arange(4_000) * 2 * np.pi * 50 / 8_000) * 20_000 / 32768).max() < 0.01


def test_scores_are_assembled_by_key(spark):
    from corpuskit.operators.scoring import assemble

    lines = spark.createDataFrame([("g", 1, 5), ("g", 0, 6), ("h", 0, 7), (None, 0, 1)], "group_id string, sample_idx int, n_frames int")
    said = spark.createDataFrame([("h", 0, "x"), ("g", 1, "y"), ("z", 0, "w")], "group_id string, sample_idx int, transcript string")
    alike = spark.createDataFrame([("g", 0, 0.5)], "group_id string, sample_idx int, sim double")
    got = {(r["group_id"], r["sample_idx"]): (r["n_frames"], r["transcript"], r["sim"]) for r in assemble(lines, said, alike).collect()}
    assert got == {("g", 1): (5, "y", None), ("g", 0): (6, None, 0.5), ("h", 0): (7, "x", None)}
