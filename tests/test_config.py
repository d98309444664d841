import pytest

from corpuskit.config import BatchConfig, BuildConfig, CodecConfig, ConfigError, LayoutConfig, PreferenceConfig, RolloutConfig, SourceConfig, override
from corpuskit.operators.build import speaker_prefixes
from corpuskit.schemas import check_columns, prepared
from corpuskit.sources.readers import split_bounds


@pytest.mark.parametrize(
    "check",
    [
        lambda: CodecConfig(frame_rate=0).validate(),
        lambda: CodecConfig(levels=()).validate(),
        lambda: LayoutConfig(mixed_keep=1.5).validate(),
        lambda: LayoutConfig(target=0).validate(),
        lambda: BuildConfig(policy="drop").validate(),
        lambda: BuildConfig(min_clips=0).validate(),
        lambda: BuildConfig(max_seconds=0).validate(),
        lambda: BuildConfig(add_speaker=False).validate(),
        lambda: BuildConfig().validate([]),
        lambda: BuildConfig().validate([SourceConfig("a", layer_keys=("x",))]),
        lambda: BuildConfig(policy="remove").validate([SourceConfig("a", speaker_column=None)]),
        lambda: BuildConfig().validate([SourceConfig("a", speaker_prefix="ab12"), SourceConfig("b", speaker_prefix="ab12")]),
        lambda: BatchConfig(speakers=1).validate(),
        lambda: BatchConfig(clips=4).validate(BuildConfig()),
        lambda: BatchConfig().validate(per_device=10),
        lambda: PreferenceConfig(beta=0).validate(),
        lambda: RolloutConfig().validate(n_references=3),
        lambda: override(BuildConfig(), ["codec.speed=1"]),
        lambda: override(BuildConfig(), ["min_clips=many"]),
        lambda: split_bounds("train[1:", 5),
    ],
)
def test_rejected(check):
    with pytest.raises(ConfigError):
        check()


def test_accepted_and_overridden():
    BuildConfig().validate([SourceConfig("a"), SourceConfig("b", speaker_column=None)])
    cfg = override(BuildConfig(), ["codec.levels=[4,4]", "layout.enabled=false", "max_seconds=none", "min_clips=5"])
    assert cfg.codec.levels == (4, 4) and not cfg.layout.enabled and cfg.max_seconds is None and cfg.min_clips == 5
    assert BatchConfig().size == 64 and BatchConfig().epoch_seed(2, 3) == 42 + 2018 + 21


def test_splits():
    assert split_bounds("train", 7) == (0, 7) and split_bounds("train[:3]", 7) == (0, 3)
    assert split_bounds("train[:90%]", 7) == (0, 6) and split_bounds("train[2:-1]", 7) == (2, 6) and split_bounds("train[:99]", 7) == (0, 7)


def test_prefixes_are_unique_and_pins_stay():
    got = speaker_prefixes([SourceConfig(f"s{i}") for i in range(500)] + [SourceConfig("p", speaker_prefix="0000")])
    assert len(set(got.values())) == 501 and got["p"] == "0000" and all(len(v) == 4 for v in got.values())


def test_schemas(spark):
    df = spark.createDataFrame([], prepared(CodecConfig(num_layers=1)))
    assert len(df.columns) == 6 + 2 * 4
    with pytest.raises(ConfigError):
        check_columns(df, {"text_ids": "array<bigint>"}, "prepared")
