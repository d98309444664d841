"""Schemas of the stored tables; JSON lines are always read with one of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from corpuskit.config import CodecConfig, ConfigError

SEEDS = "id int, uuid string, text string, category string, lang string, source string"
MANIFEST = "group_id string, uuid string, text string, category string, speaker string, sample_idx int, n_frames int, duration_sec double, truncated boolean, max_frames int"
SCORES = MANIFEST + ", transcript string, wer double, cer double, empty_asr boolean, dur_min double, dur_max double, sim double, reward double, clean boolean"
PAIRS = (
    "group_id string, uuid string, text string, category string, speaker string, chosen_idx int, rejected_idx int, chosen_n_frames int, rejected_n_frames int,"
    " chosen_truncated boolean, rejected_truncated boolean, reward_chosen double, reward_rejected double,"
    " ref_chosen struct<logp_tokens: double, logp_stop: double, n_frames: int>, ref_rejected struct<logp_tokens: double, logp_stop: double, n_frames: int>"
)
KEEP_INDEX = "row_id bigint, copy int, orig_len int"
TOKENS = "group_id string, sample_idx int, tokens array<array<smallint>>"
EVENTS = "ts timestamp, item string, shard string, stage string, percent double, status string"


def clips(layers: int = 8) -> str:
    return "text string, encoded_len int, " + ", ".join(f"nano_layer_{i} array<int>" for i in range(1, layers + 1)) + ", speaker_id string"


def prepared(codec: CodecConfig) -> str:
    names = [f"level_audio_{i}" for i in range(codec.channels)]
    own = ["text_ids array<int>", *[f"{n} array<int>" for n in names], *[f"labels_{n} array<int>" for n in names]]
    return ", ".join([*own, "labels_stop array<int>", "attention_mask array<int>", "encoded_len int", "speaker_id string", "row_id bigint"])


def check_columns(df: DataFrame, wanted: Mapping[str, str], what: str) -> DataFrame:
    """``df`` itself if it has the columns with these types; fails at analysis time otherwise."""
    have = dict(df.dtypes)
    wrong = [f"{c} {t} (is {have.get(c, 'missing')})" for c, t in wanted.items() if have.get(c) != t]
    if wrong:
        raise ConfigError(f"{what}: wants {', '.join(wrong)}")
    return df
