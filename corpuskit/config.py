"""Typed settings of the engine, their checks, and dotted overrides. All of this runs on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class ConfigError(ValueError):
    """Settings that contradict each other; raised before any work."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class CodecConfig:
    # The codec's geometry.
    num_layers: int = 8
    levels: tuple[int, ...] = (8, 7, 6, 6)
    unfold: bool = True
    frame_rate: float = 21.5

    @property
    def channels(self) -> int:
        return self.num_layers * (len(self.levels) if self.unfold else 1)

    def heads(self) -> dict[str, int]:
        """Channel name -> number of codes, in channel order."""
        size = 1
        for level in self.levels:
            size *= level
        own = list(self.levels) * self.num_layers if self.unfold else [size] * self.num_layers
        return {f"level_audio_{i}": n for i, n in enumerate(own)}

    def max_frames(self, seconds: float) -> int:
        """Greatest n with n / frame_rate <= seconds, by the same division, so that the filter reaches the scan as a bound."""
        n = int(seconds * self.frame_rate) + 1
        while n / self.frame_rate > seconds:
            n -= 1
        return n

    def validate(self) -> None:
        _need(self.frame_rate > 0, "frame rate must be positive")
        _need(self.num_layers >= 1, "at least one layer")
        _need(bool(self.levels) and all(x >= 1 for x in self.levels), "levels must be positive and not empty")


@dataclass(frozen=True)
class TokenConfig:
    # The special ids of the text vocabulary.
    start_of_text: int = 248073
    end_of_text: int = 248074
    start_of_speech: int = 248070
    end_of_speech: int = 248071
    pad: int = 248076


@dataclass(frozen=True)
class LayoutConfig:
    # The text layout the stored tables were made with.
    enabled: bool = True
    target: int = 16
    apply_below: int = 13
    max_repeats: int = 8
    mixed_keep: float = 0.25
    seed: int = 0

    def validate(self) -> None:
        _need(0.0 <= self.mixed_keep <= 1.0, "mixed_keep must lie in [0, 1]")
        _need(not self.enabled or (self.target >= 1 and self.max_repeats >= 1), "target and max_repeats must be at least 1")


@dataclass(frozen=True)
class SourceConfig:
    name: str
    speaker_column: str | None = "speaker_id"
    speaker_prefix: str | None = None
    language_tag: str | None = None
    layer_keys: tuple[str, ...] = tuple(f"nano_layer_{i}" for i in range(1, 9))
    max_rows: int | None = None


@dataclass(frozen=True)
class BuildConfig:
    max_seconds: float | None = 40.0
    policy: str = "null_prefix"
    min_clips: int = 3
    add_speaker: bool = True
    codec: CodecConfig = field(default_factory=CodecConfig)
    tokens: TokenConfig = field(default_factory=TokenConfig)
    layout: LayoutConfig = field(default_factory=LayoutConfig)
    cap_seed: int = 42

    def validate(self, sources: Sequence[SourceConfig] | None = None) -> None:
        self.codec.validate()
        self.layout.validate()
        _need(self.policy in ("remove", "null_prefix"), "policy must be remove or null_prefix")
        _need(self.min_clips >= 1, "min_clips must be at least 1")
        _need(self.max_seconds is None or self.max_seconds > 0, "max_seconds must be positive")
        _need(self.add_speaker or self.policy == "remove", "a policy other than remove needs speaker ids")
        if sources is None:
            return
        _need(bool(sources), "no sources")
        pins = [s.speaker_prefix for s in sources if s.speaker_prefix]
        _need(len(pins) == len(set(pins)), "pinned speaker prefixes must be unique")
        for s in sources:
            _need(len(s.layer_keys) == self.codec.num_layers, f"{s.name}: {len(s.layer_keys)} layer keys for {self.codec.num_layers} layers")
            _need(self.policy != "remove" or not self.add_speaker or s.speaker_column is not None, f"{s.name}: policy remove needs a speaker column")


@dataclass(frozen=True)
class ReferenceConfig:
    # Bounds of reference slices.
    min_slice_seconds: float = 3.0
    max_slice_seconds: float = 15.0
    min_reference_seconds: float = 3.0
    min_self_slice_seconds: float = 6.0
    self_reference: bool = False


@dataclass(frozen=True)
class BatchConfig:
    speakers: int = 16
    clips: int = 3
    fillers: int = 16
    seed: int = 42

    @property
    def size(self) -> int:
        return self.speakers * self.clips + self.fillers

    def epoch_seed(self, epoch: int, rank: int) -> int:
        return self.seed + epoch * 1009 + rank * 7

    def validate(self, build: BuildConfig | None = None, per_device: int | None = None) -> None:
        _need(self.speakers >= 2 and self.clips >= 2 and self.fillers >= 0, "need at least 2 speakers, 2 clips and no negative fillers")
        _need(build is None or build.add_speaker, "batches by speaker need speaker ids")
        _need(build is None or build.min_clips >= self.clips, "min_clips must be at least the clips per speaker")
        _need(per_device is None or per_device == self.size, f"the batch size must be {self.size}")


@dataclass(frozen=True)
class KeepConfig:
    short_below: int = 13
    fraction: float = 0.5
    tail_cap: int = 150
    oversample: int = 1
    seed: int = 44


@dataclass(frozen=True)
class RolloutConfig:
    speakers_per_text: int = 5
    samples: int = 8
    null_probability: float = 0.15
    cap_multiple: float = 4.0
    cap_min: int = 80
    cap_max: int = 300
    seed: int = 17

    def validate(self, n_references: int | None = None) -> None:
        _need(self.samples >= 1 and self.speakers_per_text >= 1, "samples and speakers_per_text must be positive")
        _need(n_references is None or self.speakers_per_text <= n_references, "more speakers per text than references")


@dataclass(frozen=True)
class RewardConfig:
    # Expected durations and weights of the reward.
    base_seconds: float = 0.7
    seconds_per_word: float = 0.4
    min_ratio: float = 0.3
    max_ratio: float = 2.0
    w_wer: float = 1.0
    w_over: float = 0.5
    w_short: float = 2.0
    w_empty: float = 2.0
    w_similarity: float = 0.5


@dataclass(frozen=True)
class PairConfig:
    max_wer: float = 0.2
    not_truncated: bool = True
    duration_in_bounds: bool = True
    min_margin: float = 0.5
    max_pairs: int = 2


@dataclass(frozen=True)
class PreferenceConfig:
    beta: float = 2.0
    stop_weight: float = 1.0
    length_normalise: bool = True
    probability_floor: float = 1e-4
    weight_mode: str = "linear"
    weight_scale: float = 3.5
    weight_max: float = 4.0

    def validate(self, other_floors: Sequence[float] = ()) -> None:
        _need(self.beta > 0, "beta must be positive")
        _need(self.weight_mode in ("none", "linear", "clip"), "weight_mode must be none, linear or clip")
        _need(all(x == self.probability_floor for x in other_floors), "all probability floors must be equal")


def override(config: Any, settings: Sequence[str]) -> Any:
    """A copy of a settings tree with ``a.b=value`` applied; values take the type of what they replace."""
    for setting in settings:
        path, sep, text = setting.partition("=")
        _need(bool(sep), f"{setting}: no =")
        config = _set(config, path.split("."), text, path)
    return config


def _set(node: Any, path: list[str], text: str, whole: str) -> Any:
    _need(is_dataclass(node) and path[0] in {f.name for f in fields(node)}, f"unknown setting {whole}")
    old = getattr(node, path[0])
    if len(path) > 1:
        return replace(node, **{path[0]: _set(old, path[1:], text, whole)})
    if text.lower() in ("null", "none"):
        value: Any = None
    elif isinstance(old, bool):
        _need(text.lower() in ("true", "false"), f"{whole} is a boolean")
        value = text.lower() == "true"
    elif isinstance(old, tuple):
        value = tuple(type(old[0])(x) if old else x for x in text.strip("[]()").split(",") if x.strip())
    elif isinstance(old, (int, float)):
        try:
            value = type(old)(text)
        except ValueError as e:
            raise ConfigError(f"{whole} is a number") from e
    else:
        value = text
    return replace(node, **{path[0]: value})


# Number types a model may be trained in.
DTYPES = ("float32", "float16", "bfloat16")


@dataclass(frozen=True)
class AdapterConfig:
    rank: int = 16
    alpha: float = 32.0
    dropout: float = 0.05
    targets: tuple[str, ...] = ("q_proj", "v_proj")
    last_layers: int = 8

    def validate(self) -> None:
        _need(self.rank >= 1 and self.last_layers >= 1, "an adapter needs a rank and layers of at least 1")
        _need(self.alpha > 0, "an adapter's alpha must be positive")
        _need(0.0 <= self.dropout < 1.0, "an adapter's dropout must lie in [0, 1)")
        _need(bool(self.targets), "an adapter needs target modules")


@dataclass(frozen=True)
class TrainingConfig:
    heads: tuple[str, ...] = ()
    dtype: str = "bfloat16"
    bf16: bool = True
    fp16: bool = False
    voice_cloning: bool = True
    contrastive: bool = True
    adapter: AdapterConfig | None = None

    def validate(self, codec: CodecConfig, build: BuildConfig | None = None) -> None:
        _need(not self.heads or len(self.heads) == codec.channels, f"{len(self.heads)} heads for {codec.channels} channels")
        _need(self.dtype in DTYPES, f"dtype must be one of {', '.join(DTYPES)}")
        _need(not (self.bf16 and self.fp16), "bf16 and fp16 exclude each other")
        _need(self.bf16 == (self.dtype == "bfloat16"), "bf16 goes with dtype bfloat16")
        _need(self.voice_cloning or not self.contrastive, "the contrastive loss needs voice cloning")
        _need(build is None or not self.voice_cloning or build.add_speaker, "voice cloning needs speaker ids")
        if self.adapter is not None:
            self.adapter.validate()
