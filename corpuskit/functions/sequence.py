"""Training sequences: labels, masks and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label that the loss skips; it is a value, not a null.
IGNORE = -100


def repeated(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(F.lit(0), n.cast("int")))


def with_last_twice(codes: Column) -> Column:
    """Codes and their last element again; empty stays empty."""
    return F.when(F.size(codes) > 0, F.concat(codes, F.slice(codes, -1, 1))).otherwise(codes)


def channel_labels(n_text: Column, codes: Column) -> Column:
    """Ignored text positions, the codes, one ignored end."""
    return F.concat(repeated(IGNORE, n_text), codes, F.array(F.lit(IGNORE)))


def stop_labels(n_text: Column, n_frames: Column) -> Column:
    return F.concat(repeated(IGNORE, n_text), repeated(0, n_frames), F.array(F.lit(1)))


def attention_mask(n_text: Column, n_frames: Column) -> Column:
    return repeated(1, n_text + n_frames + 1)


def left_padded(a: Column, width: Column, value: int) -> Column:
    return F.concat(repeated(value, width - F.size(a)), a)


def right_padded(a: Column, width: Column, value: int) -> Column:
    return F.concat(a, repeated(value, width - F.size(a)))


def rebased_labels(labels: Column, n_text: Column, max_text: Column, width: Column) -> Column:
    """Labels moved so that the audio begins at ``max_text``, padded with the ignored label to ``width``."""
    own = F.slice(labels, n_text + 1, F.greatest(F.lit(0), F.size(labels) - n_text))
    return right_padded(F.concat(repeated(IGNORE, max_text), own), width, IGNORE)


def padded_mask(n_text: Column, max_text: Column, n_audio: Column, max_audio: Column) -> Column:
    """Text right-aligned before ``max_text``, audio left-aligned after it."""
    return F.concat(repeated(0, max_text - n_text), repeated(1, n_text), repeated(1, n_audio), repeated(0, max_audio - n_audio))


def stacked(channels: Sequence[Column]) -> Column:
    """Channels as rows of time: [T][C], cut to the shortest channel."""
    least = F.least(*[F.size(c) for c in channels]) if len(channels) > 1 else F.size(channels[0])
    return F.transform(F.sequence(F.lit(0), least - 1), lambda t: F.array(*[F.get(c, t) for c in channels]))


def text_of(a: Column) -> Column:
    """Array as comma-separated text, for comparing across engines."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "null")


def unconditional_ids(mode: str, start_of_text: int, end_of_text: int, start_of_speech: int) -> list[int]:
    """Text ids of the branch without a text: its empty frame (``empty_text``) or the start of speech alone (``audio_only``)."""
    if mode not in ("empty_text", "audio_only"):
        raise ValueError(f"unknown mode {mode!r}")
    return [start_of_text, end_of_text, start_of_speech] if mode == "empty_text" else [start_of_speech]


def forced_layout(prefix: int, n_text: Column, n_frames: Column, width: Column, most_frames: Column) -> dict[str, Column]:
    """Mask and positions of a sequence prefix + text + frames, padded on the right to ``width`` positions.

    Frame t is predicted at the position before it and has its own state at its own
    position; both are given for ``most_frames`` frames, held inside the width.
    """
    start, last = F.lit(prefix) + n_text, width - 1
    steps = F.sequence(F.lit(0), most_frames - 1)
    return {
        "mask": F.concat(repeated(1, start + n_frames), repeated(0, width - start - n_frames)),
        "predict_at": F.transform(steps, lambda t: F.least(start - 1 + t, last)),
        "state_at": F.transform(steps, lambda t: F.least(start + t, last)),
        "valid": F.transform(steps, lambda t: (t < n_frames).cast("int")),
    }
