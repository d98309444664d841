"""Packed codec tokens: one integer holds a digit for each level, least significant first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.config import CodecConfig


def bases(levels: Sequence[int]) -> list[int]:
    out, b = [], 1
    for level in levels:
        out.append(b)
        b *= level
    return out


def _digit(packed: Column, base: int, level: int) -> Column:
    return F.transform(packed, lambda k: F.pmod(F.floor(k / F.lit(base)).cast("int"), F.lit(level)))


def unfold(packed: Column, levels: Sequence[int]) -> list[Column]:
    """One array per level; null arrays and null codes stay null."""
    return [_digit(packed, b, n) for b, n in zip(bases(levels), levels)]


def _raised(total: Column, digit: Column, base: int) -> Column:
    return F.zip_with(total, digit, lambda s, x: (s + x * F.lit(base)).cast("int"))


def fold(digits: Sequence[Column], levels: Sequence[int]) -> Column:
    """The inverse of :func:`unfold`."""
    out = F.transform(digits[0], lambda x: x.cast("int"))
    for d, b in zip(digits[1:], bases(levels)[1:]):
        out = _raised(out, d, b)
    return out


def dequantise(code: Column, level: int) -> Column:
    """Digit array to values in [-1, 1]: (x - s) / s with s = max(1, level // 2)."""
    s = float(max(1, level // 2))
    return F.transform(code, lambda x: (x.cast("double") - F.lit(s)) / F.lit(s))


def channel_columns(codec: CodecConfig, layer: str = "nano_layer_{}") -> list[Column]:
    """``level_audio_i`` for every layer and level, or the layers themselves without unfolding."""
    out: list[Column] = []
    for i in range(codec.num_layers):
        packed = F.col(layer.format(i + 1))
        own = unfold(packed, codec.levels) if codec.unfold else [packed]
        out += [c.alias(f"level_audio_{len(out) + j}") for j, c in enumerate(own)]
    return out


def unfold_batches(df: DataFrame, codec: CodecConfig, layer: str = "nano_layer_{}", keep: Sequence[str] = ()) -> DataFrame:
    """The same by NumPy on whole Arrow list buffers, for wide tables: higher-order functions run outside generated code.

    Columns: ``keep`` and ``level_audio_0 ...``. Null lists stay null; null codes inside a list are not supported.
    """
    layers = [layer.format(i + 1) for i in range(codec.num_layers)]
    source = df.select(*keep, *layers)
    kept = [f for f in source.schema if f.name in keep]
    names = [f"level_audio_{i}" for i in range(codec.num_layers * len(codec.levels))]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} array<int>" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(codec.num_layers):
                lists = batch.column(len(kept) + i)
                flat = lists.values.to_numpy(zero_copy_only=False)
                for b, n in zip(bases(codec.levels), codec.levels):
                    digits = pa.array((flat // b % n).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(lists.offsets, digits, mask=lists.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *out], [*[f.name for f in kept], *names])

    return source.mapInArrow(run, schema)
