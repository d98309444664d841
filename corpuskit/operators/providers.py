"""Steps that need a model: pluggable providers, with deterministic stand-ins.

A provider is a function from DataFrame to DataFrame that adds a column; model-backed ones
work on Arrow batches.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.hashing import hash01, hash_int
from corpuskit.functions.text import stand_in_ids, words
from corpuskit.session import shuffle_width

#: (table, text column, new column) -> table with an ``array<int>`` column.
Tokenizer = Callable[[DataFrame, str, str], DataFrame]
#: (table, new column) -> table with the transcript of each row.
Recogniser = Callable[[DataFrame, str], DataFrame]
#: (table, new column) -> table with an ``array<double>`` voice vector, null where there is none.
Embedder = Callable[[DataFrame, str], DataFrame]


def stand_in_tokenizer(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, stand_in_ids(F.col(text)))


def file_tokenizer(path: str) -> Tokenizer:
    """A tokenizer read on every executor from a ``tokenizers`` JSON file, without special tokens."""

    def add(df: DataFrame, text: str, out: str) -> DataFrame:
        source = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        names = [*df.columns, out]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` array<int>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer as FileTokenizer

            model = FileTokenizer.from_file(path)
            model.encode_special_tokens = True
            for batch in batches:
                ids = [e.ids for e in model.encode_batch(batch.column(batch.num_columns - 1).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names)

        return source.mapInArrow(run, schema)

    return add


def stand_in_recogniser(text: str, key: str, loss: float = 0.1, seed: int = 0) -> Recogniser:
    """Drops each word of the true text with a given probability, by a hash of row and word position."""

    def add(df: DataFrame, out: str) -> DataFrame:
        kept = F.filter(words(F.col(text)), lambda w, i: hash01(seed, F.col(key), i) >= F.lit(loss))
        return df.withColumn(out, F.array_join(kept, " "))

    return add


def stand_in_embedder(speaker: str, size: int = 16, null_speaker: str = "__null__") -> Embedder:
    """A fixed vector for each speaker; null for the null speaker."""

    def add(df: DataFrame, out: str) -> DataFrame:
        vector = F.array(*[hash01("voice", F.col(speaker), F.lit(i)) - 0.5 for i in range(size)])
        return df.withColumn(out, F.when(F.col(speaker).isNotNull() & (F.col(speaker) != null_speaker), vector))

    return add


#: (groups with ``group_id, max_frames``, samples per group, the only samples wanted or None) -> one row per sample.
Policy = Callable[..., DataFrame]


def stand_in_policy(codes: int = 1024, seed: int = 0, spread: int = 400) -> Policy:
    """Samples ``tokens, n_frames, truncated`` of each group from hashes of group, sample and frame.

    A sample stops after a number of frames that is uniform in [1, ``spread``], or at the
    group's ``max_frames``, where it is truncated. Given ``wanted`` (``group_id, sample_idx``),
    no other samples are drawn; the rows then lie by these two columns.
    """

    def add(groups: DataFrame, samples: int, wanted: DataFrame | None = None) -> DataFrame:
        rows = groups.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        if wanted is not None:
            key = ["group_id", "sample_idx"]
            # a fixed number of partitions: by their size before drawing they would be merged into one task
            rows = rows.repartition(shuffle_width(rows.sparkSession), *key).join(wanted.select(*key).hint("merge"), key, "left_semi")
        stop = F.lit(1) + F.pmod(hash_int(f"{seed}:stop", "group_id", "sample_idx"), F.lit(spread))
        rows = rows.withColumn("truncated", stop > F.col("max_frames")).withColumn("n_frames", F.least(stop, F.col("max_frames")).cast("int"))
        first, step = hash_int(f"{seed}:first", "group_id", "sample_idx"), hash_int(f"{seed}:step", "group_id", "sample_idx")
        frames = F.sequence(F.lit(0), F.col("n_frames") - 1)
        # bound by an outer transform, the two are hashed once for a sample instead of once for a frame
        drawn = F.transform(F.array(F.struct(first.alias("first"), step.alias("step"))), lambda d: F.transform(frames, lambda i: F.pmod(d["first"] + i * d["step"], F.lit(codes)).cast("int")))
        return rows.withColumn("tokens", drawn[0])

    return add


def stand_in_prefixes(speakers: DataFrame, size: int = 4) -> DataFrame:
    """``speaker, prefix``: a fixed vector for each speaker, the null speaker's included like any other."""
    return speakers.select("speaker").distinct().withColumn("prefix", F.array(*[hash01("prefix", "speaker", F.lit(i)) for i in range(size)]))


#: (table with ``content``, new column) -> table with the waveform at the codec's rate as ``array<float>``.
Decoder = Callable[[DataFrame, str], DataFrame]


def wave_decoder(rate: int) -> Decoder:
    """Uncompressed 16-bit wave files to one channel at ``rate``, by the mean of the channels and linear interpolation; null where there is no such file."""

    def samples(content: bytes | None) -> np.ndarray | None:
        try:
            with wave.open(io.BytesIO(content or b"")) as f:
                if f.getsampwidth() != 2:
                    return None
                raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(1) / 32768.0
                at = np.arange(int(len(raw) * rate / f.getframerate())) * f.getframerate() / rate
                return np.interp(at, np.arange(len(raw)), raw).astype(np.float32) if len(raw) else raw.astype(np.float32)
        except (wave.Error, EOFError, ValueError):
            return None

    def add(df: DataFrame, out: str) -> DataFrame:
        rest = [f for f in df.schema if f.name != "content"]
        source = df.select(*[f.name for f in rest], "content")
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` array<float>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waves = pa.array([samples(c) for c in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], waves], [*[f.name for f in rest], out])

        return source.mapInArrow(run, schema)

    return add
