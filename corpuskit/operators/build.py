"""Corpus build: many sources to one table of training sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.config import BuildConfig, ConfigError, SourceConfig
from corpuskit.functions import codec as codec_functions
from corpuskit.functions import sequence, text
from corpuskit.functions.hashing import hash_key
from corpuskit.operators.ranking import global_position, ordered_rank
from corpuskit.operators.speakers import SENTINEL, null_rare, remove_rare, with_rarity
from corpuskit.operators.providers import Tokenizer, stand_in_tokenizer


def speaker_prefixes(sources: Sequence[SourceConfig]) -> dict[str, str]:
    """Four hex digits per source, pinned ones first; equal hashes step on to the next free value."""
    taken = {s.speaker_prefix: s.name for s in sources if s.speaker_prefix}
    out = {s.name: s.speaker_prefix for s in sources if s.speaker_prefix}
    for s in sources:
        if s.name in out:
            continue
        value = int(hashlib.md5(s.name.encode()).hexdigest()[:4], 16)
        while f"{value:04x}" in taken:
            value = (value + 1) % 65536
        out[s.name] = f"{value:04x}"
        taken[out[s.name]] = s.name
    return out


def canonical(df: DataFrame, renames: Mapping[str, str], has_speaker: bool = True) -> DataFrame:
    """Source columns under their canonical names; a source without speakers gets the sentinel as its only one."""
    missing = [c for c in renames if c not in df.columns]
    if missing:
        raise ConfigError(f"missing columns {missing}")
    out = df.withColumnsRenamed(dict(renames))
    return out if has_speaker else out.withColumn("speaker_id", F.lit(SENTINEL))


def usable(df: DataFrame, cfg: BuildConfig, filled: str | None = "nano_layer_1") -> DataFrame:
    """Rows with codes whose length is within the cap; a null length is out. Run before anything is counted.

    The cap is solved for frames on the driver, so it reaches the Parquet scan as a bound.
    """
    if filled:
        df = df.where(F.size(filled) > 0)
    return df.where(F.col("encoded_len") <= cfg.codec.max_frames(cfg.max_seconds)) if cfg.max_seconds else df


def capped(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows in the order of a hash of ``key``, all of them if there are fewer; no single-partition limit."""
    order = [hash_key(seed, *key), *key]
    return global_position(df, order, "_at").where(F.col("_at") < n).drop("_at")


def sequences(df: DataFrame, cfg: BuildConfig, ids: Column, key: Column | None = None) -> DataFrame:
    """S2 rows to sequences: channels, labels, mask; ``key`` draws which rows stay unrepeated."""
    names = list(cfg.codec.heads())
    n = F.size("_ids")
    repeats = text.repeat_count(n, cfg.layout) if key is None or not cfg.layout.enabled else text.sampled_repeat_count(n, key, cfg.layout)
    layers = [f"nano_layer_{i + 1}" for i in range(cfg.codec.num_layers)]
    rest = [c for c in df.columns if c not in layers and c != "text"]
    out = df.withColumn("_ids", ids).withColumn("text_ids", text.layout(F.col("_ids"), repeats, cfg.tokens))
    channels = [c for c in codec_functions.channel_columns(cfg.codec)]
    out = out.select(*rest, "text_ids", *channels)
    out = out.withColumns({c: sequence.with_last_twice(F.col(c)) for c in names})
    n_text, n_frames = F.size("text_ids"), F.size(names[0])
    return out.withColumns({f"labels_{c}": sequence.channel_labels(n_text, F.col(c)) for c in names}).withColumns({"labels_stop": sequence.stop_labels(n_text, n_frames), "attention_mask": sequence.attention_mask(n_text, n_frames)})


def build_source(df: DataFrame, source: SourceConfig, prefix: str, cfg: BuildConfig, tokenizer: Tokenizer = stand_in_tokenizer) -> DataFrame:
    """One source through filter, speaker policy, optional cap and sequences. ``df`` has canonical columns."""
    rows = usable(df, cfg)
    if cfg.add_speaker:
        if cfg.policy == "remove":
            rows = remove_rare(rows, cfg.min_clips).withColumn("speaker_id", F.concat(F.lit(f"{prefix}_"), F.coalesce("speaker_id", F.lit("None"))))
        elif source.speaker_column is None:
            rows = rows.withColumn("speaker_id", F.lit(SENTINEL))
        else:
            rows = null_rare(rows, cfg.min_clips, F.lit(prefix))
    if source.max_rows is not None:
        rows = capped(rows, source.max_rows, cfg.cap_seed, "row_id")
    tagged = text.language_tagged(F.col("text"), F.lit(source.language_tag).cast("string"))
    return sequences(tokenizer(rows.withColumn("text", tagged), "text", "_tokens"), cfg, F.col("_tokens"), F.col("row_id")).drop("_tokens").withColumn("source", F.lit(source.name))


def build_corpus(parts: Sequence[tuple[SourceConfig, DataFrame]], cfg: BuildConfig, tokenizer: Tokenizer = stand_in_tokenizer) -> DataFrame:
    """All sources under one schema; the row id of the whole table is added by :func:`with_row_ids`."""
    cfg.validate([s for s, _ in parts])
    prefixes = speaker_prefixes([s for s, _ in parts])
    return reduce(DataFrame.unionByName, [build_source(df, s, prefixes[s.name], cfg, tokenizer) for s, df in parts])


def build_tagged(df: DataFrame, sources: Sequence[SourceConfig], cfg: BuildConfig, tokenizer: Tokenizer = stand_in_tokenizer, number: str | None = None) -> DataFrame:
    """The same table from rows that carry their ``source``, in one pass whatever the number of sources.

    The speaker policy counts a speaker inside its source. Rows of other sources are out.
    With ``number`` the rows get their 0-based position in the order of source and row id,
    before the sequences make them long.
    """
    cfg.validate(sources)
    prefixes = speaker_prefixes(sources)
    known = [(s.name, prefixes[s.name], s.language_tag, s.speaker_column is not None, s.max_rows) for s in sources]
    facts = df.sparkSession.createDataFrame(known, "source string, _prefix string, _tag string, _has boolean, _cap int")  # a row for each source
    rows = usable(df, cfg).join(F.broadcast(facts), "source")
    if cfg.add_speaker:
        rows = rows.withColumn("_own", F.when(F.col("_has"), F.col("speaker_id")).otherwise(F.lit(SENTINEL)))
        rows = with_rarity(rows.withColumn("_key", F.concat_ws("|", "source", F.coalesce(F.concat(F.lit("="), "_own"), F.lit("null")))), cfg.min_clips, "_key")
        named = F.concat("_prefix", F.lit("_"), F.coalesce("_own", F.lit("None")))
        if cfg.policy == "remove":
            rows = rows.where(~F.col("is_rare")).withColumn("speaker_id", named)
        else:
            lost = F.col("is_rare") | F.coalesce(F.col("_own") == SENTINEL, F.lit(False))
            rows = rows.withColumn("speaker_id", F.when(lost, F.lit(SENTINEL)).otherwise(named))
        rows = rows.drop("_own", "_key", "is_rare")
    if any(s.max_rows is not None for s in sources):
        ranked = ordered_rank(rows, "source", [hash_key(cfg.cap_seed, "row_id"), "row_id"], "_at")
        rows = ranked.where(F.col("_cap").isNull() | (F.col("_at") < F.col("_cap"))).drop("_at")
    rows = rows.withColumn("text", text.language_tagged(F.col("text"), F.col("_tag"))).drop("_prefix", "_tag", "_has", "_cap")
    if number is not None:
        rows = with_row_ids(rows, ["source", "row_id"], number)
    return sequences(tokenizer(rows, "text", "_tokens"), cfg, F.col("_tokens"), F.col("row_id")).drop("_tokens")


def with_row_ids(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """0-based positions over the concatenated table, sources in the order of ``order``."""
    return global_position(df, [F.col(c) for c in order], out)
