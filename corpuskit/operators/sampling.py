"""Training-time choices as tables: order, references, batches, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.config import BatchConfig, ConfigError, ReferenceConfig
from corpuskit.functions import sequence
from corpuskit.functions.hashing import hash_int, hash_key
from corpuskit.operators.ranking import global_position, ordered_rank
from corpuskit.operators.skew import heavy_hitters, sized_join, skew_join
from corpuskit.operators.speakers import SENTINEL
from corpuskit.session import materialize

NULL_SPEAKER = -1


def has_speaker(column: str = "speaker_id"):
    return F.col(column).isNotNull() & (F.col(column) != SENTINEL)


def shuffle_ranks(df: DataFrame, seed: int, key: str = "row_id", out: str = "shuffle_rank") -> DataFrame:
    """Position of every row in a shuffle that depends on the seed and the row's key only."""
    return global_position(df, [hash_key(seed, key), key], out)


def plain_batches(df: DataFrame, size: int, seed: int, key: str = "row_id") -> DataFrame:
    """``batch_id, slot`` by shuffle rank; the last batch may be short."""
    ranked = shuffle_ranks(df, seed, key, "_at")
    return ranked.withColumn("batch_id", F.floor(F.col("_at") / size)).withColumn("slot", (F.col("_at") % size).cast("int")).drop("_at")


def length_batches(df: DataFrame, length: str, size: int, key: Sequence[str]) -> DataFrame:
    """``batch_id`` of rows in the order of their length, so that batches need little padding."""
    return global_position(df, [length, *key], "_at").withColumn("batch_id", F.floor(F.col("_at") / size)).drop("_at")


def speaker_table(rows: DataFrame, cfg: ReferenceConfig, frame_rate: float) -> DataFrame:
    """``speaker_id, speaker_int, n_clips, has_long``: dense numbers in the order of the ids, null rows left out."""
    seconds = F.col("encoded_len") / F.lit(frame_rate)
    table = rows.where(has_speaker()).groupBy("speaker_id").agg(F.count("*").alias("n_clips"), F.bool_or(seconds >= cfg.min_reference_seconds).alias("has_long"))
    return global_position(table, ["speaker_id"], "speaker_int")


def speaker_index(rows: DataFrame, cfg: ReferenceConfig, frame_rate: float) -> DataFrame:
    """Adds ``speaker_int`` (-1 for null rows), ``n_clips`` and ``is_candidate``.

    Candidates for a reference are a speaker's clips of the least duration, or all of them
    if none is that long. The result is written once, as its users read it several times.
    """
    rows = materialize(rows)
    speakers = speaker_table(rows, cfg, frame_rate)
    heavy, _ = heavy_hitters(rows.where(has_speaker()), "speaker_id")
    known = skew_join(rows.where(has_speaker()), speakers, "speaker_id", heavy)
    seconds = F.col("encoded_len") / F.lit(frame_rate)
    known = known.withColumn("is_candidate", ~F.col("has_long") | (seconds >= cfg.min_reference_seconds)).drop("has_long")
    null = rows.where(~F.coalesce(has_speaker(), F.lit(False))).withColumns({"n_clips": F.lit(None).cast("bigint"), "speaker_int": F.lit(NULL_SPEAKER).cast("bigint"), "is_candidate": F.lit(False)})
    return materialize(known.unionByName(null))


def pick_references(index: DataFrame, cfg: ReferenceConfig, frame_rate: float, seed: int = 0) -> DataFrame:
    """``row_id, ref_row_id, kind, ref_start, ref_len`` for every row of a speaker index.

    ``cross``: another candidate of the speaker, uniform; ``self``: the row itself, if there
    is none or if self reference is on; ``null``: a one-frame placeholder. Candidates are
    numbered inside their speaker, a row draws a number that skips its own, and the number
    is looked up: linear in the rows, and a large speaker is many keys. References are
    sliced at random except the row itself when it is short.
    """
    least, most = int(cfg.min_slice_seconds * frame_rate), int(cfg.max_slice_seconds * frame_rate)
    frames = F.col("encoded_len") + 1
    known = index.where(F.col("speaker_int") != NULL_SPEAKER).select("row_id", "speaker_int", "encoded_len", "is_candidate")
    ranked = materialize(ordered_rank(known.where("is_candidate"), "speaker_int", ["row_id"], "_rank"))
    sizes = ranked.groupBy("speaker_int").agg(F.count("*").alias("_n"))
    heavy, _ = heavy_hitters(known, "speaker_int")
    sized = skew_join(known, sizes, "speaker_int", heavy)
    targets = sized.join(ranked.select("row_id", "_rank"), "row_id", "left")
    others = F.col("_n") - F.when(F.col("_rank").isNull(), 0).otherwise(1)
    draw = F.when(others > 0, F.pmod(hash_int(seed, "row_id"), others))
    want = F.when(F.col("_rank").isNotNull() & (draw >= F.col("_rank")), draw + 1).otherwise(draw)
    targets = targets.withColumn("_want", F.when(F.lit(cfg.self_reference), F.lit(None)).otherwise(want).cast("bigint"))
    refs = ranked.select("speaker_int", F.col("_rank").alias("_want"), F.col("row_id").alias("ref_row_id"), (frames).alias("_t"))
    found = targets.join(refs, ["speaker_int", "_want"], "left")
    found = found.withColumn("kind", F.when(F.col("ref_row_id").isNotNull(), "cross").otherwise("self"))
    found = found.withColumn("ref_row_id", F.coalesce("ref_row_id", "row_id")).withColumn("_t", F.coalesce("_t", frames))
    sliceable = ((F.col("kind") == "cross") | (F.col("encoded_len") / F.lit(frame_rate) >= cfg.min_self_slice_seconds)) & (F.least(F.lit(most), F.col("_t")) > least)
    span = F.least(F.lit(most), F.col("_t")) - least + 1
    length = F.when(sliceable, least + F.pmod(hash_int(f"{seed}:length", "row_id"), span)).otherwise(F.col("_t")).cast("int")
    found = found.withColumn("ref_len", length)
    start = F.when(F.col("ref_len") < F.col("_t"), F.pmod(hash_int(f"{seed}:start", "row_id"), F.col("_t") - F.col("ref_len") + 1)).otherwise(F.lit(0)).cast("int")
    found = found.withColumn("ref_start", start).select("row_id", "ref_row_id", "kind", "ref_start", "ref_len")
    null = index.where(F.col("speaker_int") == NULL_SPEAKER).select("row_id", F.lit(None).cast("bigint").alias("ref_row_id"), F.lit("null").alias("kind"), F.lit(0).alias("ref_start"), F.lit(1).alias("ref_len"))
    return found.unionByName(null)


def batch_count(index: DataFrame, cfg: BatchConfig, world: int = 1) -> DataFrame:
    """One row: eligible speakers and rows, null rows, and batches per epoch and rank."""
    eligible = (F.col("speaker_int") != NULL_SPEAKER) & (F.col("n_clips") >= cfg.clips)
    row = index.agg(F.count_distinct(F.when(eligible, F.col("speaker_int"))).alias("n_speakers"), F.count_if(eligible).alias("n_rows"), F.count_if(F.col("speaker_int") == NULL_SPEAKER).alias("n_null_rows"))
    return row.withColumn("n_batches", F.greatest(F.lit(1), F.floor(F.col("n_rows") / (cfg.speakers * cfg.clips * world))))


def speaker_batches(index: DataFrame, cfg: BatchConfig, epoch: int = 0, rank: int = 0) -> DataFrame:
    """``batch_id, slot, row_id, is_filler``: P speakers with K clips each, and M fillers without a speaker.

    One visit to every eligible speaker, in hash order; a last block of fewer than P
    speakers is dropped. K clips are the first by hash. Fillers go round the null rows in
    hash order, so a batch holds none twice if there are at least M; without null rows the
    eligible rows stand in. Raises if no speaker has K clips. This is less than an epoch,
    for which see :func:`epoch_batches`.
    """
    cfg.validate()
    seed = cfg.epoch_seed(epoch, rank)
    eligible = index.where((F.col("speaker_int") != NULL_SPEAKER) & (F.col("n_clips") >= cfg.clips))
    order = Window.partitionBy("speaker_int").orderBy(hash_key(seed, "row_id"), "row_id")
    clips = eligible.select("speaker_int", "row_id").withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") < cfg.clips)
    speakers = global_position(eligible.select("speaker_int").distinct(), [hash_key(seed, "speaker_int"), "speaker_int"], "_at")
    n_speakers = speakers.count()
    if not n_speakers:
        raise ConfigError(f"no speaker has {cfg.clips} clips")
    n_batches = n_speakers // cfg.speakers
    chosen = speakers.where(F.col("_at") < n_batches * cfg.speakers)
    grouped = clips.join(chosen, "speaker_int").select(F.floor(F.col("_at") / cfg.speakers).alias("batch_id"), ((F.col("_at") % cfg.speakers) * cfg.clips + F.col("_k")).cast("int").alias("slot"), "row_id", F.lit(False).alias("is_filler"))
    if not cfg.fillers or not n_batches:
        return grouped
    null = index.where(F.col("speaker_int") == NULL_SPEAKER).select("row_id")
    pool = null if null.head(1) else eligible.select("row_id")
    ranked = global_position(pool, [hash_key(f"{seed}:filler", "row_id"), "row_id"], "_at")
    size = ranked.count()
    slots = index.sparkSession.range(n_batches * cfg.fillers).select((F.col("id") / cfg.fillers).cast("bigint").alias("batch_id"), (F.lit(cfg.speakers * cfg.clips) + F.col("id") % cfg.fillers).cast("int").alias("slot"), (F.col("id") % size).alias("_at"))
    fillers = slots.join(ranked, "_at").select("batch_id", "slot", "row_id", F.lit(True).alias("is_filler"))
    return grouped.unionByName(fillers)


def _distinct_draws(n: Column, k: int, seed: str, *parts: str) -> Column:
    """Array of ``k`` different numbers in [0, n), all sets alike, by Floyd's method; n must be at least k."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(hash_int(seed, *parts, i), n - k + i + 1))
    # a number that is there already gives way to the one that is new in this step
    return F.aggregate(draws, F.array().cast("array<bigint>"), lambda got, x: F.array_append(got, F.when(F.array_contains(got, x), n - k + F.size(got)).otherwise(x)))


def epoch_batches(index: DataFrame, cfg: BatchConfig, epoch: int = 0, rank: int = 0, world: int = 1) -> DataFrame:
    """``batch_id, slot, row_id, is_filler``: as many batches as :func:`batch_count` says, each drawn anew.

    A batch draws P different speakers, alike whatever their clips, K different clips of
    each, out of all its clips, and M different fillers of the null rows (repeated if there
    are fewer than M); without null rows the eligible rows stand in. Speakers and clips are
    numbered, a batch draws numbers, and these are looked up: linear in the slots, and a
    large speaker is many keys. Raises if fewer than P speakers have K clips.
    """
    cfg.validate()
    seed = cfg.epoch_seed(epoch, rank)
    eligible = index.where((F.col("speaker_int") != NULL_SPEAKER) & (F.col("n_clips") >= cfg.clips))
    speakers = materialize(global_position(eligible.select("speaker_int", "n_clips").distinct(), ["speaker_int"], "_at"))
    n_speakers, n_rows = speakers.agg(F.count("*"), F.coalesce(F.sum("n_clips"), F.lit(0))).first()
    if n_speakers < cfg.speakers:
        raise ConfigError(f"a batch needs {cfg.speakers} speakers with {cfg.clips} clips, there are {n_speakers}")
    n_batches = max(1, n_rows // (cfg.speakers * cfg.clips * world))
    batches = index.sparkSession.range(n_batches).withColumnRenamed("id", "batch_id")
    chosen = batches.select("batch_id", F.posexplode(_distinct_draws(F.lit(n_speakers), cfg.speakers, f"{seed}:speaker", "batch_id")).alias("_p", "_at"))
    picks = F.posexplode(_distinct_draws(F.col("n_clips"), cfg.clips, f"{seed}:clip", "batch_id", "_p")).alias("_k", "_rank")
    wanted = sized_join(chosen, speakers, "_at").select("batch_id", "_p", "speaker_int", picks)
    clips = ordered_rank(eligible.select("speaker_int", "row_id"), "speaker_int", ["row_id"], "_rank")
    grouped = wanted.join(clips, ["speaker_int", "_rank"]).select("batch_id", (F.col("_p") * cfg.clips + F.col("_k")).cast("int").alias("slot"), "row_id", F.lit(False).alias("is_filler"))
    if not cfg.fillers:
        return grouped
    null = index.where(F.col("speaker_int") == NULL_SPEAKER).select("row_id")
    pool = materialize(global_position(null if null.head(1) else eligible.select("row_id"), ["row_id"], "_at"))
    size = pool.count()
    if size >= cfg.fillers:
        drawn = _distinct_draws(F.lit(size), cfg.fillers, f"{seed}:filler", "batch_id")
    else:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(cfg.fillers - 1)), lambda i: F.pmod(hash_int(f"{seed}:filler", "batch_id", i), F.lit(size)))
    slots = batches.select("batch_id", F.posexplode(drawn).alias("_m", "_at"))
    fillers = sized_join(slots, pool, "_at").select("batch_id", (F.lit(cfg.speakers * cfg.clips) + F.col("_m")).cast("int").alias("slot"), "row_id", F.lit(True).alias("is_filler"))
    return grouped.unionByName(fillers)


def collate(rows: DataFrame, channels: Sequence[str], pad: int, batch: str = "batch_id") -> DataFrame:
    """Rows with sequences padded to the longest of their batch; see :mod:`corpuskit.functions.sequence`.

    Only the greatest lengths of a batch are joined back, not its rows.
    """
    n_text, n_audio = F.size("text_ids"), F.size(channels[0])
    widths = rows.groupBy(batch).agg(F.max(n_text).alias("_max_text"), F.max(n_audio).alias("_max_audio"))
    both = rows.join(widths, batch)
    max_text, max_audio = F.col("_max_text"), F.col("_max_audio")
    width = max_text + max_audio
    new = {"attention_mask": sequence.padded_mask(n_text, max_text, n_audio, max_audio), "labels_stop": sequence.rebased_labels(F.col("labels_stop"), n_text, max_text, width)}
    new |= {f"labels_{c}": sequence.rebased_labels(F.col(f"labels_{c}"), n_text, max_text, width) for c in channels}
    new |= {c: sequence.right_padded(F.col(c), max_audio, 0) for c in channels}
    new["text_ids"] = sequence.left_padded(F.col("text_ids"), max_text, pad)
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def reference_codes(refs: DataFrame, table: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``row_id, ref_codes [T][C], ref_len, force_null``: the chosen slices, zeros of one frame for null rows."""
    own = table.select(F.col("row_id").alias("ref_row_id"), sequence.stacked([F.col(c) for c in channels]).alias("_codes"))
    joined = refs.where("kind <> 'null'").join(own, "ref_row_id")
    cut = joined.select("row_id", F.slice("_codes", F.col("ref_start") + 1, F.col("ref_len")).alias("ref_codes"), F.lit(0).alias("force_null"))
    zero = F.array(F.array_repeat(F.lit(0), len(channels)))
    null = refs.where("kind = 'null'").select("row_id", zero.alias("ref_codes"), F.lit(1).alias("force_null"))
    return cut.unionByName(null).withColumn("ref_len", F.size("ref_codes"))


def pad_references(rows: DataFrame, channels: int, batch: str = "batch_id") -> DataFrame:
    """``ref_codes`` padded with zero frames to the longest of the batch, and ``ref_mask``."""
    width = rows.groupBy(batch).agg(F.max("ref_len").alias("_max"))
    both = rows.join(width, batch)
    gap = F.col("_max") - F.col("ref_len")
    codes = F.concat("ref_codes", F.array_repeat(F.array_repeat(F.lit(0), channels), gap.cast("int")))
    mask = F.concat(sequence.repeated(1, F.col("ref_len")), sequence.repeated(0, gap))
    return both.withColumn("ref_codes", codes).withColumn("ref_mask", mask).drop("_max")


def speaker_summary(index: DataFrame) -> DataFrame:
    """One row: speakers, those with a single clip, null rows, and their percentages."""
    known = F.col("speaker_int") != NULL_SPEAKER
    row = index.agg(
        F.count("*").alias("_n"),
        F.count_distinct(F.when(known, F.col("speaker_int"))).alias("n_speakers"),
        F.count_if(known & (F.col("n_clips") == 1)).alias("n_singletons"),
        F.count_if(~known).alias("n_null_rows"),
    )
    percent = lambda a, b: F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return row.select("n_speakers", "n_singletons", "n_null_rows", percent("n_singletons", "n_speakers").alias("pct_singletons"), percent("n_null_rows", "_n").alias("pct_null_rows"))
