"""Queries of the corpus build: sources, speakers, codes, layouts, reweighting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.config import BuildConfig, CodecConfig, KeepConfig, LayoutConfig, SourceConfig, TokenConfig
from corpuskit.functions import codec as cf
from corpuskit.functions import sequence as sf
from corpuskit.functions import text as tf
from corpuskit.functions.hashing import hash01
from corpuskit.functions.numeric import round_half_up
from corpuskit.functions.speaker_ids import known_speaker
from corpuskit.operators import build, keep_index, providers, speakers
from corpuskit.operators.ranking import ordered_rank
from corpuskit.operators.scoring import latest_lines
from corpuskit.plans.registry import Registry, known_speaker_sql, table
from corpuskit.sources import readers

registry = Registry()

CODEC, LAYOUT, TOKENS, BUILD, KEEP = CodecConfig(), LayoutConfig(), TokenConfig(), BuildConfig(), KeepConfig(short_below=13, fraction=0.5, tail_cap=20)

_CLIP_COLUMNS = ["row_id", "source", "speaker_id", "recording_id", "text", "encoded_len"]

CLIPS_SQL = f"""
clip AS (SELECT row_id, source, {known_speaker_sql('speaker_id')} AS speaker_id, recording_id, text, encoded_len FROM clips WHERE row_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at DESC NULLS LAST, source DESC NULLS LAST, speaker_id DESC NULLS LAST, recording_id DESC NULLS LAST, text DESC NULLS LAST, encoded_len DESC NULLS LAST) = 1)"""


def clips_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, each in its latest delivery, with normal speaker ids."""
    rows = table(spark, sf_dir, "clips").where(F.col("row_id").isNotNull()).select("row_id", "ingested_at", *_CLIP_COLUMNS[1:])
    return latest_lines(rows, ["row_id"], "ingested_at").withColumn("speaker_id", known_speaker("speaker_id")).select(*_CLIP_COLUMNS)


def usable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.usable(clips_of(spark, sf_dir).where(F.col("text").isNotNull()), BUILD, filled=None)


USABLE_SQL = f"{CLIPS_SQL}, usable AS (SELECT * FROM clip WHERE encoded_len <= 860 AND text IS NOT NULL)"


def hash_sql(seed: str, *parts: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts) + "))"


def hash_int_sql(seed: str, *parts: str) -> str:
    return f"CAST('0x' || substr({hash_sql(seed, *parts)}, 1, 8) AS BIGINT)"


WORDS_SQL = r"list_filter(string_split_regex({t}, '[ \t\n\r\f]+'), lambda w: w <> '')"
IDS_SQL = "list_transform(" + WORDS_SQL + ", lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INT))"


def words_sql(t: str) -> str:
    return WORDS_SQL.format(t=t)


def ids_sql(t: str) -> str:
    return IDS_SQL.format(t=t)


def text_sql(a: str) -> str:
    return f"array_to_string({a}, ',')"


# ---- sources

@registry.query(
    """
WITH c AS (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY row_id, ingested_at NULLS FIRST, coalesce(speaker_id, '')) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM clips),
x AS (SELECT c.*, split_expr FROM c JOIN hf_datasets ON source = reponame)
SELECT source, count(*) AS n_rows, sum(row_id)::BIGINT AS row_id_sum FROM x
WHERE split_expr = 'train' OR pos < CAST(regexp_extract(split_expr, ':(\\d+)%', 1) AS INT) * n // 100 GROUP BY source"""
)
def q_split_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source under its split expression."""
    expressions = {r["reponame"]: r["split_expr"] for r in table(spark, sf_dir, "hf_datasets").collect()}
    order = ["row_id", F.col("ingested_at").asc_nulls_first(), F.coalesce("speaker_id", F.lit(""))]
    rows = readers.split_slices(table(spark, sf_dir, "clips").select("source", "row_id", "ingested_at", "speaker_id"), "source", expressions, order)
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("row_id_sum"))


@registry.query(f"""
WITH {USABLE_SQL} SELECT row_id, CASE WHEN speaker_id_col_name IS NULL THEN '__null_ref__' ELSE speaker_id END AS speaker_id, encoded_len AS n_frames, text AS transcript
FROM usable JOIN hf_datasets ON source = reponame""")
def q_rename_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable clips under other names; sources without a speaker column get the sentinel."""
    facts = F.broadcast(table(spark, sf_dir, "hf_datasets").select(F.col("reponame").alias("source"), "speaker_id_col_name"))  # the list of sources, a configuration table
    rows = build.canonical(usable_clips(spark, sf_dir), {"encoded_len": "n_frames", "text": "transcript"})
    rows = rows.join(facts, "source").withColumn("speaker_id", F.when(F.col("speaker_id_col_name").isNull(), speakers.SENTINEL).otherwise(F.col("speaker_id")))
    return rows.select("row_id", "speaker_id", "n_frames", "transcript")


@registry.query(f"""
WITH {CLIPS_SQL}, h AS (SELECT DISTINCT {known_speaker_sql('speaker_id')} AS s FROM holdout_speakers)
SELECT row_id, speaker_id FROM clip WHERE speaker_id IS NULL OR speaker_id NOT IN (SELECT s FROM h WHERE s IS NOT NULL)""")
def q_holdout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose speaker is not held out."""
    held = table(spark, sf_dir, "holdout_speakers").select(known_speaker("speaker_id").alias("speaker_id")).where("speaker_id IS NOT NULL").distinct()
    return clips_of(spark, sf_dir).select("row_id", "speaker_id").join(held, "speaker_id", "left_anti")


@registry.query(r"SELECT DISTINCT speaker, regexp_replace(regexp_extract('refs/v1.2/' || speaker || '.wav', '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM rollout_scores")
def q_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice names from the paths of their reference files."""
    names = table(spark, sf_dir, "rollout_scores").select("speaker").distinct()
    return names.withColumn("stem", tf.file_stem(F.concat(F.lit("refs/v1.2/"), F.col("speaker"), F.lit(".wav"))))


# ---- speakers

_COUNTED = f"WITH {USABLE_SQL}, n AS (SELECT speaker_id AS s, count(*) AS n FROM usable GROUP BY 1), r AS (SELECT usable.*, n FROM usable JOIN n ON speaker_id IS NOT DISTINCT FROM s)"


@registry.query(f"{_COUNTED} SELECT row_id, CASE WHEN n < 3 OR coalesce(speaker_id = '__null_ref__', false) THEN '__null_ref__' ELSE 'ab12_' || coalesce(speaker_id, 'None') END AS speaker_id FROM r")
def q_speaker_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare speakers to the sentinel, others under a prefix."""
    return speakers.null_rare(usable_clips(spark, sf_dir).select("row_id", "speaker_id"), 3, F.lit("ab12"))


@registry.query(f"{_COUNTED} SELECT row_id, speaker_id FROM r WHERE n >= 3")
def q_speaker_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of rare speakers removed."""
    return speakers.remove_rare(usable_clips(spark, sf_dir).select("row_id", "speaker_id"), 3)


def _buckets_sql(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (n >= {lo}{f' AND n <= {hi}' if hi else ''}) AS \"{prefix}{name}\"" for name, lo, hi in speakers.HISTOGRAM)


@registry.query(f"WITH {USABLE_SQL}, n AS (SELECT count(*) AS n FROM usable GROUP BY speaker_id) SELECT {_buckets_sql()} FROM n")
def q_clip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers by number of clips."""
    return speakers.histogram(speakers.clip_counts(usable_clips(spark, sf_dir)))


_SENTINEL_SPEAKER_SQL = "CASE WHEN speaker_id_col_name IS NULL THEN '__null_ref__' ELSE speaker_id END"


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.broadcast(table(spark, sf_dir, "hf_datasets").select(F.col("reponame").alias("source"), "speaker_id_col_name", "speaker_prefix", "language_tag"))
    return usable_clips(spark, sf_dir).join(facts, "source").withColumn("speaker_id", F.when(F.col("speaker_id_col_name").isNull(), speakers.SENTINEL).otherwise(F.col("speaker_id"))).drop("speaker_id_col_name")


@registry.query(f"""
WITH {USABLE_SQL}, c AS (SELECT source, {_SENTINEL_SPEAKER_SQL} AS s, count(*) AS n FROM usable JOIN hf_datasets ON source = reponame GROUP BY ALL),
f AS (SELECT source, n, coalesce(s = '__null_ref__', false) AS z, n < 3 AND NOT coalesce(s = '__null_ref__', false) AS low FROM c),
a AS (SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_speakers, count(*) FILTER (low) AS n_rare_speakers, coalesce(sum(n) FILTER (low), 0)::BIGINT AS n_rare_rows,
  count(*) FILTER (NOT low) AS n_eligible_speakers, coalesce(sum(n) FILTER (NOT low), 0)::BIGINT AS n_eligible_rows, coalesce(sum(n) FILTER (low OR z), 0)::BIGINT AS z, {_buckets_sql('n_speakers_')} FROM f GROUP BY ROLLUP (source))
SELECT * EXCLUDE z, floor(100.0::DOUBLE * n_rare_rows / greatest(1, n_rows) * 100 + 0.5) / 100 AS pct_null_exposure, floor(100.0::DOUBLE * z / greatest(1, n_rows) * 100 + 0.5) / 100 AS pct_null_exposure_corrected FROM a""")
def q_speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per source and for all."""
    return speakers.speaker_statistics(_by_source(spark, sf_dir).select("source", "speaker_id"), "source", 3)


# ---- codes

def _unfold_sql(layer: int, base: int, level: int) -> str:
    return f"list_transform(nano_layer_{layer}, lambda k: k // {base} % {level})"


_ALL_CHANNELS = [(i + 1, b, n) for i in range(8) for b, n in zip(cf.bases(CODEC.levels), CODEC.levels)]


@registry.query("SELECT row_id, " + ", ".join(f"{text_sql(_unfold_sql(*c))} AS level_audio_{i}" for i, c in enumerate(_ALL_CHANNELS)) + " FROM clip_codes")
def q_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 channels, by the Arrow form."""
    wide = cf.unfold_batches(table(spark, sf_dir, "clip_codes"), CODEC, keep=["row_id"])
    return wide.select("row_id", *[sf.text_of(F.col(c)).alias(c) for c in CODEC.heads()])


@registry.query("SELECT row_id, " + ", ".join(f"{text_sql(_unfold_sql(*c))} AS level_audio_{i}" for i, c in enumerate(_ALL_CHANNELS)) + " FROM clip_codes")
def q_unfold_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 channels, by column expressions."""
    return table(spark, sf_dir, "clip_codes").select("row_id", *cf.channel_columns(CODEC)).select("row_id", *[sf.text_of(F.col(c)).alias(c) for c in CODEC.heads()])


@registry.query("SELECT row_id, " + ", ".join(f"{text_sql(f'nano_layer_{i}')} AS packed_{i}" for i in range(1, 9)) + " FROM clip_codes")
def q_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfolded and folded again."""
    return table(spark, sf_dir, "clip_codes").select("row_id", *[sf.text_of(cf.fold(cf.unfold(F.col(f"nano_layer_{i}"), CODEC.levels), CODEC.levels)).alias(f"packed_{i}") for i in range(1, 9)])


def _mean_sql(layer: int, base: int, level: int) -> str:
    s = float(max(1, level // 2))
    return f"floor(list_sum(list_transform({_unfold_sql(layer, base, level)}, lambda x: (x - {s}::DOUBLE) / {s}::DOUBLE)) * 1e6 + 0.5) / 1e6"


@registry.query("SELECT row_id, " + ", ".join(f"{_mean_sql(*c)} AS sum_{i}" for i, c in enumerate(_ALL_CHANNELS)) + " FROM clip_codes")
def q_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed values of all channels in [-1, 1]."""
    digits = [(d, n) for i in range(1, 9) for d, n in zip(cf.unfold(F.col(f"nano_layer_{i}"), CODEC.levels), CODEC.levels)]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "clip_codes").select("row_id", *[round_half_up(total(cf.dequantise(d, n)), 6).alias(f"sum_{i}") for i, (d, n) in enumerate(digits)])


# ---- text layout

@registry.query(f"WITH {CLIPS_SQL} SELECT row_id, CASE WHEN language_tag IS NULL THEN text ELSE lower(language_tag) || ': ' || text END AS tagged FROM clip JOIN hf_datasets ON source = reponame")
def q_language_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind their source's language tag."""
    facts = F.broadcast(table(spark, sf_dir, "hf_datasets").select(F.col("reponame").alias("source"), "language_tag"))
    return clips_of(spark, sf_dir).join(facts, "source").select("row_id", tf.language_tagged(F.col("text"), F.col("language_tag")).alias("tagged"))


_R_SQL = "CASE WHEN n <= 0 OR n >= 13 OR n >= 16 THEN 1 ELSE greatest(1, least(CAST(ceil(16.0::DOUBLE / n) AS INT), 8)) END"
_BLOCK_SQL = "[248073] || ids || [248074]"
_LAYOUT_SQL = f"""WITH {CLIPS_SQL}, t AS (SELECT row_id, {ids_sql('text')} AS ids FROM clip WHERE text IS NOT NULL), n AS (SELECT *, len(ids) AS n FROM t), r AS (SELECT *, {_R_SQL} AS r FROM n),
l AS (SELECT row_id, n, r, flatten(list_transform(range(r), lambda i: {_BLOCK_SQL})) || [248070] AS text_ids FROM r)"""


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips_of(spark, sf_dir).where(F.col("text").isNotNull()).select("row_id", tf.stand_in_ids(F.col("text")).alias("ids"))
    rows = rows.withColumn("n", F.size("ids")).withColumn("r", tf.repeat_count(F.col("n"), LAYOUT))
    return rows.withColumn("text_ids", tf.layout(F.col("ids"), F.col("r"), TOKENS))


@registry.query(f"{_LAYOUT_SQL} SELECT row_id, n, r, {text_sql('text_ids')} AS text_ids FROM l")
def q_text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts repeated between their marks."""
    return _laid_out(spark, sf_dir).select("row_id", "n", "r", sf.text_of(F.col("text_ids")).alias("text_ids"))


@registry.query(f"{_LAYOUT_SQL} SELECT row_id, n AS orig_len FROM l")
def q_orig_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths recovered from the layouts; the SQL has them from before."""
    return _laid_out(spark, sf_dir).select("row_id", tf.original_length(F.col("text_ids"), TOKENS).alias("orig_len"))


@registry.query(f"{_LAYOUT_SQL} SELECT row_id, CASE WHEN r > 1 AND {hash_int_sql('0', 'row_id')} / 4294967296.0::DOUBLE < 0.25 THEN 1 ELSE r END AS r FROM l")
def q_mixed_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat counts when a quarter of the short texts stays single."""
    return _laid_out(spark, sf_dir).select("row_id", tf.sampled_repeat_count(F.col("n"), F.col("row_id"), LAYOUT).alias("r"))


# ---- sequences

_PREPARED_SQL = f"""
WITH {CLIPS_SQL}, k AS (SELECT c.*, clip.text, clip.speaker_id, clip.source FROM clip_codes c JOIN clip USING (row_id) WHERE len(nano_layer_1) > 0 AND c.encoded_len <= 860 AND text IS NOT NULL),
t AS (SELECT *, {ids_sql('text')} AS ids FROM k), n AS (SELECT *, len(ids) AS n FROM t), r AS (SELECT *, {_R_SQL} AS r0 FROM n),
s AS (SELECT *, CASE WHEN r0 > 1 AND {hash_int_sql('0', 'row_id')} / 4294967296.0::DOUBLE < 0.25 THEN 1 ELSE r0 END AS r FROM r),
l AS (SELECT *, flatten(list_transform(range(r), lambda i: {_BLOCK_SQL})) || [248070] AS text_ids, {_unfold_sql(1, 1, 8)} AS c FROM s),
p AS (SELECT *, len(text_ids) AS nt, c || [c[-1]] AS codes, len(c) + 1 AS m FROM l)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with codes as full training sequences."""
    codes = table(spark, sf_dir, "clip_codes")
    rows = codes.join(clips_of(spark, sf_dir).where(F.col("text").isNotNull()).select("row_id", "text", "speaker_id", "source"), "row_id")
    usable = build.usable(rows, BUILD)
    return build.sequences(providers.stand_in_tokenizer(usable, "text", "_tokens"), BUILD, F.col("_tokens"), F.col("row_id")).drop("_tokens")


def codes_sql(channel: int) -> str:
    """SQL of a channel of ``_PREPARED_SQL``, its last code twice."""
    own = _unfold_sql(*_ALL_CHANNELS[channel])
    return f"({own} || [({own})[-1]])"


@registry.query(
    f"{_PREPARED_SQL} SELECT row_id, {text_sql('text_ids')} AS text_ids, "
    + ", ".join(f"{text_sql(codes_sql(i))} AS level_audio_{i}, {text_sql(f'list_transform(range(nt), lambda i: -100) || {codes_sql(i)} || [-100]')} AS labels_level_audio_{i}" for i in range(CODEC.channels))
    + " FROM p"
)
def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, all channels and their labels."""
    rows = prepared(spark, sf_dir)
    return rows.select("row_id", *[sf.text_of(F.col(c)).alias(c) for c in ("text_ids", *CODEC.heads(), *[f"labels_{c}" for c in CODEC.heads()])])


@registry.query(f"{_PREPARED_SQL} SELECT row_id, {text_sql('list_transform(range(nt), lambda i: -100) || list_transform(range(m), lambda i: 0) || [1]')} AS labels_stop, nt + m + 1 AS n_mask FROM p")
def q_stop_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop labels, and the length of the all-ones mask."""
    rows = prepared(spark, sf_dir)
    return rows.select("row_id", sf.text_of(F.col("labels_stop")).alias("labels_stop"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_mask"))


# ---- build

_SOURCE_ORDER = "SELECT reponame, speaker_prefix, speaker_id_col_name, row_number() OVER (ORDER BY reponame) AS ord FROM hf_datasets"


@registry.query(f"""
WITH {USABLE_SQL}, o AS ({_SOURCE_ORDER}), c AS (SELECT u.*, ord, speaker_prefix, {_SENTINEL_SPEAKER_SQL} AS s FROM usable u JOIN o ON source = reponame),
n AS (SELECT source, s, count(*) AS n FROM c GROUP BY ALL),
j AS (SELECT c.*, n FROM c JOIN n ON c.source = n.source AND c.s IS NOT DISTINCT FROM n.s)
SELECT row_number() OVER (ORDER BY ord, row_id) - 1 AS corpus_row, row_id, source,
  CASE WHEN n < 3 OR coalesce(s = '__null_ref__', false) THEN '__null_ref__' ELSE speaker_prefix || '_' || coalesce(s, 'None') END AS speaker_id FROM j""")
def q_build_union_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, speakers namespaced, with one dense row id."""
    rows = _by_source(spark, sf_dir).select("row_id", "source", "speaker_id", "speaker_prefix")
    rows = rows.withColumn("_s", F.concat_ws("|", "source", F.coalesce(F.concat(F.lit("="), "speaker_id"), F.lit("null"))))
    rare = speakers.with_rarity(rows, 3, "_s")
    lost = F.col("is_rare") | F.coalesce(F.col("speaker_id") == speakers.SENTINEL, F.lit(False))
    named = F.when(lost, speakers.SENTINEL).otherwise(F.concat("speaker_prefix", F.lit("_"), F.coalesce("speaker_id", F.lit("None"))))
    return build.with_row_ids(rare.select("row_id", "source", named.alias("speaker_id")), ["source", "row_id"], "corpus_row")


@registry.query(f"WITH {USABLE_SQL} SELECT row_id, source FROM usable QUALIFY row_number() OVER (PARTITION BY source ORDER BY {hash_sql('42', 'row_id')}, row_id) <= 50")
def q_cap_max_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 rows of each source in hash order: the cap is the feature."""
    from corpuskit.functions.hashing import hash_key

    ranked = ordered_rank(usable_clips(spark, sf_dir).select("row_id", "source"), "source", [hash_key(42, "row_id"), "row_id"], "_at")
    return ranked.where(F.col("_at") < 50).where(F.col("source").isNotNull()).drop("_at")


@registry.query(f"WITH {USABLE_SQL} SELECT (SELECT count(*) FROM clips) AS delivered, (SELECT count(*) FROM clip) AS clips, (SELECT count(*) FROM usable) AS usable")
def q_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each stage."""
    stages = {"delivered": table(spark, sf_dir, "clips"), "clips": clips_of(spark, sf_dir), "usable": usable_clips(spark, sf_dir)}
    rows = [df.agg(F.count("*").alias(name)) for name, df in stages.items()]
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    return both.agg(*[F.sum(name).alias(name) for name in stages])


# ---- reweighting

_KEEP_SQL = f"""{_LAYOUT_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (n < 13) AS s, count(*) FILTER (n >= 13 AND n <= 20) AS e, count(*) FILTER (n > 20) AS t FROM l),
w AS (SELECT n AS n_rows, s AS n_short, e AS n_long_eligible, t AS n_tail_dropped, least(greatest(0, CAST(round_even(n * 0.5, 0) AS BIGINT) - s), e) AS n_long_kept FROM s),
p AS (SELECT row_id, n FROM l WHERE n >= 13 AND n <= 20 QUALIFY row_number() OVER (ORDER BY {hash_sql('44', 'row_id')}, row_id) <= (SELECT n_long_kept FROM w)),
k AS (SELECT row_id, 0 AS copy, n AS orig_len FROM l WHERE n < 13 UNION ALL SELECT row_id, 0, n FROM p)"""


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, sf_dir).select("row_id", tf.original_length(F.col("text_ids"), TOKENS).alias("orig_len"))


@registry.query(f"{_KEEP_SQL} SELECT row_id, copy, orig_len FROM k")
def q_keep_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All short rows and as many long ones as half of the corpus leaves."""
    return keep_index.keep_index(_lengths(spark, sf_dir), KEEP)


@registry.query(f"{_KEEP_SQL} SELECT n_rows, n_short, n_short AS n_short_kept, n_long_eligible, n_tail_dropped, n_long_kept, n_short + n_long_kept AS n_kept, n_short::DOUBLE / greatest(1, n_short + n_long_kept) AS short_share FROM w")
def q_keep_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keep index makes of the corpus."""
    return keep_index.keep_report(_lengths(spark, sf_dir), KEEP)


@registry.query(f"{_KEEP_SQL} SELECT row_id, copy, speaker_id, source FROM k JOIN clip USING (row_id)")
def q_keep_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows themselves."""
    index = keep_index.keep_index(_lengths(spark, sf_dir), KEEP)
    return keep_index.gather(clips_of(spark, sf_dir).select("row_id", "speaker_id", "source"), index)


@registry.query(f"WITH {CLIPS_SQL} SELECT row_id, {hash_int_sql('7', 'row_id')} / 4294967296.0::DOUBLE AS u FROM clip")
def q_hash01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniform draw of each clip."""
    return clips_of(spark, sf_dir).select("row_id", hash01(7, "row_id").alias("u"))


@registry.query()
def q_build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over all sources with codes, in one pass; it carries all 32 channels."""
    codes = table(spark, sf_dir, "clip_codes").drop("encoded_len")
    rows = codes.join(clips_of(spark, sf_dir).where("text IS NOT NULL"), "row_id")
    facts = table(spark, sf_dir, "hf_datasets").collect()
    sources = [SourceConfig(r["reponame"], r["speaker_id_col_name"], r["speaker_prefix"], r["language_tag"]) for r in sorted(facts, key=lambda r: r["reponame"])]
    return build.build_tagged(rows.drop("recording_id"), sources, BUILD, number="corpus_row")
