"""Queries of sampling, rollouts, scores, pairs, losses, seeds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.config import BatchConfig, PairConfig, PreferenceConfig, ReferenceConfig, RewardConfig, RolloutConfig
from corpuskit.functions import numeric, sequence, text
from corpuskit.functions.hashing import hash_int
from corpuskit.functions.numeric import round_half_up
from corpuskit.operators import losses, pairs, rollouts, sampling, scoring, seeds
from corpuskit.plans.corpus_queries import _PREPARED_SQL, CODEC, TOKENS, USABLE_SQL, codes_sql, hash_int_sql, hash_sql, prepared, text_sql, usable_clips, words_sql
from corpuskit.plans.registry import Registry, known_speaker_sql, table
from corpuskit.streaming import progress

registry = Registry()

REFERENCE, BATCH, ROLLOUT, REWARD, PAIR, PREFERENCE = ReferenceConfig(), BatchConfig(speakers=4, clips=3, fillers=4), RolloutConfig(), RewardConfig(), PairConfig(), PreferenceConfig()


def _r(expression: str, digits: int = 6) -> str:
    """SQL of :func:`round_half_up`."""
    return f"(floor(({expression}) * 1e{digits}::DOUBLE + 0.5) / 1e{digits}::DOUBLE + 0.0)"


# ---- order and batches

@registry.query(f"WITH {USABLE_SQL} SELECT row_id, row_number() OVER (ORDER BY {hash_sql('44', 'row_id')}, row_id) - 1 AS shuffle_rank FROM usable")
def q_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle that depends on seed and row id only."""
    return sampling.shuffle_ranks(usable_clips(spark, sf_dir).select("row_id"), 44)


@registry.query(f"WITH {USABLE_SQL}, s AS (SELECT row_id, row_number() OVER (ORDER BY {hash_sql('42', 'row_id')}, row_id) - 1 AS pos FROM usable) SELECT row_id, pos // 64 AS batch_id, pos % 64 AS slot FROM s")
def q_plain_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled batches of 64."""
    return sampling.plain_batches(usable_clips(spark, sf_dir).select("row_id"), 64, 42)


@registry.query(f"WITH {USABLE_SQL} SELECT row_id, encoded_len, (row_number() OVER (ORDER BY encoded_len, row_id) - 1) // 32 AS batch_id FROM usable")
def q_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 clips of like length."""
    return sampling.length_batches(usable_clips(spark, sf_dir).select("row_id", "encoded_len"), "encoded_len", 32, ["row_id"])


_INDEX_SQL = f"""WITH {USABLE_SQL}, s AS (SELECT speaker_id AS s, count(*) AS n_clips, bool_or(encoded_len / 21.5::DOUBLE >= 3) AS has_long, row_number() OVER (ORDER BY speaker_id) - 1 AS speaker_int FROM usable WHERE speaker_id IS NOT NULL GROUP BY 1),
i AS (SELECT row_id, encoded_len, speaker_id, n_clips, coalesce(speaker_int, -1) AS speaker_int, CASE WHEN s IS NULL THEN false ELSE NOT has_long OR encoded_len / 21.5::DOUBLE >= 3 END AS is_candidate FROM usable LEFT JOIN s ON speaker_id = s)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.speaker_index(usable_clips(spark, sf_dir).select("row_id", "encoded_len", "speaker_id"), REFERENCE, CODEC.frame_rate)


@registry.query(f"{_INDEX_SQL} SELECT * FROM i")
def q_speaker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker numbers, clip counts and reference candidates."""
    return _index(spark, sf_dir)


@registry.query(f"""{_INDEX_SQL}, c AS (SELECT row_id, speaker_int, encoded_len, row_number() OVER (PARTITION BY speaker_int ORDER BY row_id) - 1 AS rank, count(*) OVER (PARTITION BY speaker_int) AS n FROM i WHERE speaker_int >= 0 AND is_candidate),
n AS (SELECT DISTINCT speaker_int, n FROM c),
t AS (SELECT i.row_id, i.speaker_int, i.encoded_len, c.rank, n.n - CASE WHEN c.rank IS NULL THEN 0 ELSE 1 END AS others FROM i JOIN n USING (speaker_int) LEFT JOIN c USING (row_id) WHERE i.speaker_int >= 0),
d AS (SELECT *, CASE WHEN others > 0 THEN {hash_int_sql('0', 'row_id')} % others END AS draw FROM t),
w AS (SELECT *, CASE WHEN rank IS NOT NULL AND draw >= rank THEN draw + 1 ELSE draw END AS want FROM d),
f AS (SELECT w.row_id, w.encoded_len, coalesce(c.row_id, w.row_id) AS ref_row_id, CASE WHEN c.row_id IS NULL THEN 'self' ELSE 'cross' END AS kind, coalesce(c.encoded_len, w.encoded_len) + 1 AS t FROM w LEFT JOIN c ON c.speaker_int = w.speaker_int AND c.rank = w.want),
l AS (SELECT *, CASE WHEN (kind = 'cross' OR encoded_len / 21.5::DOUBLE >= 6) AND least(322, t) > 64 THEN 64 + {hash_int_sql('0:length', 'row_id')} % (least(322, t) - 64 + 1) ELSE t END AS ref_len FROM f)
SELECT row_id, ref_row_id, kind, CASE WHEN ref_len < t THEN {hash_int_sql('0:start', 'row_id')} % (t - ref_len + 1) ELSE 0 END AS ref_start, ref_len FROM l
UNION ALL SELECT row_id, NULL, 'null', 0, 1 FROM i WHERE speaker_int < 0""")
def q_ref_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference clip, and the slice of it, for every clip."""
    return sampling.pick_references(_index(spark, sf_dir), REFERENCE, CODEC.frame_rate)


@registry.query(f"{_INDEX_SQL}, e AS (SELECT count(DISTINCT speaker_int) FILTER (n_clips >= 3) AS n_speakers, count(*) FILTER (n_clips >= 3) AS n_rows, count(*) FILTER (speaker_int < 0) AS n_null_rows FROM i) SELECT *, greatest(1, n_rows // 12) AS n_batches FROM e")
def q_batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches an epoch holds."""
    return sampling.batch_count(_index(spark, sf_dir), BATCH)


@registry.query(f"""{_INDEX_SQL}, e AS (SELECT speaker_int, row_id FROM i WHERE n_clips >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY speaker_int ORDER BY {hash_sql('42', 'row_id')}, row_id) - 1 AS k FROM e QUALIFY k < 3),
sp AS (SELECT speaker_int, row_number() OVER (ORDER BY {hash_sql('42', 'speaker_int')}, speaker_int) - 1 AS pos, count(*) OVER () // 4 AS nb FROM (SELECT DISTINCT speaker_int FROM e)),
z AS (SELECT row_id, row_number() OVER (ORDER BY {hash_sql('42:filler', 'row_id')}, row_id) - 1 AS pos, count(*) OVER () AS n FROM i WHERE speaker_int < 0),
g AS (SELECT unnest(range((SELECT max(nb) FROM sp) * 4)) AS id)
SELECT pos // 4 AS batch_id, pos % 4 * 3 + k AS slot, row_id, false AS is_filler FROM k JOIN sp USING (speaker_int) WHERE pos < nb * 4
UNION ALL SELECT id // 4, 12 + id % 4, row_id, true FROM g JOIN z ON z.pos = id % n""")
def q_pk_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 4 speakers with 3 clips each and 4 clips without a speaker: one visit to every speaker."""
    return sampling.speaker_batches(_index(spark, sf_dir), BATCH)


def _draws_sql(n: str, k: int, seed: str, *parts: str) -> str:
    """Select list of d0 ... d(k-1): SQL of ``k`` different numbers in [0, n)."""
    out = []
    for i in range(k):
        x = f"{hash_int_sql(seed, *parts, str(i))} % ({n} - {k - 1 - i})"
        out.append(f"CASE WHEN {x} IN ({', '.join(f'd{j}' for j in range(i))}) THEN {n} - {k - i} ELSE {x} END AS d{i}" if i else f"{x} AS d{i}")
    return ", ".join(out)


def _epoch_sql(seed: int, world: int) -> str:
    return f"""{_INDEX_SQL}, e AS (SELECT speaker_int, n_clips, row_id, row_number() OVER (PARTITION BY speaker_int ORDER BY row_id) - 1 AS rank FROM i WHERE n_clips >= 3),
sp AS (SELECT speaker_int, n_clips, row_number() OVER (ORDER BY speaker_int) - 1 AS pos FROM (SELECT DISTINCT speaker_int, n_clips FROM e)),
n AS (SELECT (SELECT count(*) FROM sp) AS ns, (SELECT greatest(1, sum(n_clips)::BIGINT // {12 * world}) FROM sp) AS nb, (SELECT count(*) FROM i WHERE speaker_int < 0) AS nz),
b AS (SELECT unnest(range(nb)) AS batch_id, ns, nz FROM n),
sd AS (SELECT batch_id, {_draws_sql('ns', 4, f'{seed}:speaker', 'batch_id')} FROM b),
p AS (SELECT batch_id, unnest(range(4)) AS p, unnest([d0, d1, d2, d3]) AS pos FROM sd),
q AS (SELECT batch_id, p, speaker_int, {_draws_sql('n_clips', 3, f'{seed}:clip', 'batch_id', 'p')} FROM p JOIN sp USING (pos)),
c AS (SELECT batch_id, p, speaker_int, unnest(range(3)) AS k, unnest([d0, d1, d2]) AS rank FROM q),
z AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM i WHERE speaker_int < 0),
f AS (SELECT batch_id, {_draws_sql('nz', 4, f'{seed}:filler', 'batch_id')} FROM b),
g AS (SELECT batch_id, unnest(range(4)) AS m, unnest([d0, d1, d2, d3]) AS pos FROM f)
SELECT batch_id, p * 3 + k AS slot, row_id, false AS is_filler FROM c JOIN e USING (speaker_int, rank)
UNION ALL SELECT batch_id, 12 + m, row_id, true FROM g JOIN z USING (pos)"""


@registry.query(_epoch_sql(42, 1))
def q_pk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole epoch of batches of four speakers with three clips each and four fillers: as many as q_batch_count says."""
    return sampling.epoch_batches(_index(spark, sf_dir), BATCH)


@registry.query(_epoch_sql(42 + 1009 + 7, 2))
def q_pk_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch of the second of two ranks."""
    return sampling.epoch_batches(_index(spark, sf_dir), BATCH, epoch=1, rank=1, world=2)


@registry.query(f"""{_PREPARED_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY {hash_sql('42', 'row_id')}, row_id) - 1) // 16 AS batch_id FROM p),
w AS (SELECT *, max(nt) OVER (PARTITION BY batch_id) AS mt, max(m) OVER (PARTITION BY batch_id) AS ma FROM b)
SELECT batch_id, row_id, {text_sql('list_transform(range(mt - nt), lambda i: 248076) || text_ids')} AS text_ids,
{", ".join(f"{text_sql(f'{codes_sql(i)} || list_transform(range(ma - m), lambda i: 0)')} AS level_audio_{i}, {text_sql(f'list_transform(range(mt), lambda i: -100) || {codes_sql(i)} || [-100] || list_transform(range(ma - m - 1), lambda i: -100)')} AS labels_level_audio_{i}" for i in range(CODEC.channels))},
{text_sql('list_transform(range(mt - nt), lambda i: 0) || list_transform(range(nt + m), lambda i: 1) || list_transform(range(ma - m), lambda i: 0)')} AS attention_mask FROM w""")
def q_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences padded to their batch; the end label of the longest row is beyond the frame, as in training."""
    channels = list(CODEC.heads())
    labels = [f"labels_{c}" for c in channels]
    batched = sampling.plain_batches(prepared(spark, sf_dir).select("row_id", "text_ids", *channels, *labels, "labels_stop", "attention_mask"), 16, 42)
    padded = sampling.collate(batched, channels, TOKENS.pad)
    return padded.select("batch_id", "row_id", *[sequence.text_of(F.col(c)).alias(c) for c in ("text_ids", *channels, *labels, "attention_mask")])


# ---- rollouts

_POOL_SQL = "SELECT DISTINCT speaker FROM rollout_scores WHERE speaker IS NOT NULL AND speaker <> '__null__' AND speaker NOT IN (SELECT trim(speaker_id) FROM holdout_speakers WHERE speaker_id IS NOT NULL)"
_FANOUT_SQL = f"""WITH v AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS pos, count(*) OVER () AS n FROM ({_POOL_SQL})),
t AS (SELECT id, uuid, text, category, row_number() OVER (ORDER BY id, uuid) - 1 AS tp FROM seed_texts),
s AS (SELECT *, unnest(range(5)) AS slot FROM t),
d AS (SELECT *, CASE WHEN {hash_int_sql('17', 'id', 'slot')} / 4294967296.0::DOUBLE >= 0.15 THEN (id + slot) % (SELECT count(*) FROM v) END AS want FROM s),
f AS (SELECT d.*, coalesce(v.speaker, '__null__') AS speaker, tp * 5 + slot AS gi FROM d LEFT JOIN v ON v.pos = d.want)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = table(spark, sf_dir, "rollout_scores").select("speaker").where(F.col("speaker").isNotNull() & (F.col("speaker") != rollouts.NULL_ROLLOUT)).distinct()
    held = table(spark, sf_dir, "holdout_speakers").select(F.trim("speaker_id").alias("speaker"))
    return rollouts.fan_out(table(spark, sf_dir, "seed_texts"), rollouts.without_holdouts(voices, held), ROLLOUT, shards=4)


@registry.query(f"{_FANOUT_SQL} SELECT gi, substr(uuid, 1, 8) || '__' || speaker || '__s' || slot AS group_id, id, slot, speaker, gi % 4 AS shard FROM f")
def q_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seed text with five voices."""
    return _groups(spark, sf_dir).select("gi", "group_id", "id", "slot", "speaker", "shard")


_WORDS = f"len({words_sql('text')})"


@registry.query(f"SELECT id, greatest(80, least(300, CAST(trunc(4.0::DOUBLE * ((0.7::DOUBLE + 0.4::DOUBLE * greatest(1, {_WORDS})) * 21.5::DOUBLE)) AS INT))) AS max_frames FROM seed_texts")
def q_frame_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame caps of the seed texts."""
    return rollouts.with_frame_cap(table(spark, sf_dir, "seed_texts"), REWARD, ROLLOUT, CODEC.frame_rate).select("id", "max_frames")


@registry.query("WITH g AS (SELECT DISTINCT group_id FROM rollout_scores), d AS (SELECT group_id FROM rollout_scores GROUP BY 1 HAVING count(DISTINCT sample_idx) >= 8) SELECT group_id FROM g WHERE group_id NOT IN (SELECT group_id FROM d WHERE group_id IS NOT NULL)")
def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that lack samples."""
    lines = table(spark, sf_dir, "rollout_scores")
    return rollouts.unfinished(lines.select("group_id").distinct(), lines, ROLLOUT.samples)


def _sharded(lines: DataFrame) -> DataFrame:
    return lines.withColumn("shard", F.pmod(hash_int(0, "group_id"), F.lit(4)).cast("int"))


_PROGRESS_SQL = f"SELECT {hash_int_sql('0', 'group_id')} % 4 AS shard, count(*) AS n_lines, count(*) // 8 AS n_groups_done FROM rollout_scores GROUP BY 1"


@registry.query(_PROGRESS_SQL)
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups done per shard, by lines."""
    return rollouts.shard_progress(_sharded(table(spark, sf_dir, "rollout_scores")), ROLLOUT.samples)


@registry.query(_PROGRESS_SQL)
def q_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that reads what is there and ends."""
    name = f"progress_{uuid.uuid4().hex}"
    path = f"{sf_dir}/rollout_scores.parquet"
    lines = progress.read_stream(spark, path, spark.read.parquet(path))
    progress.watch_shards(_sharded(lines), ROLLOUT.samples, name).awaitTermination()
    return spark.table(name)


@registry.query("""SELECT user_id, epoch_us(min(ts)) AS started, arg_max(event_type, (ts, event_id)) AS stage, max(value) AS percent, count(*) AS n_events FROM events GROUP BY user_id""")
def q_stage_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First time, latest stage and highest value of every item."""
    return progress.board(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_type", "event_id").withColumn("started", F.unix_micros(F.col("started").cast("timestamp")))


@registry.query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return progress.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "1 day").withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


# ---- scores

_LATEST_SQL = """r AS (SELECT * FROM rollout_scores WHERE group_id IS NOT NULL AND sample_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY group_id, sample_idx ORDER BY scored_at DESC NULLS LAST, isnan(reward) DESC NULLS LAST, reward DESC NULLS LAST) = 1)"""


def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "rollout_scores").where("group_id IS NOT NULL AND sample_idx IS NOT NULL")
    first = ["group_id", "sample_idx", "scored_at", "reward"]
    return scoring.latest_lines(lines.select(*first, *[c for c in lines.columns if c not in first]), ["group_id", "sample_idx"], "scored_at")


def _norm_sql(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


@registry.query(f"SELECT row_id, ingested_at IS NULL AS undated, {_norm_sql('text')} AS normal FROM clips")
def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all delivered clips in normal form."""
    return table(spark, sf_dir, "clips").select("row_id", F.col("ingested_at").isNull().alias("undated"), text.normalise(F.coalesce("text", F.lit(""))).alias("normal"))


def _encode_sql(items: str, known: str) -> str:
    return f"array_to_string(list_transform({items}, lambda w: chr(33 + list_position({known}, w))), '')"


_RATES_SQL = f"""{_LATEST_SQL}, a AS (SELECT *, {_norm_sql('text')} AS rt, {_norm_sql('transcript')} AS ht FROM r),
b AS (SELECT *, {words_sql('rt')} AS rw, {words_sql('ht')} AS hw, string_split(rt, '') AS rc, string_split(ht, '') AS hc FROM a),
c AS (SELECT *, list_distinct(rw || hw) AS kw, list_distinct(rc || hc) AS kc FROM b),
e AS (SELECT *, ht = '' AS empty, CASE WHEN ht = '' THEN 1.0 WHEN len(rw) > 0 THEN levenshtein({_encode_sql('rw', 'kw')}, {_encode_sql('hw', 'kw')})::DOUBLE / len(rw) END AS w,
  CASE WHEN ht = '' THEN 1.0 WHEN length(rt) > 0 THEN levenshtein({_encode_sql('rc', 'kc')}, {_encode_sql('hc', 'kc')})::DOUBLE / length(rt) END AS c FROM c)"""


@registry.query(f"WITH {_RATES_SQL} SELECT group_id, sample_idx, empty, w AS wer, c AS cer FROM e")
def q_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and character error rates of all samples; the SQL writes each distinct word or character as one ASCII letter."""
    return scoring.error_rates(latest_scores(spark, sf_dir)).select("group_id", "sample_idx", "empty", "wer", "cer")


_SECONDS_SQL = f"(0.7::DOUBLE + 0.4::DOUBLE * greatest(1, {_WORDS}))"


@registry.query(f"WITH {_LATEST_SQL} SELECT group_id, sample_idx, {_r(_SECONDS_SQL + ' * 0.3::DOUBLE', 2)} AS dur_min, {_r(_SECONDS_SQL + ' * 2.0::DOUBLE', 2)} AS dur_max FROM r")
def q_duration_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration bounds as stored."""
    rows = scoring.duration_bounds(latest_scores(spark, sf_dir), REWARD)
    return rows.select("group_id", "sample_idx", round_half_up(F.col("low"), 2).alias("dur_min"), round_half_up(F.col("high"), 2).alias("dur_max"))


_REWARD_SQL = f"""WITH {_RATES_SQL}, l AS (SELECT *, {_SECONDS_SQL} * 0.3::DOUBLE AS low, {_SECONDS_SQL} * 2.0::DOUBLE AS high FROM e),
s AS (SELECT *, w * -1.0::DOUBLE - greatest(0.0::DOUBLE, duration_sec - high) * 0.5::DOUBLE - CASE WHEN duration_sec < low THEN 2.0::DOUBLE ELSE 0 END - CASE WHEN empty THEN 2.0::DOUBLE ELSE 0 END
 - CASE WHEN sim IS NULL THEN 0.0::DOUBLE ELSE (1.0::DOUBLE - sim) * 0.5::DOUBLE END + 0.0 AS raw, coalesce(w <= 0.2 AND duration_sec >= low AND duration_sec <= high AND NOT truncated AND NOT empty, false) AS is_clean FROM l)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.duration_bounds(scoring.error_rates(latest_scores(spark, sf_dir)), REWARD)
    return scoring.written(scoring.rewards(rows, REWARD, PAIR))


@registry.query(f"{_REWARD_SQL} SELECT group_id, sample_idx, {_r('raw', 4)} AS reward, is_clean AS clean FROM s")
def q_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards computed anew from text, transcript, duration and similarity."""
    return _scored(spark, sf_dir).select("group_id", "sample_idx", "reward", "clean")


@registry.query(f"{_REWARD_SQL} SELECT count(*) AS n, count(*) FILTER (is_clean) AS n_clean, avg(is_clean::INT) AS rate FROM s")
def q_clean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of clean samples."""
    return scoring.clean_rate(_scored(spark, sf_dir))


_COSINE_SQL = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))))"


@registry.query(f"WITH b AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) SELECT vec_id, a.label, {_r(_COSINE_SQL.replace('x::DOUBLE * x)', 'x::DOUBLE * x::DOUBLE)'))} AS sim FROM embeddings a LEFT JOIN b USING (label)")
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its label's first."""
    rows = table(spark, sf_dir, "embeddings").withColumn("duration_sec", F.lit(1.0))
    voices = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    found = scoring.with_similarity(rows, voices, "embedding", "label")
    return found.select("vec_id", "label", round_half_up(F.col("sim"), 6).alias("sim"))


# ---- pairs

_GATE_SQL = "coalesce(wer <= 0.2 AND NOT empty_asr AND NOT truncated AND duration_sec >= dur_min AND duration_sec <= dur_max, false)"
_PAIRS_SQL = f"""WITH {_LATEST_SQL}, u AS (SELECT *, {_GATE_SQL} AS ok FROM r WHERE reward IS NOT NULL AND NOT isnan(reward)),
g AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reward + 0.0 DESC, sample_idx) AS k FROM u WHERE ok QUALIFY k <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reward + 0.0, sample_idx DESC) AS k FROM u WHERE NOT ok QUALIFY k <= 2),
m AS (SELECT g.group_id, g.category, g.sample_idx AS chosen_idx, b.sample_idx AS rejected_idx, g.n_frames AS chosen_n_frames, b.n_frames AS rejected_n_frames, g.reward AS reward_chosen, b.reward AS reward_rejected,
  g.reward - b.reward >= 0.5 AS fits FROM g JOIN b ON g.group_id = b.group_id AND g.k = b.k)"""


@registry.query(f"{_PAIRS_SQL} SELECT group_id, chosen_idx, rejected_idx, chosen_n_frames, rejected_n_frames, reward_chosen, reward_rejected FROM m WHERE fits")
def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs mined from all scores."""
    return pairs.mine_pairs(latest_scores(spark, sf_dir), PAIR).select("group_id", "chosen_idx", "rejected_idx", "chosen_n_frames", "rejected_n_frames", "reward_chosen", "reward_rejected")


@registry.query(f"{_PAIRS_SQL} SELECT (SELECT count(DISTINCT group_id) FROM r) AS n_groups, (SELECT count(DISTINCT group_id) FROM r) - (SELECT count(DISTINCT group_id) FROM u WHERE ok) AS n_no_chosen, (SELECT count(*) FROM m WHERE fits) AS n_pairs, (SELECT count(DISTINCT group_id) FROM m WHERE NOT fits) AS n_no_margin")
def q_pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, pairs, and why groups gave none."""
    return pairs.pair_report(latest_scores(spark, sf_dir), PAIR)


@registry.query("SELECT CASE WHEN coalesce(category, '') = '' THEN '?' ELSE category END AS category, count(*) AS n FROM pref_pairs GROUP BY 1")
def q_pair_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered pairs by category."""
    return pairs.category_counts(table(spark, sf_dir, "pref_pairs"))


_SIDES_SQL = f"""WITH {_LATEST_SQL}, p AS (SELECT DISTINCT group_id, chosen_idx, rejected_idx FROM pref_pairs),
s AS (SELECT concat_ws('|', group_id, chosen_idx, rejected_idx) AS pair_id, group_id, 'chosen' AS side, chosen_idx AS sample_idx FROM p UNION ALL SELECT concat_ws('|', group_id, chosen_idx, rejected_idx), group_id, 'rejected', rejected_idx FROM p)"""


@registry.query(f"{_SIDES_SQL} SELECT pair_id, side, sample_idx, r.transcript FROM s JOIN r USING (group_id, sample_idx)")
def q_pair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both samples of every pair, looked up by group and sample."""
    sides = pairs.pair_sides(table(spark, sf_dir, "pref_pairs").dropDuplicates(["group_id", "chosen_idx", "rejected_idx"])).select("pair_id", "group_id", "side", "sample_idx")
    return pairs.attach_samples(sides, latest_scores(spark, sf_dir).select("group_id", "sample_idx", "transcript")).select("pair_id", "side", "sample_idx", "transcript")


# ---- losses

def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.floor(F.col("vec_id") / 64).alias("batch_id"), "embedding", F.when(F.col("vec_id") % 4 == 0, -1).otherwise(F.col("label")).alias("speaker_int"))


@registry.query(f"""WITH b AS (SELECT vec_id, vec_id // 64 AS batch_id, label AS s, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 4 <> 0),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM b),
p AS (SELECT a.batch_id, a.vec_id AS i, a.s = b.s AS same, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM u a JOIN u b ON a.batch_id = b.batch_id AND a.vec_id <> b.vec_id),
d AS (SELECT batch_id, i, ln(sum(exp(c / 0.1))) AS z, avg(c / 0.1) FILTER (same) AS m, count(*) FILTER (same) AS k FROM p GROUP BY ALL),
l AS (SELECT batch_id, avg(z - m) FILTER (k > 0) AS loss, count(*) FILTER (k > 0) AS n_anchors, avg(k) FILTER (k > 0) AS n_positives_avg FROM d GROUP BY 1),
q AS (SELECT batch_id, coalesce(avg(c) FILTER (same), 0) AS pos, coalesce(avg(c) FILTER (NOT same), 0) AS neg FROM p GROUP BY 1)
SELECT batch_id, {_r('coalesce(loss, 0)')} AS loss, n_anchors, {_r('coalesce(n_positives_avg, 0)')} AS n_positives_avg, {_r('pos')} AS pos_sim_mean, {_r('neg')} AS neg_sim_mean, {_r('pos - neg')} AS separation FROM l JOIN q USING (batch_id)""")
def q_supcon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised contrastive loss and diagnostics of batches of 64."""
    found = losses.contrastive_loss(losses.contrastive_parts(_batches(spark, sf_dir), "batch_id", "embedding", "speaker_int"), "batch_id")
    return found.select("batch_id", "n_anchors", *[round_half_up(F.col(c), 6).alias(c) for c in ("loss", "n_positives_avg", "pos_sim_mean", "neg_sim_mean", "separation")])


_DPO_SQL = """p AS (SELECT DISTINCT group_id, chosen_idx, rejected_idx, category, reward_chosen, reward_rejected, ref_chosen, ref_rejected FROM pref_pairs WHERE ref_chosen IS NOT NULL AND ref_rejected IS NOT NULL),
c AS (SELECT *, (ref_chosen.logp_tokens + ref_chosen.logp_stop * 1.0::DOUBLE) / greatest(1, ref_chosen.n_frames) AS rc, (ref_rejected.logp_tokens + ref_rejected.logp_stop * 1.0::DOUBLE) / greatest(1, ref_rejected.n_frames) AS rr FROM p)"""


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs with reference log-probabilities and a stand-in policy that leans to the reward."""
    rows = table(spark, sf_dir, "pref_pairs").where("ref_chosen IS NOT NULL AND ref_rejected IS NOT NULL")
    rows = rows.select("group_id", "chosen_idx", "rejected_idx", "category", "reward_chosen", "reward_rejected", "ref_chosen", "ref_rejected").distinct()
    one = lambda s: losses.combined_logprob(F.col(f"{s}.logp_tokens"), F.col(f"{s}.logp_stop"), F.col(f"{s}.n_frames"), PREFERENCE)
    rows = rows.withColumns({"rc": one("ref_chosen"), "rr": one("ref_rejected")})
    return rows.withColumns({"pi_chosen": F.col("rc") + F.col("reward_chosen") * 0.05, "pi_rejected": F.col("rr") + F.col("reward_rejected") * 0.05})


@registry.query(f"WITH {_DPO_SQL} SELECT group_id, chosen_idx, rejected_idx, {_r('rc')} AS ref_chosen, {_r('rr')} AS ref_rejected FROM c")
def q_ref_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined reference log-probabilities."""
    return _policy(spark, sf_dir).select("group_id", "chosen_idx", "rejected_idx", round_half_up(F.col("rc"), 6).alias("ref_chosen"), round_half_up(F.col("rr"), 6).alias("ref_rejected"))


_WEIGHT_SQL = "greatest(1.0::DOUBLE / 4.0::DOUBLE, least(4.0::DOUBLE, (reward_chosen - reward_rejected) / 3.5::DOUBLE + 1.0::DOUBLE))"
_LOSS_SQL = f"""WITH {_DPO_SQL}, w AS (SELECT *, {_WEIGHT_SQL} AS w, rc + reward_chosen * 0.05::DOUBLE AS pc, rr + reward_rejected * 0.05::DOUBLE AS pr FROM c),
x AS (SELECT *, 2.0::DOUBLE * ((pc - rc) - (pr - rr)) AS z FROM w)"""


@registry.query(f"{_LOSS_SQL} SELECT coalesce(category, '?') AS category, count(*) AS n_pairs, {_r('sum(w * ln(1 + exp(-z))) / sum(w)')} AS loss, {_r('avg(CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS accuracy, {_r('avg(pc - pr)')} AS margin FROM x GROUP BY 1")
def q_dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted preference loss by category."""
    rows = _policy(spark, sf_dir).withColumn("weight", losses.pair_weight(F.col("reward_chosen") - F.col("reward_rejected"), PREFERENCE)).withColumn("category", F.coalesce("category", F.lit("?")))
    rows = rows.drop("ref_chosen", "ref_rejected").withColumnsRenamed({"rc": "ref_chosen", "rr": "ref_rejected"})
    found = losses.preference_loss(rows, PREFERENCE, ("category",))
    return found.select("category", "n_pairs", *[round_half_up(F.col(c), 6).alias(c) for c in ("loss", "accuracy", "margin")])


@registry.query(f"WITH {_DPO_SQL}, w AS (SELECT *, {_WEIGHT_SQL} AS w FROM c), m AS (SELECT category AS k, avg(w) AS m FROM w GROUP BY 1) SELECT group_id, chosen_idx, rejected_idx, {_r('w / greatest(m, 1e-8)')} AS weight FROM w JOIN m ON category IS NOT DISTINCT FROM k")
def q_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of pairs by margin, with mean 1 in each category."""
    rows = _policy(spark, sf_dir).withColumn("w", losses.pair_weight(F.col("reward_chosen") - F.col("reward_rejected"), PREFERENCE))
    means = rows.groupBy(F.coalesce("category", F.lit("\u0000")).alias("_k")).agg(F.avg("w").alias("m"))
    joined = rows.withColumn("_k", F.coalesce("category", F.lit("\u0000"))).join(means, "_k")
    return joined.select("group_id", "chosen_idx", "rejected_idx", round_half_up(F.col("w") / F.greatest(F.col("m"), F.lit(1e-8)), 6).alias("weight"))


_E64 = "list_transform(embedding, lambda x: x::DOUBLE)"


@registry.query(f"WITH b AS (SELECT vec_id % 3 AS head, CASE WHEN vec_id % 5 = 0 OR vec_id % 3 = 2 THEN -100 ELSE label END AS y, {_E64} AS e FROM embeddings), l AS (SELECT head, CASE WHEN y <> -100 THEN ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) + list_max(e) - e[y + 1] END AS l FROM b) SELECT head, {_r('coalesce(avg(l), 0)')} AS loss, count(l) AS n_labels FROM l GROUP BY head")
def q_masked_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked cross entropy of three heads, one of them with no label at all."""
    rows = table(spark, sf_dir, "embeddings").withColumn("head", F.col("vec_id") % 3)
    rows = rows.withColumn("y", F.when((F.col("vec_id") % 5 == 0) | (F.col("head") == 2), sequence.IGNORE).otherwise(F.col("label")))
    found = losses.masked_cross_entropy(rows, "embedding", "y", ("head",))
    return found.withColumn("loss", round_half_up(F.col("loss"), 6))


@registry.query(f"WITH b AS (SELECT label, embedding[1]::DOUBLE AS z, CASE WHEN vec_id % 7 = 0 THEN -100 WHEN vec_id % 7 = 1 THEN 1 ELSE 0 END AS y FROM embeddings) SELECT label, {_r('coalesce(avg(CASE WHEN y = 1 THEN 25.0::DOUBLE * ln(1 + exp(-z)) WHEN y = 0 THEN ln(1 + exp(z)) END), 0)')} AS loss, count(*) FILTER (y <> -100) AS n_labels FROM b GROUP BY label")
def q_stop_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted stop loss by label."""
    y = F.when(F.col("vec_id") % 7 == 0, sequence.IGNORE).when(F.col("vec_id") % 7 == 1, 1).otherwise(0)
    rows = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("z"), y.alias("y"))
    return losses.masked_stop_loss(rows, "z", "y", 25.0, ("label",)).withColumn("loss", round_half_up(F.col("loss"), 6))


def _query_sql(i: str) -> str:
    return f"e[({i}) * 16 + 1:({i}) * 16 + 16]"


@registry.query(f"WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings), s AS (SELECT vec_id, list_transform(range(1, 17), lambda j: greatest(1e-4, sqrt(list_sum(list_transform([0, 1, 2, 3], lambda q: (e[q * 16 + j] - (e[j] + e[16 + j] + e[32 + j] + e[48 + j]) / 4) ** 2)) / 4))) AS s FROM b) SELECT vec_id, {_r('list_sum(list_transform(s, lambda x: greatest(0.0::DOUBLE, 0.5::DOUBLE - x))) / 16')} AS diversity FROM s")
def q_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinge variance of four queries of 16 dimensions."""
    return table(spark, sf_dir, "embeddings").select("vec_id", round_half_up(losses.hinge_variance(F.col("embedding"), 4), 6).alias("diversity"))


@registry.query(f"WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings), q AS (SELECT vec_id, [{', '.join(_query_sql(str(i)) for i in range(4))}] AS q FROM b), c AS (SELECT vec_id, [{', '.join(f'list_cosine_similarity(q[{i + 1}], q[{j + 1}])' for i in range(4) for j in range(i))}] AS c FROM q) SELECT vec_id, {_r('list_sum(c) / 6')} AS cos_mean, {_r('list_max(c)')} AS cos_max FROM c")
def q_query_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines between the four queries."""
    found = losses.query_cosines(table(spark, sf_dir, "embeddings"), "embedding", 4)
    return found.select("vec_id", round_half_up(F.col("cos_mean"), 6).alias("cos_mean"), round_half_up(F.col("cos_max"), 6).alias("cos_max"))


@registry.query(f"WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings), t AS (SELECT *, list_reverse_sort(e)[10] AS t FROM b), k AS (SELECT vec_id, list_transform(list_filter(e, lambda x: x >= t), lambda x: x / 0.8::DOUBLE) AS k FROM t) SELECT vec_id, len(k) AS n_kept, {_r('list_sum(k)')} AS kept_sum FROM k")
def q_topk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest logits at temperature 0.8."""
    kept = F.filter(numeric.top_k_filter(F.col("embedding"), 10, 0.8), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("k"))
    return rows.select("vec_id", F.size("k").alias("n_kept"), round_half_up(F.aggregate("k", F.lit(0.0), lambda s, x: s + x), 6).alias("kept_sum"))


@registry.query(f"WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings) SELECT vec_id, {_r('list_sum(list_transform(range(1, 65), lambda i: e[65 - i] + 3.0::DOUBLE * (e[i] - e[65 - i])))')} AS guided_sum, {_r('list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (i - 1) % 3 <> 0 OR i > 30 THEN e[i] WHEN e[i] > 0 THEN e[i] / 1.3::DOUBLE ELSE e[i] * 1.3::DOUBLE END))')} AS penalised_sum FROM b")
def q_logit_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided and repetition-penalised logits, summed."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    seen = F.array(*[F.lit(i) for i in range(0, 30, 3)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return rows.select("vec_id", round_half_up(total(numeric.guided(F.reverse("e"), F.col("e"), 3.0)), 6).alias("guided_sum"), round_half_up(total(numeric.repetition_penalised(F.col("e"), seen, 1.3)), 6).alias("penalised_sum"))


@registry.query(f"SELECT DISTINCT l_linenumber * 500 AS step, {_r('0.3::DOUBLE * greatest(0.0, least(1.0, (l_linenumber * 500 - 1000) / 1500.0::DOUBLE))')} AS ramp, {_r('CASE WHEN l_linenumber * 500 < 600 THEN 1e-3::DOUBLE * (l_linenumber * 500 + 1) / 600.0::DOUBLE ELSE 1e-3::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * greatest(0.0, least(1.0, (l_linenumber * 500 - 600) / 2400.0::DOUBLE)))) END', 9)} AS rate FROM lineitem")
def q_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss ramp and learning rate at some steps."""
    steps = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 500).alias("step")).distinct()
    return steps.select("step", round_half_up(numeric.ramp(F.col("step"), 0.3, 1000, 1500), 6).alias("ramp"), round_half_up(numeric.cosine_schedule(F.col("step"), 1e-3, 600, 3000), 9).alias("rate"))


@registry.query(f"""WITH b AS (SELECT vec_id, vec_id % 3 = 0 AS truncated, list_transform(range(1, 11), lambda i: greatest(1e-4, least(1 - 1e-4::DOUBLE, 1 / (1 + exp(-embedding[i]::DOUBLE))))) AS p, {_E64} AS e FROM embeddings)
SELECT vec_id, {_r('-list_sum(list_transform(e, lambda x: abs(x)))')} AS logp_tokens, {_r('list_sum(list_transform(p[1:9], lambda x: ln(1 - x))) + CASE WHEN truncated THEN 0 ELSE ln(p[10]) END')} AS logp_stop, 10 AS n_frames FROM b""")
def q_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory log-probabilities from stand-in logits."""
    tokens = F.array(F.transform("embedding", lambda x: -F.abs(x.cast("double"))))
    stops = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t"), stops.alias("z"), (F.col("vec_id") % 3 == 0).alias("truncated"))
    found = losses.trajectory_logprob(rows, "t", "z", "truncated", PREFERENCE.probability_floor)
    return found.select("vec_id", round_half_up(F.col("logp_tokens"), 6).alias("logp_tokens"), round_half_up(F.col("logp_stop"), 6).alias("logp_stop"), "n_frames")


# ---- seeds

@registry.query("WITH o AS (SELECT text, min(id) AS id FROM seed_texts WHERE text IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY id, text) - 1 AS position, id, text FROM o")
def q_seed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seed text once, in the order of its first id."""
    return seeds.distinct_texts(table(spark, sf_dir, "seed_texts"), "id")


@registry.query("SELECT CASE WHEN coalesce(category, '') = '' THEN '?' ELSE category END AS category, count(*) AS n FROM seed_texts GROUP BY 1")
def q_seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by category."""
    return pairs.category_counts(table(spark, sf_dir, "seed_texts"))


_TEMPLATES = ("Please open {site} and read {part}.", "The mirror of {site} is at {part}.", "Write to {part} at {site} today.")
_FILLERS = {"site": ("docs.example.org", "news.example.net", "files.example.com"), "part": ("the first page", "section two", "the appendix", "line seven")}


def _choose_sql(values: tuple[str, ...], name: str, key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + {hash_int_sql('5:' + name, key)} % {len(values)}]"


_FILL_SQL = f"replace(replace({_choose_sql(_TEMPLATES, 'template', 'id')}, '{{site}}', {_choose_sql(_FILLERS['site'], 'site', 'id')}), '{{part}}', {_choose_sql(_FILLERS['part'], 'part', 'id')})"


@registry.query(f"SELECT id, {_FILL_SQL} AS text FROM seed_texts")
def q_template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled by hash for every seed id."""
    return seeds.fill_templates(table(spark, sf_dir, "seed_texts").select("id"), "id", _TEMPLATES, _FILLERS, 5)


@registry.query(f"""WITH n AS (SELECT {_FILL_SQL} AS text, id FROM seed_texts), o AS (SELECT text, min(id) AS id FROM n GROUP BY 1), p AS (SELECT text, row_number() OVER (ORDER BY id, text) - 1 AS position FROM o),
t AS (SELECT (SELECT max(id) FROM seed_texts) + 1 + position AS id, text FROM p)
SELECT id, text, source FROM seed_texts UNION ALL SELECT id, text, 'templates' FROM t""")
def q_seed_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old seeds and distinct template fills, with ids that go on."""
    old = table(spark, sf_dir, "seed_texts")
    filled = seeds.fill_templates(old.select("id"), "id", _TEMPLATES, _FILLERS, 5)
    new = seeds.distinct_texts(filled, "id").drop("id").withColumn("category", F.lit("urls")).withColumn("lang", F.lit("en"))
    return seeds.continue_seeds(old, new, 5, "templates").select("id", "text", "source")


@registry.query(f"SELECT DISTINCT {known_speaker_sql('speaker_id')} AS speaker FROM holdout_speakers WHERE {known_speaker_sql('speaker_id')} IS NOT NULL")
def q_holdout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out speakers in normal form."""
    from corpuskit.functions.speaker_ids import known_speaker

    return table(spark, sf_dir, "holdout_speakers").select(known_speaker("speaker_id").alias("speaker")).where("speaker IS NOT NULL").distinct()
