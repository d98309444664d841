"""Queries that bring stored tables together: scores, token tables, training pairs, layouts, sorted indexes, times."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import numeric, sequence, text
from corpuskit.functions.numeric import round_half_up
from corpuskit.operators import keep_index, losses, pairs, providers, rollouts, sampling, scoring
from corpuskit.plans.corpus_queries import _LAYOUT_SQL, KEEP, TOKENS, _lengths, hash_int_sql, hash_sql, text_sql
from corpuskit.plans.registry import Registry, table
from corpuskit.plans.training_queries import _E64, _FANOUT_SQL, _INDEX_SQL, _LATEST_SQL, _groups, _index, _query_sql, _r, latest_scores

registry = Registry()


# ---- scores from their three tables

@registry.query(f"WITH {_LATEST_SQL} SELECT group_id, sample_idx, n_frames, truncated, CASE WHEN sample_idx % 5 <> 4 THEN transcript END AS transcript, CASE WHEN sample_idx % 3 <> 2 THEN sim END AS sim FROM r")
def q_score_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines with transcripts and similarities, by group and sample; some of both are missing."""
    lines = latest_scores(spark, sf_dir)
    found = scoring.assemble(
        lines.select("group_id", "sample_idx", "n_frames", "truncated"),
        lines.where("sample_idx % 5 <> 4").select("group_id", "sample_idx", "transcript"),
        lines.where("sample_idx % 3 <> 2").select("group_id", "sample_idx", "sim"),
    )
    return found.select("group_id", "sample_idx", "n_frames", "truncated", "transcript", "sim")


# ---- token and prefix tables

_CODES = 1024
_SPEAKERS_SQL = "SELECT DISTINCT speaker FROM rollout_scores WHERE speaker IS NOT NULL"


def _tokens_sql(groups: str) -> str:
    """SQL of the stand-in policy on rows ``group_id, sample_idx, max_frames``."""
    stop, first, step = (hash_int_sql(f"0:{x}", "group_id", "sample_idx") for x in ("stop", "first", "step"))
    n = f"least(1 + {stop} % 400, max_frames)"
    return f"SELECT *, {n} AS n, 1 + {stop} % 400 > max_frames AS cut, list_transform(range({n}), lambda i: ({first} + i * {step}) % {_CODES}) AS tokens FROM ({groups})"


def _sample_tokens(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    groups = table(spark, sf_dir, "rollout_scores").where("group_id IS NOT NULL").select("group_id").distinct().withColumn("max_frames", F.lit(300))
    return providers.stand_in_policy(_CODES)(groups, 8, wanted)


_SAMPLES_SQL = _tokens_sql("SELECT group_id, unnest(range(8)) AS sample_idx, 300 AS max_frames FROM (SELECT DISTINCT group_id FROM rollout_scores WHERE group_id IS NOT NULL)")


@registry.query(f"WITH t AS ({_SAMPLES_SQL}) SELECT group_id, sample_idx, n AS n_frames, cut AS truncated, {text_sql('tokens')} AS tokens FROM t")
def q_rollout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of eight samples for each group."""
    return _sample_tokens(spark, sf_dir).select("group_id", "sample_idx", "n_frames", "truncated", sequence.text_of(F.col("tokens")).alias("tokens"))


@registry.query(f"SELECT speaker, i, {hash_int_sql('prefix', 'speaker', 'i')} / 4294967296.0::DOUBLE AS x FROM ({_SPEAKERS_SQL}), range(4) AS r(i)")
def q_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix table, one value a row."""
    speakers = table(spark, sf_dir, "rollout_scores").where("speaker IS NOT NULL").select("speaker")
    return providers.stand_in_prefixes(speakers).select("speaker", F.posexplode("prefix").alias("i", "x"))


@registry.query(
    f"""WITH t AS ({_SAMPLES_SQL}), p AS (SELECT group_id, chosen_idx, rejected_idx, max(speaker) AS speaker FROM pref_pairs GROUP BY ALL)
SELECT p.group_id, chosen_idx, rejected_idx, {hash_int_sql('prefix', 'p.speaker', '0')} / 4294967296.0::DOUBLE AS prefix_0, {text_sql('a.tokens')} AS chosen_tokens, {text_sql('b.tokens')} AS rejected_tokens
FROM p JOIN t a ON a.group_id = p.group_id AND a.sample_idx = chosen_idx JOIN t b ON b.group_id = p.group_id AND b.sample_idx = rejected_idx WHERE p.speaker IN ({_SPEAKERS_SQL})"""
)
def q_pair_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the tokens of both sides and the prefix of their speaker."""
    mined = table(spark, sf_dir, "pref_pairs").groupBy("group_id", "chosen_idx", "rejected_idx").agg(F.max("speaker").alias("speaker"))
    prefixes = providers.stand_in_prefixes(table(spark, sf_dir, "rollout_scores").where("speaker IS NOT NULL").select("speaker"))
    found = pairs.training_pairs(mined, _sample_tokens(spark, sf_dir, pairs.wanted_samples(mined)), prefixes)
    return found.select("group_id", "chosen_idx", "rejected_idx", F.col("prefix")[0].alias("prefix_0"), *[sequence.text_of(F.col(c)).alias(c) for c in ("chosen_tokens", "rejected_tokens")])


@registry.query(
    f"""WITH p AS (SELECT DISTINCT group_id, chosen_idx, rejected_idx FROM pref_pairs),
s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('5:1', 'group_id', 'chosen_idx', 'rejected_idx')}, group_id, chosen_idx, rejected_idx) - 1 AS pos FROM p)
SELECT group_id, chosen_idx, rejected_idx, pos // 16 AS batch_id, pos % 16 AS slot FROM s"""
)
def q_pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 pairs of the second epoch."""
    return pairs.pair_batches(table(spark, sf_dir, "pref_pairs").select("group_id", "chosen_idx", "rejected_idx").distinct(), 16, 5, epoch=1)


@registry.query(
    f"""WITH l AS (SELECT group_id, sample_idx, n_frames AS f, length(coalesce(text, '')) % 40 + 3 AS t FROM ({'SELECT * FROM r'})), x AS (SELECT *, max(f) OVER (PARTITION BY group_id) AS mf, 4 + max(t + f) OVER (PARTITION BY group_id) AS w FROM l)
SELECT group_id, sample_idx, {text_sql('list_transform(range(4 + t + f), lambda i: 1) || list_transform(range(w - 4 - t - f), lambda i: 0)')} AS mask,
{text_sql('list_transform(range(mf), lambda i: least(4 + t - 1 + i, w - 1))')} AS predict_at, {text_sql('list_transform(range(mf), lambda i: least(4 + t + i, w - 1))')} AS state_at, {text_sql('list_transform(range(mf), lambda i: CASE WHEN i < f THEN 1 ELSE 0 END)')} AS valid FROM x""".replace("WITH l", f"WITH {_LATEST_SQL}, l", 1).replace("FROM (SELECT * FROM r)", "FROM r WHERE n_frames > 0")
)
def q_forced_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask and gather positions of each sample, padded to its group; a prefix has four positions."""
    lines = latest_scores(spark, sf_dir).where("n_frames > 0")
    rows = lines.select("group_id", "sample_idx", F.col("n_frames").alias("f"), (F.length(F.coalesce("text", F.lit(""))) % 40 + 3).alias("t"))
    widths = rows.groupBy("group_id").agg(F.max("f").alias("mf"), (F.max(F.col("t") + F.col("f")) + 4).alias("w"))
    layout = sequence.forced_layout(4, F.col("t"), F.col("f"), F.col("w"), F.col("mf"))
    return rows.join(widths, "group_id").select("group_id", "sample_idx", *[sequence.text_of(c).alias(name) for name, c in layout.items()])


@registry.query("SELECT * FROM (VALUES ('empty_text', 0, 248073), ('empty_text', 1, 248074), ('empty_text', 2, 248070), ('audio_only', 0, 248070)) AS t(mode, i, id)")
def q_unconditional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text ids of the branch without a text, in both modes."""
    rows = [(mode, i, x) for mode in ("empty_text", "audio_only") for i, x in enumerate(sequence.unconditional_ids(mode, TOKENS.start_of_text, TOKENS.end_of_text, TOKENS.start_of_speech))]
    return spark.createDataFrame(rows, "mode string, i int, id int")


@registry.query(f"{_FANOUT_SQL}, g AS (SELECT gi FROM f ORDER BY gi LIMIT 100) SELECT gi FROM g WHERE gi % 4 = 1")
def q_shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of shard 1 of 4 among the first hundred; the limit is the operator's."""
    return rollouts.shard_groups(_groups(spark, sf_dir).select("gi"), 1, 4, limit=100)


# ---- indexes

_TWICE_SQL = f"""{_LAYOUT_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (n < 13) AS s, count(*) FILTER (n >= 13 AND n <= 20) AS e FROM l),
w AS (SELECT least(greatest(0, CAST(round_even(n * 0.8, 0) AS BIGINT) - 3 * s), e) AS kept FROM s),
p AS (SELECT row_id, n FROM l WHERE n >= 13 AND n <= 20 QUALIFY row_number() OVER (ORDER BY {hash_sql('44', 'row_id')}, row_id) <= (SELECT kept FROM w)),
k AS (SELECT row_id, unnest(range(3)) AS copy, n AS orig_len FROM l WHERE n < 13 UNION ALL SELECT row_id, 0, n FROM p)"""


@registry.query(f"{_TWICE_SQL} SELECT row_id, copy, orig_len, row_number() OVER (ORDER BY row_id, copy) - 1 AS position FROM k")
def q_keep_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep index with short rows three times, in order."""
    return keep_index.sorted_index(keep_index.keep_index(_lengths(spark, sf_dir), replace(KEEP, oversample=3, fraction=0.8)))


@registry.query(
    f"""{_INDEX_SQL}, c AS (SELECT count(*) AS n, count(DISTINCT speaker_int) FILTER (speaker_int >= 0) AS n_speakers, count(*) FILTER (n_clips = 1) AS n_singletons, count(*) FILTER (speaker_int < 0) AS n_null_rows FROM i)
SELECT n_speakers, n_singletons, n_null_rows, {_r('100.0::DOUBLE * n_singletons / greatest(n_speakers, 1)')} AS pct_singletons, {_r('100.0::DOUBLE * n_null_rows / greatest(n, 1)')} AS pct_null_rows FROM c"""
)
def q_speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers, singletons and null rows of the index."""
    found = sampling.speaker_summary(_index(spark, sf_dir))
    return found.select("n_speakers", "n_singletons", "n_null_rows", *[round_half_up(F.col(c), 6).alias(c) for c in ("pct_singletons", "pct_null_rows")])


# ---- losses and draws

@registry.query(f"WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings), q AS (SELECT vec_id, [{', '.join(_query_sql(str(i)) for i in range(4))}] AS q FROM b) SELECT vec_id, {_r('list_avg(list_transform(range(1, 17), lambda j: list_stddev_samp(list_transform(q, lambda r: r[j]))))')} AS std FROM q")
def q_query_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviation across four queries, averaged over their dimensions."""
    return table(spark, sf_dir, "embeddings").select("vec_id", round_half_up(losses.query_spread(F.col("embedding"), 4), 6).alias("std"))


@registry.query(
    f"""WITH b AS (SELECT vec_id % 50 AS batch, vec_id % 2 AS head, label AS y, {_E64} AS e, embedding[1]::DOUBLE AS z, vec_id % 7 = 1 AS stops FROM embeddings),
h AS (SELECT batch, head, avg(ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) + list_max(e) - e[y + 1]) AS l FROM b GROUP BY ALL),
s AS (SELECT batch, avg(CASE WHEN stops THEN 25.0::DOUBLE * ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END) AS l FROM b GROUP BY 1)
SELECT batch, {_r('avg(h.l) + 0.1::DOUBLE * any_value(s.l)')} AS loss FROM h JOIN s USING (batch) GROUP BY batch"""
)
def q_total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over two heads plus a tenth of the stop loss, per batch of vectors."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("batch"), (F.col("vec_id") % 2).alias("head"), F.col("label").alias("y"), "embedding", F.get("embedding", F.lit(0)).alias("z"), (F.col("vec_id") % 7 == 1).cast("int").alias("stops"))
    heads = losses.masked_cross_entropy(rows, "embedding", "y", ("batch", "head"))
    stop = losses.masked_stop_loss(rows, "z", "stops", 25.0, ("batch",))
    return losses.total_loss(heads, stop, "batch", 0.1).select("batch", round_half_up(F.col("loss"), 6).alias("loss"))


@registry.query(
    f"""WITH b AS (SELECT vec_id, {_E64} AS e FROM embeddings), t AS (SELECT *, list_reverse_sort(e)[10] AS t FROM b), x AS (SELECT vec_id, e, t, unnest(range(64)) AS i FROM t),
n AS (SELECT vec_id, i, e[i + 1] / 0.8::DOUBLE - ln(-ln({hash_int_sql('3', 'vec_id', 'i')} / 4294967296.0::DOUBLE + 1 / 8589934592.0::DOUBLE)) AS v FROM x WHERE e[i + 1] >= t)
SELECT vec_id, arg_max(i, (v, -i)) AS token FROM n GROUP BY vec_id"""
)
def q_draw_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token drawn from the ten greatest logits at temperature 0.8."""
    return table(spark, sf_dir, "embeddings").select("vec_id", numeric.draw_token(numeric.top_k_filter(F.col("embedding"), 10, 0.8), F.col("vec_id"), seed=3).alias("token"))


@registry.query(
    f"""WITH f AS (SELECT row_id, unnest(range(len(nano_layer_1))) AS t, unnest(nano_layer_1) AS code FROM clip_codes),
w AS (SELECT row_id, t, list_sort(list_distinct(list(code) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))) AS seen FROM f)
SELECT row_id, t, coalesce({text_sql('seen')}, '') AS seen FROM w"""
)
def q_recent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the eight frames before each frame, for the repetition penalty."""
    frames = table(spark, sf_dir, "clip_codes").select("row_id", F.posexplode("nano_layer_1").alias("t", "code"))
    return frames.select("row_id", "t", sequence.text_of(numeric.recent_distinct("code", "row_id", "t", 8)).alias("seen"))


# ---- texts and times

@registry.query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS deep, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch_us(date_trunc('second', ts)) AS us FROM events")
def q_event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested records with defaults, and times as text and back."""
    rows = table(spark, sf_dir, "events").withColumn("at", text.iso_utc("ts"))
    return rows.select("event_id", text.nested("props", "k", "none").alias("k"), text.nested("props", "a.b", "none").alias("deep"), "at", F.unix_micros(text.parse_iso("at")).alias("us"))


@registry.query("SELECT row_id, recorded_at IS NULL AS undated, regexp_replace(text, '\\[[^\\]]*\\]|\\([^)]*\\)|<[^>]*>', '', 'g') AS plain FROM clips")
def q_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without stage directions in brackets."""
    return table(spark, sf_dir, "clips").select("row_id", F.col("recorded_at").isNull().alias("undated"), text.without_brackets("text").alias("plain"))


@registry.query(f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT id, {hash_sql('uuid', 'id')} AS h FROM seed_texts)""")
def q_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded identifier for each text."""
    return table(spark, sf_dir, "seed_texts").select("id", text.hash_uuid("uuid", "id").alias("uuid"))
