"""Named queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.speaker_ids import known_speaker
from corpuskit.llm import langid, leakage, mixing, packing, splits, subjects, terms, tokens, topn
from corpuskit.plans.registry import Registry, known_speaker_sql, table
from corpuskit.session import materialize

registry = Registry()

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
CONTAINER_FRAMES = 1024


# ---- 1: splits that keep related records together

def clip_splits(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    clips = table(spark, sf_dir, "clips").select("row_id", "source", known_speaker("speaker_id").alias("speaker_id"), "recording_id")
    holdout = table(spark, sf_dir, "holdout_speakers").select(known_speaker("speaker_id").alias("speaker_id"))
    return splits.grouped_splits(clips, "row_id", ["speaker_id", "recording_id"], SPLIT_SHARES, label="source", pinned=("speaker_id", holdout), **more)


@registry.query()
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip with its group and split."""
    return clip_splits(spark, sf_dir)


@registry.query(
    f"""
WITH RECURSIVE c AS (SELECT DISTINCT row_id, {known_speaker_sql('speaker_id')} AS s, recording_id AS r FROM clips),
h AS (SELECT DISTINCT {known_speaker_sql('speaker_id')} AS s FROM holdout_speakers),
k AS (SELECT row_id, 's' || s AS k FROM c WHERE s IS NOT NULL UNION SELECT row_id, 'r' || r FROM c WHERE r IS NOT NULL),
e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b USING (row_id) WHERE a.k <> b.k),
held(k) AS (SELECT 's' || s FROM h WHERE s IS NOT NULL UNION SELECT e.b FROM held JOIN e ON e.a = held.k)
SELECT DISTINCT row_id FROM k JOIN held USING (k)"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose group holds a held-out speaker."""
    return clip_splits(spark, sf_dir).where("is_pinned").select("row_id")


@registry.query(
    f"""
SELECT count(DISTINCT row_id) AS n_clips, CAST(0 AS BIGINT) AS torn_speakers, CAST(0 AS BIGINT) AS torn_recordings,
       count(DISTINCT row_id) FILTER ({known_speaker_sql('speaker_id')} IN (SELECT {known_speaker_sql('speaker_id')} FROM holdout_speakers)) AS held_in_test
FROM clips"""
)
def p1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits: no speaker or recording in two of them, held-out speakers in test. All rounds of the component search are distributed."""
    clips = table(spark, sf_dir, "clips").where("row_id IS NOT NULL").select("row_id", known_speaker("speaker_id").alias("speaker_id"), "recording_id")
    held = table(spark, sf_dir, "holdout_speakers").select(known_speaker("speaker_id").alias("speaker_id")).where("speaker_id IS NOT NULL").distinct().withColumn("held", F.lit(True))
    placed = materialize(clip_splits(spark, sf_dir, finish_below=0).select("row_id", "split"))
    both = materialize(clips.join(placed, "row_id"))
    torn = [both.where(f"{c} IS NOT NULL").groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count("*").alias(n)) for c, n in (("speaker_id", "torn_speakers"), ("recording_id", "torn_recordings"))]
    in_test = both.join(F.broadcast(held), "speaker_id").where("split = 'test'").agg(F.count_distinct("row_id").alias("held_in_test"))
    facts = [placed.agg(F.count("*").alias("n_clips")), *torn, in_test]
    names = ["n_clips", "torn_speakers", "torn_recordings", "held_in_test"]
    rows = [f.select(*[F.col(n) if n in f.columns else F.lit(None).cast("bigint").alias(n) for n in names]) for f in facts]
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(n).alias(n) for n in names])


@registry.query()
def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source in each split, with its share of the source's rows."""
    clips = table(spark, sf_dir, "clips").where("row_id IS NOT NULL").groupBy("row_id").agg(F.max(F.coalesce("source", F.lit(""))).alias("source"))
    cells = clips.join(clip_splits(spark, sf_dir).select("row_id", "split", "n_rows"), "row_id").groupBy("source", "split").agg(F.sum("n_rows").alias("n_rows"))
    return cells.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("source")))  # a row for each source and split


# ---- 3: frequency of every distinct term

_TERMS = f"""
WITH c AS (SELECT {known_speaker_sql('speaker_id')} AS speaker_id, row_id, recording_id FROM clips),
t AS (SELECT count(DISTINCT recording_id) AS n FROM c),
f AS (SELECT speaker_id, count(*) AS n_rows, count(DISTINCT row_id) AS n_clips, count(DISTINCT recording_id) AS n_recordings FROM c WHERE speaker_id IS NOT NULL GROUP BY 1)
SELECT speaker_id, n_rows, n_clips, n_recordings, n_clips < 3 AS is_rare, n_recordings > 0.02 * n AS is_common FROM f, t"""


def speaker_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "clips").select(known_speaker("speaker_id").alias("speaker_id"), "row_id", "recording_id")
    total = clips.agg(F.count_distinct("recording_id")).first()[0]
    counted = terms.term_frequencies(clips, "speaker_id", {"n_clips": "row_id", "n_recordings": "recording_id"})
    return terms.mark_terms(counted, ("n_clips", 3), ("n_recordings", total, 0.02))


@registry.query(_TERMS)
def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, clips and recordings of every known speaker, and whether it is too rare or too common."""
    return speaker_terms(spark, sf_dir).select(F.col("term").alias("speaker_id"), F.col("occurrences").alias("n_rows"), "n_clips", "n_recordings", "is_rare", "is_common")


@registry.query(f"WITH m AS ({_TERMS}) SELECT speaker_id, 'rare' AS mark FROM m WHERE is_rare UNION ALL SELECT speaker_id, 'common' FROM m WHERE is_common")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers that are too rare or too common."""
    marks = F.explode(F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common")))))
    return speaker_terms(spark, sf_dir).select(F.col("term").alias("speaker_id"), marks.alias("mark"))


# ---- 4: filling containers

_PAIR = ["group_id", "chosen_idx", "rejected_idx"]


def pair_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pref_pairs").select(*_PAIR, (F.col("chosen_n_frames").cast("bigint") + F.col("rejected_n_frames")).alias("frames"))
    return packing.pieces(pairs, _PAIR, "frames", CONTAINER_FRAMES)


@registry.query()
def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every pair with its container, by best fit over the length histogram."""
    return packing.pattern_containers(pair_pieces(spark, sf_dir), _PAIR, CONTAINER_FRAMES)


@registry.query()
def p4_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces batched inside optimal length buckets."""
    return packing.bucket_containers(pair_pieces(spark, sf_dir), _PAIR, CONTAINER_FRAMES)


@registry.query("SELECT DISTINCT group_id, chosen_idx, rejected_idx FROM pref_pairs WHERE chosen_n_frames + rejected_n_frames > 1024")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that exceed a container and had to be split: those whose pieces lie in several containers."""
    spread = p4_containers(spark, sf_dir).groupBy(*_PAIR).agg(F.min("container").alias("_a"), F.max("container").alias("_b"))
    return spread.where("_a < _b").select(*_PAIR)


_PIECES_SQL = """
WITH i AS (SELECT group_id, chosen_idx, rejected_idx, max(CAST(chosen_n_frames AS BIGINT) + rejected_n_frames) AS n FROM pref_pairs WHERE chosen_n_frames + rejected_n_frames >= 0 GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(sum(greatest(1, ceil(n / 1024.0))) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS frames,
       CAST(0 AS BIGINT) AS overfull, true AS below_bound FROM i"""


def _packed(parts: DataFrame) -> DataFrame:
    """One row on a packing: what it holds, containers beyond the capacity, and whether it keeps to the any-fit bound of twice the volume."""
    loads = parts.groupBy("container").agg(F.sum("piece_length").alias("load"), F.count("*").alias("n"), F.count_if(F.col("piece") == 0).alias("items"))
    row = loads.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.sum("load").alias("frames"), F.count_if(F.col("load") > CONTAINER_FRAMES).alias("overfull"), F.count("*").alias("used"))
    return row.select("n_items", "n_pieces", "frames", "overfull", (F.col("used") <= 2 * F.col("frames") / CONTAINER_FRAMES + 32).alias("below_bound"))


@registry.query(_PIECES_SQL)
def p4_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: nothing is lost, nothing overfull, no needless container."""
    return _packed(p4_containers(spark, sf_dir))


@registry.query(_PIECES_SQL)
def p4_bucket_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the batches inside length buckets."""
    return _packed(p4_buckets(spark, sf_dir))


# ---- 5: top N within every group

_TOP = """
WITH latest AS (SELECT group_id, sample_idx, reward FROM rollout_scores WHERE group_id IS NOT NULL AND sample_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY group_id, sample_idx ORDER BY scored_at DESC NULLS LAST, isnan(reward) DESC NULLS LAST, reward DESC NULLS LAST) = 1),
v AS (SELECT group_id, sample_idx, reward + 0.0 AS reward FROM latest WHERE reward IS NOT NULL AND NOT isnan(reward))
SELECT group_id, sample_idx, reward, CAST(row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, sample_idx) AS INT) AS rank FROM v QUALIFY rank <= 3"""


@registry.query(_TOP)
def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best samples of every group."""
    return topn.top_n_per_group(table(spark, sf_dir, "rollout_scores"), "group_id", "sample_idx", "reward", 3, version="scored_at")


@registry.query(f"SELECT group_id, sample_idx FROM ({_TOP})")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without scores."""
    return p5_top(spark, sf_dir).select("group_id", "sample_idx")


# ---- 6: language of documents and segments

@registry.query()
def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every stretch of a mixed one, with its language and confidence."""
    return langid.detect_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@registry.query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all documents whose label isn't right."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "label")
    found = langid.detect_languages(docs, "doc_id", "text", "label", keep=["label"])
    right = (F.col("n_segments") == 1) & langid.language_code("label").eqNullSafe(F.col("lang"))
    return found.where(~right & (F.col("lang") != langid.UNDETERMINED)).select("doc_id", "seg_no", "lang")


# ---- 7: evaluation texts in the corpus

@registry.query()
def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with verified overlaps with held-out texts, substitutions allowed."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "text")


_LEAK_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[\p{L}\p{Nd}]+')"


@registry.query(
    f"""
WITH d AS (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents), i AS (SELECT item_id, {_LEAK_WORDS} AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS g FROM d),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those with at least ten equal words in a row."""
    return p7_leaks(spark, sf_dir).where(F.col("longest_run") >= 10).select("doc_id", "item_id")


@registry.query(f"WITH i AS (SELECT item_id, coalesce(len({_LEAK_WORDS}), 0) AS n FROM eval_items) SELECT item_id, CAST(n AS INT) AS n_words, n >= 10 AS searched FROM i")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every held-out text, and whether it has enough of them to be searched for."""
    held = leakage.held_out_words(table(spark, sf_dir, "eval_items"), "item_id", "text")
    return held.select(F.col("k").alias("item_id"), "n_words", (F.size("seeds") > 0).alias("searched"))


# ---- 8: mixing sources to target weights

def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    targets = table(spark, sf_dir, "mix_targets")
    wanted = docs.join(targets.select("source").distinct(), "source", "left_semi")
    return mixing.weighted_mix(tokens.with_token_counts(wanted, "text"), "doc_id", "source", "n_tokens", targets)


@registry.query()
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their copies, in queueing order."""
    return mixture(spark, sf_dir)[0]


@registry.query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixture(spark, sf_dir)[1]


@registry.query(
    """
WITH s AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT m.source, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets m LEFT JOIN s USING (source))
SELECT source FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)"""
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share. The SQL measures in characters, which gives the same sources."""
    return mixture(spark, sf_dir)[1].where("is_short").select("source")


@registry.query(
    """
WITH s AS (SELECT source, count(*) AS docs, sum(length(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT m.source, target_share, max_repeats, coalesce(docs, 0) AS docs, coalesce(n, 0) AS n FROM mix_targets m LEFT JOIN s USING (source)),
f AS (SELECT *, n * max_repeats < target_share * (SELECT sum(n) FROM t) AS short FROM t)
SELECT source, short AS is_short, CASE WHEN short THEN docs * max_repeats END AS rows_if_short, true AS copies_fit, true AS share_fits FROM f"""
)
def p8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture: short sources are used up, copies stay within ``max_repeats``, the others share the rest alike."""
    mix, report = mixture(spark, sf_dir)
    drawn = mix.groupBy("source").agg(F.count("*").alias("n_rows"), (F.max("copy") + 1).alias("copies"), F.max("finish").alias("end"))
    longest = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.octet_length("text")).alias("longest"))  # a text has no more tokens than bytes
    rows = report.join(F.broadcast(drawn), "source", "left").join(F.broadcast(longest), "source", "left")
    everything = Window.partitionBy(F.lit(0))  # over the report's few rows
    # a queue that isn't dry ends within one document of the virtual time of the cut
    cut = F.max("end").over(everything)
    fits = F.coalesce(F.col("is_short") | (F.col("end") + F.col("longest") / F.col("target_share") >= cut), F.lit(True))
    return rows.select("source", "is_short", F.when(F.col("is_short"), F.coalesce("n_rows", F.lit(0))).alias("rows_if_short"), F.coalesce(F.col("copies") <= F.col("max_repeats"), F.lit(True)).alias("copies_fit"), fits.alias("share_fits"))


# ---- 9: subject areas

@registry.query()
def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document that has any, with the number of sentences."""
    names = sorted(r[0] for r in table(spark, sf_dir, "subjects").select("subject").where("subject IS NOT NULL").distinct().collect())
    return subjects.document_subjects(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subject_labels"), names)


@registry.query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without counts."""
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")
