"""Words, normal form, token layout and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.config import LayoutConfig, RewardConfig, RolloutConfig, TokenConfig
from corpuskit.functions.hashing import hash01

BLANKS = r"[ \t\n\r\f]+"


def words(text: Column) -> Column:
    """White-space words; an empty array for blank texts, null for null."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalise(text: Column) -> Column:
    """Lower case; marks, symbols and punctuation to blanks; runs of white space to one blank; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{M}\p{S}\p{P}]", " "), BLANKS, " "))


def language_tagged(text: Column, tag: Column) -> Column:
    """``tag: text`` with the tag in lower case; the bare text without a tag."""
    return F.when(tag.isNull(), text).otherwise(F.concat(F.lower(tag), F.lit(": "), text))


def stand_in_ids(text: Column) -> Column:
    """Deterministic stand-in for a text tokenizer: one id in [0, 65536) for each white-space word."""
    return F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def repeat_count(n: Column, cfg: LayoutConfig) -> Column:
    """How often a text of ``n`` tokens is laid out."""
    if not cfg.enabled:
        return F.lit(1)
    times = F.ceil(F.lit(float(cfg.target)) / n.cast("double")).cast("int")
    return F.when((n <= 0) | (n >= cfg.apply_below) | (n >= cfg.target), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(times, F.lit(cfg.max_repeats))))


def sampled_repeat_count(n: Column, key: Column, cfg: LayoutConfig) -> Column:
    """:func:`repeat_count`, but a share ``mixed_keep`` of the rows that would be repeated is not; the draw is a hash of the row."""
    r = repeat_count(n, cfg)
    return F.when((r > 1) & (hash01(cfg.seed, key) < F.lit(cfg.mixed_keep)), F.lit(1)).otherwise(r)


def layout(ids: Column, repeats: Column, tokens: TokenConfig) -> Column:
    """[start, ids, end] ``repeats`` times, and the start of speech."""
    block = F.concat(F.array(F.lit(tokens.start_of_text)), ids, F.array(F.lit(tokens.end_of_text)))
    return F.concat(F.flatten(F.array_repeat(block, repeats)), F.array(F.lit(tokens.start_of_speech)))


def original_length(laid_out: Column, tokens: TokenConfig) -> Column:
    """Number of text tokens behind a layout: the inverse of :func:`layout`."""
    starts = F.greatest(F.lit(1), F.size(F.filter(laid_out, lambda x: x == tokens.start_of_text)))
    return (F.floor((F.size(laid_out) - 1) / starts) - 2).cast("int")


def expected_seconds(text: Column, cfg: RewardConfig) -> Column:
    return F.lit(cfg.base_seconds) + F.lit(cfg.seconds_per_word) * F.greatest(F.lit(1), word_count(text)).cast("double")


def frame_cap(text: Column, reward: RewardConfig, rollout: RolloutConfig, frame_rate: float) -> Column:
    """A multiple of the expected frames, truncated, within bounds."""
    frames = (F.lit(rollout.cap_multiple) * (expected_seconds(text, reward) * F.lit(frame_rate))).cast("int")
    return F.greatest(F.lit(rollout.cap_min), F.least(F.lit(rollout.cap_max), frames))


def file_stem(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def hash_uuid(seed: int | str, *parts: Column) -> Column:
    """A uuid-shaped text from md5."""
    from corpuskit.functions.hashing import hash_key

    h = hash_key(seed, *parts)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of strings.

    Each distinct element of a row becomes one code point above the basic plane, and the
    built-in distance counts code points; up to a million distinct elements a row.
    """

    def encode(xs: Column, known: Column) -> Column:
        codes = F.transform(xs, lambda w: F.lpad(F.hex(F.array_position(known, w) + F.lit(0xFFFF)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    # a transform over one element binds the arrays, which would otherwise be built anew for each word
    bound = F.array(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("k")))
    return F.get(F.transform(bound, lambda s: F.levenshtein(encode(s["a"], s["k"]), encode(s["b"], s["k"]))), F.lit(0))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits per reference word of two normalised texts; 1 for an empty hypothesis, null for an empty reference."""
    ref, hyp = words(reference), words(hypothesis)
    return F.when(F.size(hyp) == 0, F.lit(1.0)).when(F.size(ref) > 0, edit_distance(ref, hyp).cast("double") / F.size(ref))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edits per reference character of two normalised texts; 1 for an empty hypothesis, null for an empty reference."""
    return F.when(F.length(hypothesis) == 0, F.lit(1.0)).when(F.length(reference) > 0, F.levenshtein(reference, hypothesis).cast("double") / F.length(reference))


def nested(column: Column | str, path: str, default: str | None = None) -> Column:
    """Text at a dotted path of a JSON column; the default where the path or the whole text is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.get_json_object(c, "$." + path), F.lit(default))


def iso_utc(time: Column | str) -> Column:
    """A time as ISO 8601 text in UTC, to the second; the session's zone must be UTC."""
    c = F.col(time) if isinstance(time, str) else time
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column | str) -> Column:
    """The time of such a text; null where it is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def without_brackets(text: Column | str) -> Column:
    """Stage directions in square, round or angle brackets taken out, as before error rates are measured."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", "")
