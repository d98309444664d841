"""Held-out texts leaking into a corpus: spaced seeds, then verified overlaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.skew import heavy_hitters, skew_join
from corpuskit.session import materialize, shuffle_width

# Seed masks over a window of ten words; 1 is read, 0 ignored. Every mask reads
# its ends, and none spans more than ten words, so ten equal words in a row are always hit.
MASKS = ("1101100111", "1110011011", "1011110101")

_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")

HIT_SCHEMA = "doc_first_word int, item_first_word int, n_words int, n_equal int, longest_run int"


def leak_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after removing invisible format characters and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", text)
    return _WORD.findall(text.lower())


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: Sequence[str]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def _seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """One hash for each window of the mask's span; ignored positions do not enter it."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(salt * 2 + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
    return h


@dataclass
class SeedIndex:
    """Seeds of some held-out texts, sorted by hash."""

    masks: tuple[str, ...]
    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray

    @classmethod
    def build(cls, items: Sequence[tuple], masks: Sequence[str]) -> SeedIndex:
        """Index of (key, text) pairs."""
        hasher = _WordHashes()
        return cls.of_words([(key, hasher.of(leak_words(text))) for key, text in items], masks)

    @classmethod
    def of_words(cls, items: Sequence[tuple], masks: Sequence[str]) -> SeedIndex:
        """Index of (key, word hashes) pairs."""
        flat = np.concatenate([w for _, w in items]) if items else np.empty(0, np.uint64)
        starts = np.cumsum([0, *[len(w) for _, w in items]])
        h, owner, at = [], [], []
        for salt, mask in enumerate(masks):
            # the windows of all texts at once, less those that run over a border
            seeds = _seed_hashes(flat, mask, salt)
            own = np.searchsorted(starts, np.arange(len(seeds)), "right") - 1
            inside = np.flatnonzero(np.arange(len(seeds)) + len(mask) <= starts[own + 1])
            h.append(seeds[inside])
            owner.append(own[inside].astype(np.int32))
            at.append((inside - starts[own[inside]]).astype(np.int32))
        hashes = np.concatenate(h)
        order = np.argsort(hashes, kind="stable")
        return cls(tuple(masks), [k for k, _ in items], [w for _, w in items], hashes[order], np.concatenate(owner)[order], np.concatenate(at)[order])

    def hits(self, doc: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal, position in the document) of all equal seeds."""
        found = []
        for salt, mask in enumerate(self.masks):
            seeds = _seed_hashes(doc, mask, salt)
            lo = np.searchsorted(self.hashes, seeds, "left")
            some = np.flatnonzero(lo < len(self.hashes))
            some = some[self.hashes[lo[some]] == seeds[some]]
            if not len(some):
                continue
            count = np.searchsorted(self.hashes, seeds[some], "right") - lo[some]
            pos = np.repeat(some, count)
            entry = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            found.append(np.stack([self.owner[entry], pos - self.at[entry], pos], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _reach(flags: bytes, drop: int) -> int:
    """How far to extend over equal (1) and different (0) words: +1 and -2, until ``drop`` below the best."""
    score = best = far = 0
    for i, flag in enumerate(flags, 1):
        if flag:
            score += 1
            if score > best:
                best, far = score, i
        else:
            score -= 2
            if best - score > drop:
                break
    return far


@lru_cache
def _exact(share: float) -> Fraction:
    return Fraction(share).limit_denominator(1_000_000)


def _verified_part(flags: bytes, min_equal: int, min_share: float) -> tuple[int, int] | None:
    """Longest stretch (the first of these) that begins and ends with an equal word and has ``min_equal`` of them and their ``min_share``.

    Word counts are weighed in whole numbers, so that shares are exact. The earliest begin
    that gives an end enough share also gives it the most equal words.
    """
    share = _exact(min_share)
    equal = np.frombuffer(flags, np.uint8).astype(np.int64)
    count = np.concatenate(([0], np.cumsum(equal)))
    weight = share.denominator * count - share.numerator * np.arange(len(count))
    begins, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    if not len(ends):
        return None
    least = np.minimum.accumulate(weight[begins])
    first = np.searchsorted(-least, -weight[ends])
    ends, first = ends[first < len(begins)], first[first < len(begins)]
    a = begins[first]
    size = np.where((ends > a) & (count[ends] - count[a] >= min_equal), ends - a, 0)
    at = int(size.argmax()) if len(size) else 0
    return (int(a[at]), int(ends[at])) if len(size) and size[at] else None


_STRETCH = 1 << 16


def _extend(index: SeedIndex, doc: np.ndarray, hits: np.ndarray, best: dict[int, tuple], span: int, min_equal: int, min_share: float, drop: int) -> None:
    """Extend the hits of each (item, diagonal) and keep each item's best verified overlap."""
    group = np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0) != 0, axis=1)) + 1 if len(hits) > 1 else []
    for part in np.split(hits, group) if len(hits) else []:
        item, diagonal = int(part[0, 0]), int(part[0, 1])
        own = index.words[item]
        first = max(0, diagonal)
        last = min(len(doc), diagonal + len(own))
        same = doc[first:last] == own[first - diagonal : last - diagonal]
        # an overlap with min_share has a window of ten with at least this many equal words: with
        # one less in each, 10 a + r words would hold too few, of all a the likeliest is 1 and of all r it is 9
        count = np.cumsum(same)
        if len(count) < 10 or max(count[9], (count[10:] - count[:-10]).max(initial=0)) < min(10, -(-(19 * _exact(min_share) - 9) // 1)):
            continue
        equal = same.tobytes()
        if equal.count(1) < min_equal:
            continue
        done = -1
        for pos in part[:, 2]:
            if pos + span <= done:
                continue
            at = int(pos) - first
            a, b = at - _reach(equal[:at][::-1], drop), at + span + _reach(equal[at + span :], drop)
            done = first + b
            part_equal = equal[a:b]
            n_equal, run = part_equal.count(1), max(map(len, part_equal.split(b"\0")))
            if n_equal < min_equal:
                continue
            if run < min_equal and n_equal < min_share * (b - a):
                # weak flanks: a part of the extension may pass by itself
                if (inner := _verified_part(part_equal, min_equal, min_share)) is None:
                    continue
                a, b = a + inner[0], a + inner[1]
                part_equal = equal[a:b]
                n_equal, run = part_equal.count(1), max(map(len, part_equal.split(b"\0")))
            if run >= min_equal or n_equal >= min_equal:
                row = (first + a, first + a - diagonal, b - a, n_equal, run)
                if item not in best or (row[4], row[3]) > (best[item][4], best[item][3]):
                    best[item] = row


def overlaps(index: SeedIndex, doc: np.ndarray, min_equal: int, min_share: float, drop: int = 6) -> list[tuple]:
    """Best verified overlap of a document with each item: ``item, first words, length, equal words, longest run``.

    An overlap counts if it has ``min_equal`` equal words, which are at least ``min_share`` of
    its length, or an unbroken run of ``min_equal`` words. Where a whole extension does not,
    its longest part that does is taken.
    """
    best: dict[int, tuple] = {}
    span = len(index.masks[0])
    for start in range(0, max(0, len(doc) - span + 1), _STRETCH):  # bounds the hits held at once in odd texts
        hits = index.hits(doc[start : start + _STRETCH + span - 1])
        hits[:, 1:] += start
        _extend(index, doc, hits, best, span, min_equal, min_share, drop)
    return [(item, *row) for item, row in best.items()]


_TOGETHER = 1 << 20
_MOST_FILTER_BITS = 28  # 32 MB


def _all_seeds(words: np.ndarray, masks: Sequence[str]) -> np.ndarray:
    return np.concatenate([_seed_hashes(words, mask, salt) for salt, mask in enumerate(masks)])


def held_out_words(items: DataFrame, key: str, text: str, masks: Sequence[str] = MASKS) -> DataFrame:
    """``item, k, n_words, words, seeds``: a number, the key, the word hashes and the distinct seed hashes of each item.

    An item with fewer words than a mask has no seed and cannot be searched for.
    """
    kind = items.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _WordHashes()
        for batch in batches:
            words = [hasher.of(leak_words(t)) for t in batch.column(1).to_pylist()]
            lists = [pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())) for own in (words, [np.unique(_all_seeds(w, masks)) for w in words])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int32()), *lists], ["k", "n_words", "words", "seeds"])

    cut_up = items.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(cut, f"k {kind}, n_words int, words array<bigint>, seeds array<bigint>")
    return cut_up.withColumn("item", F.monotonically_increasing_id())


def presence_filter(seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """Bits at two places for each seed hash ``h``; sized from the number of seeds so that 1 bit in 128 is set.

    The words of the filter are put together by the executors; at most ``2 ** 28`` bits come
    to the driver. Beyond a million seeds the filter lets more windows through to the join,
    never fewer.
    """
    bits = min(_MOST_FILTER_BITS, max(16, (256 * n_seeds).bit_length()))
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    places = seeds.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), low)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _present(filter_words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    bits = len(filter_words).bit_length() + 5
    out = np.ones(len(seeds), dtype=bool)
    for place in (seeds >> np.uint64(64 - bits), seeds & np.uint64((1 << bits) - 1)):
        out &= (filter_words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _suspects(filter_words: np.ndarray, masks: Sequence[str], hasher: _WordHashes, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number and distinct seed hashes that may occur in an item, of the texts that have any.

    The words of many texts are looked at in one array; a window that runs over the border
    of two texts can only raise a false alarm.
    """
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i in range(len(texts) + 1):
        if i < len(texts):
            own = hasher.of(leak_words(texts[i].as_py()))
            held.append((i, own))
            size += len(own)
        if held and (i == len(texts) or size >= _TOGETHER):
            starts = np.concatenate(([0], np.cumsum([len(w) for _, w in held])))
            words = np.concatenate([w for _, w in held])
            at, hashes = [], []
            for salt, mask in enumerate(masks):
                seeds = _seed_hashes(words, mask, salt)
                some = np.flatnonzero(_present(filter_words, seeds))
                at.append(some)
                hashes.append(seeds[some])
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            owner = np.searchsorted(starts, at, "right") - 1
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
            edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                yield held[owner[a]][0], np.unique(hashes[a:b])
            held, size = [], 0


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[int]]]:
    """Batch, first row and the rows of each run of one document in a batch sorted by document."""
    for batch in batches:
        uid = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [*np.flatnonzero(np.diff(uid, prepend=uid[0] - 1)).tolist(), len(uid)] if len(uid) else []
        for a, b in zip(edges, edges[1:]):
            yield batch, a, list(range(a, b))


def leaked_items(
    docs: DataFrame,
    doc_key: str,
    doc_text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    min_equal: int = 10,
    min_share: float = 0.9,
    masks: Sequence[str] = MASKS,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """``doc_key, item_key`` and :data:`HIT_SCHEMA` for every document that holds part of a held-out text.

    Every window of ten words of every whole document is hashed with each mask, in one scan
    of the corpus, whatever the number of items. Hashes that pass a filter of the items'
    seeds are joined with these by hash; a hash that owns many rows on either side is
    salted by document. The distinct (document, item) pairs are joined with both texts, and
    the hits of a pair are extended along their diagonals and verified word by word (64-bit
    word hashes). The items' side of a join is broadcast where its measured size is at most
    ``block_bytes``; larger ones are shuffled.

    Seeds tolerate substitutions at ignored positions; ``longest_run`` tells how many words
    agree without a break. Null and short texts (fewer words than a mask) match nothing;
    :func:`held_out_words` tells which items these are. Repeated item keys are items of their
    own and may give repeated rows.
    """
    if len({len(m) for m in masks}) != 1 or any(m[0] + m[-1] != "11" for m in masks) or len(masks[0]) > min_equal:
        raise ValueError("masks need one span of at most min_equal and must read both ends")
    if doc_key == item_key:
        raise ValueError("the two keys need different names")
    key_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_key), (items, item_key)))
    spark = docs.sparkSession
    held = materialize(held_out_words(items, item_key, item_text, masks))
    n_seeds, n_words = held.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    item_seeds = held.select("item", F.explode("seeds").alias("h"))
    shared = spark.sparkContext.broadcast(presence_filter(item_seeds, n_seeds))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = shared.value, _WordHashes()
        for batch in batches:
            found = list(_suspects(known, masks, hasher, batch.column(2)))
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], ["uid", "d", "t", "seeds"])

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_key).alias("d"), F.col(doc_text).alias("t"))
    suspects = materialize(numbered.mapInArrow(look, f"uid bigint, d {key_type}, t string, seeds array<bigint>"))
    hashes = suspects.select("uid", F.explode("seeds").alias("h"))
    if n_seeds * 32 <= block_bytes:
        met = hashes.join(F.broadcast(item_seeds), "h")
    else:
        salts = shuffle_width(spark)
        heavy = sorted({*heavy_hitters(hashes, "h")[0], *heavy_hitters(item_seeds, "h")[0]})
        is_heavy = F.col("h").isin(*heavy) if heavy else F.lit(False)
        salted = hashes.withColumn("s", F.when(is_heavy, F.pmod(F.xxhash64("uid"), F.lit(salts))).otherwise(0).cast("int"))
        spread = item_seeds.withColumn("s", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        met = salted.join(spread, ["h", "s"])
    pairs = met.select("uid", "item").distinct()
    words, texts = held.select("item", "k", "words"), suspects.select("uid", "d", "t")
    if n_words * 16 <= block_bytes:
        both = pairs.join(texts, "uid").join(F.broadcast(words), "item")  # the words join after the shuffle
    else:
        pairs = materialize(pairs)
        both = skew_join(pairs, words, "item", heavy_hitters(pairs, "item")[0]).join(texts, "uid")
    both = both.select("uid", "d", "t", "k", "words").sortWithinPartitions("uid")
    names = [doc_key, item_key, *[x.split()[0] for x in HIT_SCHEMA.split(", ")]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _WordHashes()
        for batch, first, rows in _by_document(batches):
            doc = hasher.of(leak_words(batch.column(2)[first].as_py()))
            own = batch.column(4).slice(first, len(rows))
            flat, ends = own.flatten().to_numpy().view(np.uint64), np.cumsum([0, *[len(x) for x in own]])
            index = SeedIndex.of_words([(i, flat[ends[j] : ends[j + 1]]) for j, i in enumerate(rows)], masks)
            found = sorted(overlaps(index, doc, min_equal, min_share))
            at = pa.array([rows[r[0]] for r in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(3).take(at), *[pa.array([r[j] for r in found], pa.int32()) for j in range(1, 6)]], names)

    return both.mapInArrow(verify, f"`{doc_key}` {key_type}, `{item_key}` {item_type}, {HIT_SCHEMA}")
