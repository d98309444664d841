"""Language of documents and of the segments of mixed documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.passages import sentence_words

# The languages, by family.
FAMILIES: dict[str, tuple[str, ...]] = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt"), "slavic": ("ru",)}
UNDETERMINED = "und"

_CACHE_WORDS = 400_000


def language_code(label: Column | str) -> Column:
    """A label trimmed, cut at the first ``-`` or ``_``, in lower case; null stays null."""
    c = F.col(label) if isinstance(label, str) else label
    return F.lower(F.regexp_extract(F.trim(c), "^[^-_]*", 0))


def _features(word: str, bits: int) -> list[int]:
    """Hashed character n-grams (1 to 4) of a word with its borders, and the word itself."""
    w = f"<{word}>"
    mask = (1 << bits) - 1
    grams = {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} | {f"={word}"}
    return [zlib.crc32(g.encode()) & mask for g in grams]


class _Rows:
    """Sparse rows of equal weights: means of gathered rows, forwards and backwards."""

    def __init__(self, rows: Sequence[Sequence[int]], width: int) -> None:
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.indices = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(lengths.sum()))
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.scale = 1.0 / np.maximum(lengths, 1)
        owner = np.repeat(np.arange(len(rows)), lengths)
        order = np.argsort(self.indices, kind="stable")
        self.back, values = owner[order], self.indices[order]
        self.used, self.back_starts = np.unique(values, return_index=True)
        self.width = width

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.indices], self.starts) * self.scale[:, None]

    def spread(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, g.shape[1]))
        out[self.used] = np.add.reduceat((g * self.scale[:, None])[self.back], self.back_starts)
        return out


@dataclass
class LanguageModel:
    """A family classifier and, inside each family, one-versus-one linear support vector machines.

    A word's score vector is a mean over its hashed n-grams, a sentence's the mean over its
    words, so scores are additive and each distinct word is scored once.
    """

    bits: int
    families: dict[str, tuple[str, ...]]
    weights: np.ndarray  # features x classifiers
    bias: np.ndarray
    slope: np.ndarray
    known: tuple[bool, ...]
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    @property
    def languages(self) -> list[str]:
        return [x for f in self.families.values() for x in f]

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return [p for f in self.families.values() for p in combinations(f, 2)]

    def forget(self) -> None:
        self.cache, self.scores = {}, None

    def _rows_of(self, words: Sequence[str]) -> np.ndarray:
        """Rows of ``scores`` for some words; a word is scored when it is first seen."""
        if self.scores is None or len(self.cache) > _CACHE_WORDS:
            self.cache, self.scores = {}, np.empty((1024, len(self.bias)))
        for w in set(words).difference(self.cache):
            n = len(self.cache)
            if n == len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[n] = self.weights[_features(w, self.bits)].mean(0)
            self.cache[w] = n
        return np.array(list(map(self.cache.__getitem__, words)), dtype=np.int64)

    def log_probabilities(self, sentences: Sequence[Sequence[str]]) -> np.ndarray:
        """log P(language) per non-empty sentence: P(family) times the coupled pairwise votes."""
        lengths = np.array([len(s) for s in sentences])
        rows = self._rows_of([w for s in sentences for w in s])
        margin = (np.add.reduceat(self.scores[rows], np.concatenate(([0], np.cumsum(lengths)[:-1]))) / lengths[:, None] + self.bias) * self.slope
        log_sigmoid = -np.logaddexp(0, -margin)
        log_not = -np.logaddexp(0, margin)
        names, langs = list(self.families), self.languages
        known = np.array(self.known)
        out = np.zeros((len(sentences), len(langs)))
        family_known = [any(known[langs.index(x)] for x in self.families[f]) for f in names]
        family = np.where(family_known, log_sigmoid[:, : len(names)], -40.0)
        family -= np.logaddexp.reduce(family, axis=1)[:, None]
        for k, (a, b) in enumerate(self.pairs, len(names)):
            if known[langs.index(a)] and known[langs.index(b)]:
                out[:, langs.index(a)] += log_sigmoid[:, k]
                out[:, langs.index(b)] += log_not[:, k]
        out[:, ~known] = -40.0
        at = 0
        for i, f in enumerate(names):
            cols = slice(at, at + len(self.families[f]))
            out[:, cols] -= np.logaddexp.reduce(out[:, cols], axis=1)[:, None]
            out[:, cols] += family[:, i : i + 1]
            at += len(self.families[f])
        return out


def _targets(labels: Sequence[str], model_languages: list[str], families: Mapping[str, Sequence[str]], pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Targets of +1 and -1, and weights that balance the two sides of each classifier."""
    lab = np.array(labels)
    cols = []
    for f in families:
        cols.append(np.where(np.isin(lab, families[f]), 1.0, -1.0))
    for a, b in pairs:
        cols.append(np.where(lab == a, 1.0, np.where(lab == b, -1.0, 0.0)))
    y = np.stack(cols, 1)
    pos, neg = (y > 0).sum(0), (y < 0).sum(0)
    weight = np.where(y > 0, 0.5 / np.maximum(pos, 1), np.where(y < 0, 0.5 / np.maximum(neg, 1), 0.0))
    return y, weight


def fit(sentences: Sequence[Sequence[str]], labels: Sequence[str], families: Mapping[str, Sequence[str]] = FAMILIES, bits: int = 15, steps: int = 120, rounds: int = 2, ridge: float = 1e-6) -> LanguageModel:
    """Fit on sentences with possibly wrong labels.

    Squared-hinge linear machines by full-batch Adam. After each round but the last, the
    sentences whose label the machines reject are left out, which takes care of wrong
    labels and of the other language in mixed documents.
    """
    families = {k: tuple(v) for k, v in families.items()}
    langs = [x for f in families.values() for x in f]
    pairs = [p for f in families.values() for p in combinations(f, 2)]
    k = len(families) + len(pairs)
    model = LanguageModel(bits, families, np.zeros((1 << bits, k)), np.zeros(k), np.ones(k), tuple(x in set(labels) for x in langs))
    kept = [i for i, s in enumerate(sentences) if s]
    for number in range(rounds):
        if not kept:
            break
        own, lab = [sentences[i] for i in kept], [labels[i] for i in kept]
        vocabulary: dict[str, int] = {}
        s = _Rows([[vocabulary.setdefault(w, len(vocabulary)) for w in x] for x in own], 0)
        s.width = len(vocabulary)
        f = _Rows([_features(w, bits) for w in vocabulary], 1 << bits)
        y, weight = _targets(lab, langs, families, pairs)
        w, b = model.weights, model.bias
        m1 = [np.zeros_like(w), np.zeros_like(b)]
        m2 = [np.zeros_like(w), np.zeros_like(b)]
        for t in range(1, steps + 1):
            margin = s.mean(f.mean(w)) + b
            short = np.maximum(0.0, 1.0 - y * margin) * (y != 0)
            g = -2.0 * weight * short * y
            grads = [f.spread(s.spread(g)) + ridge * w, g.sum(0)]
            rate = 0.3 * min(1.0, 2.0 * (1 - (t - 1) / steps))
            for p, d, a, v in zip((w, b), grads, m1, m2):
                a *= 0.9
                a += 0.1 * d
                v *= 0.99
                v += 0.01 * d * d
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        margin = s.mean(f.mean(w)) + b
        model.slope = _slopes(margin, y, weight)
        model.forget()
        if number + 1 < rounds:
            best = model.log_probabilities(own).argmax(1)
            kept = [i for i, p in zip(kept, best) if langs[p] == labels[i]]
    return model


def _slopes(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope of a logistic curve through each classifier's margins, between 1 and 8."""
    slope = np.full(y.shape[1], 2.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(y * margin * slope, -30, 30)))
        first = (weight * p * y * margin).sum(0)
        second = (weight * p * (1 - p) * margin**2).sum(0) + 1e-6
        slope = np.clip(slope + first / second * 0.5, 1.0, 8.0)
    return slope


def segment_languages(scores: np.ndarray, switch_cost: float = 4.0, least: int = 2) -> np.ndarray:
    """Most probable language of each sentence, changing only between runs of at least ``least`` sentences."""
    n, k = scores.shape
    if n < 2 * least or (scores.argmax(1) == scores[0].argmax()).all():
        return np.full(n, scores.sum(0).argmax())
    # state (r, language): the current run has r + 1 sentences, the last r standing for more
    best = np.full((least, k), -np.inf)
    best[0] = scores[0]
    back = np.zeros((n, least, k), dtype=np.int64)
    for i in range(1, n):
        new = np.full((least, k), -np.inf)
        for r in range(1, least):
            new[r] = best[r - 1]
            back[i, r] = (r - 1) * k + np.arange(k)
        stay = best[least - 1] > new[least - 1]
        new[least - 1] = np.where(stay, best[least - 1], new[least - 1])
        back[i, least - 1] = np.where(stay, (least - 1) * k + np.arange(k), back[i, least - 1])
        done = best[least - 1]
        order = np.argsort(-done)
        origin = np.where(np.arange(k) == order[0], order[1] if k > 1 else order[0], order[0])
        new[0] = done[origin] - switch_cost
        back[i, 0] = (least - 1) * k + origin
        best = new + scores[i]
    state = (least - 1) * k + int(best[least - 1].argmax())
    out = np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        out[i] = state % k
        state = int(back[i].reshape(-1)[state])
    return out


SEGMENT_SCHEMA = "seg_no int, n_segments int, lang string, confidence double, n_sentences int, first_char int, last_char int"


def _scored(model: LanguageModel, texts: Sequence[list]) -> Iterator[np.ndarray]:
    """Sentence scores of each text, computed for many texts at a time."""
    held: list[list] = []
    size = 0
    for i, own in enumerate(texts):
        held.append(own)
        size += len(own)
        if size >= 20_000 or i + 1 == len(texts):
            whole = model.log_probabilities([w for t in held for _, _, w in t]) if size else np.empty((0, len(model.languages)))
            at = 0
            for t in held:
                yield whole[at : at + len(t)]
                at += len(t)
            held, size = [], 0


def all_segments(model: LanguageModel, texts: Sequence[str | None]) -> list[list[tuple]]:
    """Rows of :data:`SEGMENT_SCHEMA` for each text; a text without words is one undetermined segment."""
    cut = [sentence_words(t) if t else [] for t in texts]
    out = []
    for text, own, scores in zip(texts, cut, _scored(model, cut)):
        if not own:
            out.append([(1, 1, UNDETERMINED, 0.0, 0, 0, len(text or ""))])
            continue
        tags = segment_languages(scores)
        edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(own)]
        rows = []
        for number, (a, b) in enumerate(zip(edges, edges[1:]), 1):
            sure = float(np.exp(scores[a:b, tags[a]]).mean())
            rows.append((number, len(edges) - 1, model.languages[tags[a]], sure, b - a, own[a][0], own[b - 1][1]))
        out.append(rows)
    return out


def text_segments(model: LanguageModel, text: str | None) -> list[tuple]:
    return all_segments(model, [text])[0]


def training_sentences(docs: DataFrame, key: str, text: str, label: str, languages: Sequence[str], docs_per_language: int, sentences_per_language: int, words_per_sentence: int) -> DataFrame:
    """``words, label``: a bounded sample, by hash, of sentences of documents whose label names one of ``languages``.

    Sentences of more than ``words_per_sentence`` words are not drawn. The labels are counted
    first, so that about twice the wanted documents of each come to the ranking, whatever
    the number of tasks.
    """
    code = language_code(label)
    labelled = docs.select(F.col(text).alias("text"), code.alias("label"), F.xxhash64(F.lit("langid"), F.col(key)).alias("h")).where(F.col("label").isin(*languages) & F.col("text").isNotNull())
    share = labelled.groupBy("label").agg((F.lit(2.0 * docs_per_language + 50) / F.count("*")).alias("share"))  # a row for each language
    drawn = labelled.join(F.broadcast(share), "label").where((F.col("h").cast("double") / float(1 << 64) + 0.5) < F.col("share")).drop("share")
    few = drawn.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= docs_per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, lab, zlib.crc32(f"{h}:{a}".encode())) for t, lab, h in zip(*(batch.column(i).to_pylist() for i in range(3))) for a, _, w in sentence_words(t) if len(w) <= words_per_sentence]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["words", "label", "h"])

    cut_up = few.select("text", "label", "h").mapInArrow(cut, "words array<string>, label string, h bigint")
    ranked = cut_up.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", F.concat_ws(" ", "words"))))
    return ranked.where(F.col("r") <= sentences_per_language).select("words", "label")


def detect_languages(
    docs: DataFrame,
    key: str,
    text: str,
    label: str,
    families: Mapping[str, Sequence[str]] = FAMILIES,
    docs_per_language: int = 400,
    sentences_per_language: int = 2000,
    words_per_sentence: int = 200,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per segment of each document: ``key, seg_no, n_segments, lang, confidence, ...`` (:data:`SEGMENT_SCHEMA`).

    The machines are fitted on a sample of labelled documents of this table: at most
    ``docs_per_language`` documents and ``sentences_per_language`` sentences for each
    language the label column names, chosen by hash, of sentences of at most ``words_per_sentence`` words. They then read every sentence of
    every document. A language without any labelled sentence is never predicted; without
    any labelled sentence at all every segment is undetermined with confidence 0.

    Null, empty and wordless texts give one segment ``und`` with confidence 0. ``keep`` names
    further columns to carry along; others are ignored.
    """
    languages = [x for f in families.values() for x in f]
    sample = sorted((tuple(r["words"]), r["label"]) for r in training_sentences(docs, key, text, label, languages, docs_per_language, sentences_per_language, words_per_sentence).collect())
    model = fit([s for s, _ in sample], [x for _, x in sample], families)
    model.forget()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x classifiers doubles
    source = docs.select(key, *keep, F.col(text).alias("_text"))
    kept = [f for f in source.schema if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [SEGMENT_SCHEMA])
    fields = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    trained = bool(sample)

    def label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = all_segments(m, texts) if trained else [[(1, 1, UNDETERMINED, 0.0, 0, 0, len(t or ""))] for t in texts]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            rows = [r for f in found for r in f]
            own = [batch.column(i).take(owner) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.name for f in kept] + fields)

    return source.mapInArrow(label_batches, schema)
