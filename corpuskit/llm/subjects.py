"""Subject areas of documents by label propagation over a verified similarity graph of their passages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.passages import sentence_words
from corpuskit.operators.ranking import global_position
from corpuskit.operators.skew import sized_join
from corpuskit.session import discard, materialize

_BLOCK = 4096  # entries of the sorted neighbourhood in one window
_PART = 512  # nodes of a term, about, that one task compares with as many others at a time


class _TermHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def _sentence_terms(text: str | None, hashes: _TermHashes) -> list[set[int]]:
    return [set(map(hashes.__getitem__, w)) for _, _, w in sentence_words(text)] if text else []


# ---- what the terms tell

def term_information(labelled: DataFrame, k: int, smoothing: float, min_information: float) -> DataFrame:
    """``term, weight`` of the terms that tell subjects apart, from ``text, y0 ... y<k-1>`` of labelled documents.

    A sentence counts for each of its distinct words with the subjects of its document. The
    weight is the relative entropy of a term's subjects to those of all sentences, over half
    the logarithm of the number of subjects, at most 1.
    """
    y = [f"y{i}" for i in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _TermHashes()
        for batch in batches:
            own = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(k)], 1).astype(np.float64)
            index: dict[int, int] = {}
            term, doc = [], []
            sentences = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(0).to_pylist()):
                parts = _sentence_terms(t, hashes)
                sentences[i] = len(parts)
                for x in parts:
                    term += [index.setdefault(h, len(index)) for h in x]
                    doc += [i] * len(x)
            mass = _by_owner(own[np.array(doc, dtype=np.int64)], np.array(term, dtype=np.int64), len(index))
            total = (own * sentences[:, None]).sum(0)
            # the row without a term holds the sums over all sentences
            yield pa.RecordBatch.from_arrays([pa.array([*index, None], pa.int64()), *[pa.array(np.append(mass[:, i], total[i])) for i in range(k)]], ["term", *y])

    counts = labelled.select("text", *y).mapInArrow(count, "term bigint, " + ", ".join(f"{c} double" for c in y)).groupBy("term").agg(*[F.sum(c).alias(c) for c in y])
    counts = materialize(counts)
    totals = counts.where("term IS NULL").first()
    spoken = np.maximum([(totals[c] if totals else None) or 0.0 for c in y], 1e-9)
    prior = spoken / spoken.sum()
    whole = reduce(lambda a, b: a + b, [F.col(c) for c in y]) + smoothing
    parts = [(F.col(c) + float(smoothing * p)) / whole for c, p in zip(y, prior)]
    entropy = reduce(lambda a, b: a + b, [x * F.log(x / F.lit(float(p))) for x, p in zip(parts, prior)])
    weight = F.least(F.lit(1.0), entropy / float(0.5 * np.log(max(k, 2))))
    return counts.where("term IS NOT NULL").select("term", weight.cast("float").alias("weight")).where(F.col("weight") >= min_information)


# ---- passages as sets of such terms

_PASSAGES = "n_sentences bigint, passages array<struct<node bigint, n bigint>>, new array<struct<node bigint, terms array<bigint>>>"


def _passage_rows(keys: pa.Array, docs: Sequence[Sequence[Sequence[int]]], n_sentences: Sequence[int], seen: set[int]) -> pa.RecordBatch:
    """Documents as counted nodes; a node is the hash of a set of terms, and its terms are given where it is new."""
    passages, new = [], []
    if len(seen) > 1_000_000:
        seen.clear()
    for sentences in docs:
        counted = Counter(tuple(sorted(s)) for s in sentences if s)
        own, first = [], []
        for terms, n in counted.items():
            node = xxhash.xxh3_64_intdigest(np.array(terms, dtype=np.int64).tobytes()) - (1 << 63)
            own.append({"node": node, "n": n})
            if node not in seen:
                seen.add(node)
                first.append({"node": node, "terms": list(terms)})
        passages.append(own)
        new.append(first)
    node = pa.struct([("node", pa.int64()), ("n", pa.int64())])
    terms = pa.struct([("node", pa.int64()), ("terms", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([keys, pa.array(n_sentences, pa.int64()), pa.array(passages, pa.list_(node)), pa.array(new, pa.list_(terms))], ["key", "n_sentences", "passages", "new"])


def document_passages(docs: DataFrame, weights: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``key`` and :data:`_PASSAGES`: each sentence of each whole text (``key, text``) as the set of its informative terms.

    Sentences with equal sets are one node (a class of passages of similarity 1). ``weights``
    is a written table; up to ``broadcast_bytes`` its terms go to all executors and the
    texts are read in place, beyond that the terms of all sentences are joined with them.
    """
    kind = docs.schema["key"].dataType.simpleString()
    if weights.count() * 16 <= broadcast_bytes:
        known = np.array(sorted(r["term"] for r in weights.select("term").toLocalIterator()), dtype=np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, seen = _TermHashes(), set()
            wanted = set(shared.value.tolist())
            for batch in batches:
                sentences = [_sentence_terms(t, hashes) for t in batch.column(1).to_pylist()]
                yield _passage_rows(batch.column(0), [[wanted & s for s in d] for d in sentences], [len(d) for d in sentences], seen)

        return docs.select("key", "text").mapInArrow(read, f"key {kind}, {_PASSAGES}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _TermHashes()
        for batch in batches:
            sentences = [_sentence_terms(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[sorted(s) for s in d] for d in sentences], pa.list_(pa.list_(pa.int64())))], ["key", "sentences"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            yield _passage_rows(batch.column(0), batch.column(2).to_pylist(), batch.column(1).to_pylist(), seen)

    texts = materialize(docs.select("key", "text").mapInArrow(cut, f"key {kind}, sentences array<array<bigint>>").withColumn("doc", F.monotonically_increasing_id()))
    terms = texts.select("doc", F.posexplode("sentences").alias("at", "terms")).select("doc", "at", F.explode("terms").alias("term"))
    told = sized_join(terms, weights.select("term"), "term", 0).groupBy("doc", "at").agg(F.collect_list("term").alias("terms")).groupBy("doc").agg(F.collect_list("terms").alias("sets"))
    whole = texts.select("doc", "key", F.size("sentences").cast("bigint").alias("n")).join(told, "doc", "left")
    return whole.select("key", "n", F.coalesce("sets", F.array().cast("array<array<bigint>>")).alias("sets")).mapInArrow(pack, f"key {kind}, {_PASSAGES}")


# ---- the graph

def _alike(terms: list[np.ndarray], weights: list[np.ndarray], term: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Jaccard similarity of ``left`` and ``right`` sets (numbers), which all hold ``term``, and whether it is the least term of both."""
    n = np.fromiter(map(len, terms), np.int64, len(terms))
    flat, w = np.concatenate(terms), np.concatenate(weights).astype(np.float64)
    owner = np.repeat(np.arange(len(terms)), n)
    total = np.bincount(owner, weights=w, minlength=len(terms))
    # a term of one set only is common to no pair
    known, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep, known, column = (times > 1)[at], known[times > 1], np.cumsum(times > 1) - 1
    has, x = np.zeros((len(terms), len(known))), np.zeros((len(terms), len(known)))
    has[owner[keep], column[at[keep]]] = 1
    x[owner[keep], column[at[keep]]] = w[keep]
    both = x[left] @ has[right].T
    before = has[:, known < term]
    return both / (total[left][:, None] + total[right] - both), before[left] @ before[right].T == 0


def _all_partners(sets: DataFrame, min_similarity: float) -> DataFrame:
    """``a, b, w`` with ``a < b``: every pair of ``node, terms, weights`` of at least this similarity, once.

    The nodes of a term are cut by hash into parts of about ``_PART``, and each two parts meet
    in a group of their own, so that no term is too long for a task. A pair is scored with
    its whole sets and kept at the least of its common terms. The work grows with the pairs
    that have a common term.
    """
    entries = sets.withColumn("term", F.explode("terms"))
    parts = materialize(entries.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term", F.ceil(F.col("n") / _PART).cast("int").alias("parts")))
    placed = sized_join(entries, parts, "term").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("term", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "terms", "weights")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        term, i, j = (k.as_py() for k in key)
        node, p = group["node"].to_numpy(), group["p"].to_numpy()
        left, right = np.flatnonzero(p == i), np.flatnonzero(p == j)
        similar, least = _alike(group["terms"].to_numpy().tolist(), group["weights"].to_numpy().tolist(), term, left, right)
        w = similar.astype(np.float32)
        # each pair once, inside a part as well
        x, y = np.nonzero((w >= np.float32(min_similarity)) & least & ((i < j) | (node[left][:, None] < node[right])))
        a, b = node[left[x]], node[right[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": w[x, y]})

    return met.groupBy("term", "i", "j").applyInArrow(compare, "a bigint, b bigint, w float")


def _next_partners(sets: DataFrame, neighbours: int, min_similarity: float) -> DataFrame:
    """``a, b, w`` with ``a < b``: pairs that are near each other in the order of a term's nodes by their other terms."""
    sets = sets.select("node", "terms", F.map_from_arrays("terms", "weights").alias("m"))
    entries = sets.select(F.explode("terms").alias("term"), "node", "terms", "m").withColumn("rest", F.array_remove("terms", F.col("term")))
    placed = global_position(entries.drop("terms"), ["term", "rest", "node"], "at").drop("rest")
    block = F.expr(f"at div {_BLOCK}")
    # the first entries of a block are seen from the block before as well
    seen = placed.withColumn("b", F.explode(F.when((F.col("at") % _BLOCK < neighbours) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))
    order = Window.partitionBy("b").orderBy("at")
    ahead = F.array(*[F.lead(F.struct("term", "node", "m"), j).over(order) for j in range(1, neighbours + 1)])
    pairs = seen.withColumn("next", ahead).where(F.col("b") == block).select("term", "node", "m", F.explode("next").alias("x")).where("x.term = term AND x.node <> node")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    both = F.aggregate(F.map_values(F.map_filter("m", lambda t, _: F.map_contains_key("x.m", t))), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"), (both / (total("m") + total("x.m") - both)).cast("float").alias("w"))
    return scored.where(F.col("w") >= min_similarity).groupBy("a", "b").agg(F.max("w").alias("w"))


def similarity_graph(nodes: DataFrame, weights: DataFrame, neighbours: int | None, min_similarity: float) -> DataFrame:
    """``a, b, w`` in both directions: verified edges between nodes (``node, terms``), those of one ``b`` together.

    An edge is kept if the weighted Jaccard similarity of the two sets, computed exactly, is at
    least ``min_similarity`` (above 0), which is its weight. With ``neighbours`` None, the
    graph is whole: every such pair has its edge (:func:`_all_partners`). With a number, it
    is a part of that graph, linear in the number of terms of all nodes: a node has one entry
    for each of its terms, all entries are range-sorted by (term, the node's other terms from
    the heaviest to the lightest), and an entry meets only the next ``neighbours`` ones of its
    term.
    """
    if not min_similarity > 0:
        raise ValueError("min_similarity must be above 0")
    own = sized_join(nodes.select("node", F.explode("terms").alias("term")), weights, "term").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.round("weight", 1)).alias("r"), "term", "weight"))).alias("t"))
    sets = own.select("node", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    edges = _all_partners(materialize(sets), min_similarity) if neighbours is None else _next_partners(sets, neighbours, min_similarity)
    return edges.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("e")).select("e.*").repartition("b").sortWithinPartitions("b")


def propagate(edges: DataFrame, clamped: DataFrame, start: DataFrame | None, k: int, tolerance: float, max_rounds: int, small: bool, rounds_per_table: int = 4) -> DataFrame:
    """``node, q0 ... q<k-1>``, a written table: the subjects of every node that the labels reach, as shares that may add up to less than 1.

    A node's share of a subject is the mean over its labelled sentences (``clamped``: ``node,
    n, y0 ...``, the same in every round) and its neighbours, weighted by similarity. Rounds
    of joins go on until the shares of a node move by less than ``tolerance`` on average in
    ``rounds_per_table`` rounds, after each of which the state is written. The shares are
    broadcast if ``small``; otherwise both sides are shuffled. A node has at most one edge to
    each node with a term of its own.
    """
    q = [f"q{i}" for i in range(k)]
    fixed = clamped.selectExpr("node", "cast(n as double) as d", *[f"y{i} as q{i}" for i in range(k)])

    def one_round(state: DataFrame | None) -> DataFrame:
        parts = fixed
        if state is not None:
            told = state.withColumnRenamed("node", "a")
            sent = edges.join(F.broadcast(told) if small else told, "a").selectExpr("b as node", "cast(w as double) as d", *[f"w * {c} as {c}" for c in q])
            parts = sent.union(fixed)
        sums = parts.groupBy("node").agg(F.expr("sum(d) as d"), *[F.expr(f"sum({c}) as {c}") for c in q])
        return sums.selectExpr("node", *[f"cast({c} / d as float) as {c}" for c in q])

    state = start
    for _ in range(-(-max_rounds // rounds_per_table)):
        after = state
        for _ in range(rounds_per_table):
            after = one_round(after)
        after = materialize(after)
        if state is None:
            state = after
            continue
        differ = " + ".join(f"abs(coalesce({c}, 0) - coalesce(o{i}, 0))" for i, c in enumerate(q))
        change = after.join(state.selectExpr("node", *[f"{c} as o{i}" for i, c in enumerate(q)]), "node", "full").agg(F.avg(F.expr(differ))).first()[0] or 0.0
        if state is not start:
            discard(state)
        state = after
        if change < tolerance:
            break
    return state


# ---- reading the documents

def _by_owner(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=x[:, i], minlength=n) for i in range(x.shape[1])], 1)


def _shares(k: int, subjects: Sequence[str], min_share: float, min_evidence: float):
    """Documents (key, number of sentences, passages with shares) to their subjects, by the best reading of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            n = flat.field(0).to_numpy(zero_copy_only=False).astype(np.float64)
            s = np.stack([flat.field(1 + i).to_numpy(zero_copy_only=False) for i in range(k)], 1).astype(np.float64)
            weight = n * (s.max(1, initial=0.0) >= min_evidence)
            about = _by_owner(s * weight[:, None], owner, len(lists))
            mix = (about + 0.1) / (about.sum(1, keepdims=True) + 0.1 * k)
            best = np.zeros_like(s)
            best[np.arange(len(s)), (np.log(s + 1e-3) + np.log(mix)[owner]).argmax(1)] = weight
            count = _by_owner(best, owner, len(lists))
            total = batch.column(1).to_numpy(zero_copy_only=False)
            doc, subject = np.nonzero((count > 0) & (count >= min_share * total[:, None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array([subjects[i] for i in subject], pa.string()), pa.array(total[doc]), pa.array(count[doc, subject].astype(np.int64))], ["key", "subject", "n_sentences", "n_of_subject"]
            )

    return run


def document_subjects(
    docs: DataFrame,
    key: str,
    text: str,
    labels: DataFrame,
    subjects: Sequence[str],
    label_subject: str = "subject",
    min_share: float = 0.25,
    min_information: float = 0.3,
    smoothing: float = 3.0,
    neighbours: int | None = None,
    min_similarity: float = 0.2,
    min_evidence: float = 0.45,
    min_trust: float = 0.15,
    tolerance: float = 0.03,
    max_rounds: int = 40,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``key, subject, n_sentences, n_of_subject``: every subject that at least ``min_share`` of a document's sentences speak of.

    ``labels`` has the document key and a subject; it may be partly wrong, repeated or null.
    Labelled documents are the seeds. Each sentence is a passage, seen as the set of its
    terms that tell subjects apart (:func:`term_information`); equal sets are one node, and
    a sentence without such a term has no subject (small talk). Nodes are linked by verified
    similarity (:func:`similarity_graph`; all partners, unless ``neighbours`` is a number), and labels spread along the edges
    (:func:`propagate`), where the sentences of trusted seeds stay clamped to their labels. A
    seed is trusted while at least ``min_trust`` of its sentences, weighed by their shares,
    bear out its labels; the labels then spread anew from the trusted ones, until no more than
    a hundredth of the seeds gains or loses trust (three times at most). Several labels, and several subjects
    of a document, are kept throughout. A sentence has the subject that its node's shares
    and the mix of its document speak for, and none if the greatest share is below ``min_evidence``.

    Null and wordless texts have no sentence and no subject. Documents without a key are
    out, those with one key count as one document. Labels of unknown documents, null labels
    and subjects not in ``subjects`` are left out; without labels there are no rows. A
    sentence counts as often as it occurs.
    """
    k = len(subjects)
    q, y = [f"q{i}" for i in range(k)], [f"y{i}" for i in range(k)]
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    named = labels.where(F.col(key).isNotNull() & F.col(label_subject).isin(*subjects)).groupBy(F.col(key).alias("key")).agg(*[F.max((F.col(label_subject) == name).cast("double")).alias(c) for c, name in zip(y, subjects)])
    n_labels = reduce(lambda a, b: a + b, [F.col(c) for c in y])
    seeds = materialize(named.select("key", *[(F.col(c) / n_labels).alias(c) for c in y]))
    weights = materialize(term_information(sized_join(texts, seeds, "key"), k, smoothing, min_information))
    read = materialize(document_passages(texts, weights, broadcast_bytes))
    nodes = materialize(read.select(F.explode("new").alias("p")).groupBy("p.node").agg(F.first("p.terms").alias("terms")))
    edges = materialize(similarity_graph(nodes, weights, neighbours, min_similarity))
    small = nodes.count() * (4 * k + 24) <= broadcast_bytes
    occurrences = read.select("key", F.explode("passages").alias("p")).select("key", "p.node", "p.n")
    sizes = sized_join(read.select("key", "n_sentences"), seeds.select("key"), "key").groupBy("key").agg(F.sum("n_sentences").alias("m"))
    said = materialize(sized_join(occurrences, seeds, "key"))
    n_seeds = seeds.count()
    trusted, n_trusted, state = None, n_seeds, None
    for _ in range(3):
        mine = said if trusted is None else sized_join(said, trusted, "key")
        clamped = materialize(mine.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in y]))
        state = propagate(edges, clamped, state, k, tolerance, max_rounds, small)
        borne_out = reduce(lambda a, b: a + b, [F.when(F.col(b) > 0, F.col(a)).otherwise(0.0) for a, b in zip(q, y)])
        agree = sized_join(said, state, "node").groupBy("key").agg(F.sum(F.col("n") * borne_out).alias("g"))
        trusted = materialize(agree.join(sizes, "key").where(F.col("g") >= min_trust * F.col("m")).select("key"))
        before, n_trusted = n_trusted, trusted.count()
        if abs(before - n_trusted) <= 0.01 * n_seeds:
            break
    scored = sized_join(occurrences, state, "node")
    counted = read.select("key", F.col("n_sentences").alias("m"), F.lit(None).cast(f"struct<n: bigint, {', '.join(f'{c}: float' for c in q)}>").alias("p"))
    whole = scored.select("key", F.lit(0).cast("bigint").alias("m"), F.struct("n", *q).alias("p")).unionByName(counted).groupBy("key").agg(F.sum("m").alias("m"), F.collect_list("p").alias("p"))
    return whole.mapInArrow(_shares(k, list(subjects), min_share, min_evidence), f"key {kind}, subject string, n_sentences bigint, n_of_subject bigint").withColumnRenamed("key", key)
