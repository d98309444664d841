import random

from pyspark.sql import functions as F

from corpuskit.llm.subjects import document_subjects, propagate, similarity_graph

NOUNS = {"sport": "goals matches leagues strikers referees", "music": "violins choirs chords drummers melodies", "law": "judges courts verdicts clauses wills"}
TALK = ["We have about nine minutes left and then we stop.", "It was raining this morning and nobody went out.", "Thank you so much for listening to us."]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for d in range(n):
        own = rng.sample(sorted(NOUNS), 1 + (d % 4 == 0))
        sentences, said = [], []
        for _ in range(8):
            s = rng.choice([*own, None]) if rng.random() < 0.9 else rng.choice(sorted(NOUNS))
            said.append(s)
            if s is None:
                sentences.append(rng.choice(TALK))
            else:
                a, b = rng.sample(NOUNS[s].split(), 2)
                sentences.append(rng.choice([f"The {a} have more to do than the {b} in the end.", f"People have argued about the {a} and still the {b} get all attention.", f"First come the {a} and then the {b} of the year."]))
        docs.append((d, " ".join(sentences)))
        truth |= {(d, s): True for s in NOUNS if said.count(s) * 4 >= len(said)}
    return docs, set(truth)


def run(spark, docs, labels, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"subject": F.lit("clash"), "key": F.lit(1), "passage": F.lit(2)})
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    return {(r["doc_id"], r["subject"]) for r in document_subjects(d, "doc_id", "text", lab, sorted(NOUNS), **more).collect()}


def test_subjects_from_few_partly_wrong_labels(spark):
    docs, truth = corpus()
    rng = random.Random(2)
    labels = [(d, s, "a") for d, s in sorted(truth) if d < 90]
    labels = [(d, rng.choice(sorted(NOUNS)), a) if i % 12 == 0 else (d, s, a) for i, (d, s, a) in enumerate(labels)]
    labels += [(1, None, "a"), (None, "law", "a"), (9999, "law", "b"), (3, "astrology", "c")] + labels[:5]
    extra = [(1000, None), (1001, ""), (1002, TALK[0]), (1003, "?! 12")]
    got = run(spark, docs + extra, labels)
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003}
    held = {x for x in truth if x[0] >= 90}
    hit = {x for x in got if x[0] >= 90}
    assert len(held & hit) >= 0.93 * len(held) and len(held & hit) >= 0.93 * len(hit)


def test_partitions_do_not_matter_and_long_documents(spark):
    docs, truth = corpus(120, 5)
    labels = [(d, s, "a") for d, s in sorted(truth) if d < 60]
    long = [(500, " ".join(t for _, t in docs[:100]) + " " + "x" * 200_000)]
    one = run(spark, docs + long, labels)
    assert one == run(spark, list(reversed(docs + long)), labels)


def test_nothing_to_say(spark):
    docs, _ = corpus(6)
    assert run(spark, docs, []) == set() and run(spark, [], [(1, "law", "a")]) == set()


def test_terms_that_are_not_broadcast(spark):
    docs, truth = corpus(100, 7)
    labels = [(d, s, "a") for d, s in sorted(truth) if d < 50]
    extra = [(200, None), (201, ""), (None, docs[0][1])]
    assert run(spark, docs + extra, labels, broadcast_bytes=0) == run(spark, docs + extra, labels)


def jaccard(a, b, w):
    return sum(w[t] for t in a & b) / sum(w[t] for t in a | b)


def test_edges_are_verified_and_link_what_is_alike(spark):
    rng = random.Random(4)
    w = {t: rng.choice([0.5, 0.75, 1.0]) for t in range(30)}
    w[0] = 1.0  # a term of every other node
    sets = list({frozenset([0] * (i % 2) + rng.sample(range(1, 30), rng.randint(1, 4))) for i in range(400)})
    nodes = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node bigint, terms array<bigint>")
    weights = spark.createDataFrame(sorted(w.items()), "term bigint, weight float")
    edges = {(r["a"], r["b"]): r["w"] for r in similarity_graph(nodes, weights, 2, 0.3).collect()}
    assert edges and all((b, a) in edges and a != b for a, b in edges)
    assert all(abs(x - jaccard(sets[a], sets[b], w)) < 1e-5 and x >= 0.3 for (a, b), x in edges.items())
    assert len(edges) <= 4 * sum(map(len, sets))
    # whoever has a partner of great similarity has an edge to one
    alike = {a for a in range(len(sets)) if any(a != b and jaccard(sets[a], sets[b], w) >= 0.7 for b in range(len(sets)))}
    linked = {a for (a, _), x in edges.items()}
    assert len(alike - linked) <= 0.02 * len(alike)


def test_labels_reach_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))], "a bigint, b bigint, w float")
    clamped = spark.createDataFrame([(0, 1, 1.0, 0.0)], "node bigint, n bigint, y0 double, y1 double")
    for small in (True, False):
        got = {r["node"]: (r["q0"], r["q1"]) for r in propagate(edges, clamped, None, 2, 0.0001, 100, small).collect()}
        assert len(got) == 12 and all(a > 0.9 and b == 0 for a, b in got.values())


def test_the_whole_graph_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    w = {t: rng.choice([0.5, 0.75, 1.0]) for t in range(-10, 30)}
    sets = [frozenset([0] * (i % 2) + rng.sample(sorted(w), rng.randint(1, 6))) for i in range(300)]  # 0: a term of every other node
    sets.append(frozenset([29]))
    nodes = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node bigint, terms array<bigint>")
    weights = spark.createDataFrame(sorted(w.items()), "term bigint, weight float")
    wanted = {(a, b): x for a in range(len(sets)) for b in range(len(sets)) if a != b and (x := jaccard(sets[a], sets[b], w)) >= 0.21}
    for part in (512, 40):
        monkeypatch.setattr("corpuskit.llm.subjects._PART", part)
        rows = similarity_graph(nodes, weights, None, 0.21).collect()
        got = {(r["a"], r["b"]): r["w"] for r in rows}
        assert len(rows) == len(got) and set(got) == set(wanted) and all(abs(x - wanted[e]) < 1e-5 for e, x in got.items())
