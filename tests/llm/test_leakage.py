import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm.leakage import MASKS, SeedIndex, _verified_part, held_out_words, leak_words, leaked_items, overlaps


def brute(docs, items, least=10):
    out = set()
    for d, t in docs:
        w = leak_words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for k, s in items:
            v = leak_words(s)
            if any(tuple(v[i : i + least]) in grams for i in range(len(v) - least + 1)):
                out.add((d, k))
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit("clash"), "n_words": F.lit(1)})
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    return leaked_items(d, "doc_id", "text", i, "item_id", "text", **more)


def found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.where("longest_run >= 10").collect()}


@pytest.mark.parametrize("block", [64 << 20, 400])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for k in range(30)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "too short")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 2:
            own = leak_words(rng.choice(items[:30])[1])
            a = rng.randint(0, max(0, len(own) - 8))
            at = rng.randint(0, len(words))
            words[at:at] = own[a : a + rng.randint(7, 13)]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, items[1][1].upper().replace("1", "​1"))]
    assert found(run(spark, docs, items, block_bytes=block)) == brute(docs, items)


def test_substitutions_are_tolerated(spark):
    words = [f"x{i}" for i in range(30)]
    changed = [w if i % 12 else "other" for i, w in enumerate(words)]
    got = run(spark, [(1, " ".join(changed))], [(1, " ".join(words))]).collect()
    assert len(got) == 1 and got[0]["n_equal"] >= 25 and got[0]["n_words"] - got[0]["n_equal"] >= 1
    assert got[0]["item_first_word"] == got[0]["doc_first_word"]


def test_weak_flanks_do_not_hide_an_overlap():
    flags = [1] * 9 + [0] + [1] * 9 + [0, 1, 1, 1] * 3
    words = [f"x{i}" for i in range(len(flags))]
    index = SeedIndex.build([(1, " ".join(words))], MASKS)
    doc = SeedIndex.build([(1, " ".join(w if f else "other" for w, f in zip(words, flags)))], MASKS)
    ((item, doc_first, item_first, n_words, n_equal, run),) = overlaps(index, doc.words[0], 10, 0.9)
    assert (item, doc_first, item_first, run) == (0, 0, 0, 9) and n_equal >= 18 and n_equal >= 0.9 * n_words


def test_verified_part_equals_brute_force():
    rng = np.random.default_rng(5)
    for share in (0.9, 0.5, 0.75):
        for _ in range(150):
            flags = (rng.random(rng.integers(1, 45)) < rng.choice([0.6, 0.8, 0.9])).astype(np.uint8)
            fits = [(b - a, -a) for a in range(len(flags)) for b in range(a + 1, len(flags) + 1) if flags[a] and flags[b - 1] and flags[a:b].sum() >= max(10, share * (b - a))]
            want = (-max(fits)[1], max(fits)[0] - max(fits)[1]) if fits else None
            assert _verified_part(flags.tobytes(), 10, share) == want


def test_repeats_long_texts_and_nothing(spark):
    same = "la " * 30
    assert found(run(spark, [(1, "la " * 4000)], [(1, same), (2, "lo " * 30)])) == {(1, 1)}
    long = "word " * 200_000 + " ".join(f"y{i}" for i in range(12))
    assert found(run(spark, [(1, long)], [(7, " ".join(f"y{i}" for i in range(12)))])) == {(1, 7)}
    assert run(spark, [], [(1, same)]).count() == 0 and run(spark, [(1, same)], []).count() == 0


def test_masks_read_their_ends():
    assert all(len(m) == 10 and m[0] == m[-1] == "1" for m in MASKS)


@pytest.mark.parametrize("block", [64 << 20, 1])
def test_hot_seeds_and_hot_items(spark, block):
    shared = "thank you all so much for listening and see you again very soon"
    items = [(k, f"{shared} item{k} has its own end of words and nothing else at all") for k in range(20)]
    docs = [(d, f"start{d} {shared} end{d}") for d in range(400)] + [(900 + d, f"nothing of note in text {d} " * 3) for d in range(300)]
    assert found(run(spark, docs, items, block_bytes=block)) == {(d, k) for d in range(400) for k in range(20)}


@pytest.mark.parametrize("per_ten,share,least", [(1, 0.9, 0.97), (2, 0.8, 0.9)])
def test_recall_of_passages_with_substitutions(spark, per_ten, share, least):
    """1,000 planted passages of 20 to 40 words, with so many random words of each ten replaced."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=60))) for k in range(100)]
    docs, planted = [], set()
    for d in range(1000):
        k = rng.randrange(100)
        own = items[k][1].split()
        n = rng.choice([20, 30, 40])
        a = rng.randint(0, 60 - n)
        part = own[a : a + n]
        for block in range(0, n, 10):
            for i in rng.sample(range(10), per_ten):
                part[block + i] = "changed"
        docs.append((d, " ".join(rng.choices(vocabulary, k=30) + part + rng.choices(vocabulary, k=30))))
        planted.add((d, k))
    docs += [(2000 + d, " ".join(rng.choices(vocabulary, k=90))) for d in range(500)]
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, docs, items, min_share=share).collect()}
    assert got <= planted and len(got) >= least * len(planted)


def test_short_items_are_told(spark):
    items = spark.createDataFrame([(1, "nine words are too few for any of these"), (2, "ten words are just enough for all of the masks"), (3, None)], "item_id bigint, text string")
    assert {r["k"]: len(r["seeds"]) > 0 for r in held_out_words(items, "item_id", "text").collect()} == {1: False, 2: True, 3: False}
