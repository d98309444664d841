import numpy as np
import pytest

from corpuskit.llm.langid import FAMILIES, detect_languages, fit, language_code, segment_languages, text_segments
from corpuskit.llm.passages import sentences, words

EN = "We spoke about the weather. Nobody knew what the others thought of it. They said that it would be better next year."
DE = "Wir haben über das Wetter gesprochen. Niemand wusste, was die anderen davon hielten. Sie sagten, dass es nächstes Jahr besser wird."
FR = "Nous avons parlé du temps. Personne ne savait ce que les autres en pensaient. Ils ont dit que ce serait mieux l'an prochain."


def test_sentences_and_marks():
    cut = lambda t: [t[a:b] for a, b in sentences(t)]
    assert cut("A: Hello there. Yes!\nB: No\nand more\n- item\n\nTitle\n\nEnd… ok") == ["Hello there.", "Yes!", "No\nand more", "item", "Title", "End…", "ok"]
    assert cut("en: One. www.some.example/ep1") == ["One."]
    assert cut("") == cut(" \n\t") == cut("12 34.") == []
    assert words("Soft­hyphen x@y.z https://a.b/c a.com/x Ü") == ["softhyphen", "ü"]


@pytest.mark.parametrize("text", ["." * 300_000, "a" * 300_000, "\n" * 300_000, "a/" * 100_000, "- " * 100_000, "\n \n" * 100_000])
def test_odd_long_texts_take_linear_time(text):
    assert len(sentences(text)) <= 1


def model():
    per = {"en": EN, "de": DE, "fr": FR}
    return fit([words(s) for t in per.values() for s in t.split(". ")] * 3, [k for k, t in per.items() for _ in t.split(". ")] * 3, steps=60)


def test_segments_need_two_sentences_and_follow_the_text():
    m = model()
    got = text_segments(m, f"{EN} {DE}\n{FR}")
    assert [(r[0], r[2], r[4]) for r in got] == [(1, "en", 3), (2, "de", 3), (3, "fr", 3)]
    assert all(r[1] == 3 and 0 < r[3] <= 1 for r in got)
    one = text_segments(m, EN + " Niemand wusste es. " + EN)
    assert [r[2] for r in one] == ["en"]
    assert text_segments(m, None) == [(1, 1, "und", 0.0, 0, 0, 0)] and text_segments(m, "123 ...")[0][2] == "und"
    long = text_segments(m, (EN + " ") * 3000 + (DE + " ") * 3000)
    assert [(r[2], r[4]) for r in long] == [("en", 9000), ("de", 9000)]


def test_least_run_is_kept():
    rng = np.random.default_rng(0)
    for n in range(1, 12):
        tags = segment_languages(np.log(rng.dirichlet(np.ones(4), n)), switch_cost=0.1)
        edges = np.flatnonzero(np.diff(tags)) + 1
        runs = np.diff(np.concatenate(([0], edges, [n])))
        assert len(runs) == 1 or runs.min() >= 2


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string, lang string, confidence string, label string")


def test_detection_survives_wrong_labels_and_odd_rows(spark):
    rows = [(i, t, k if i % 7 else "es", None, "x") for i, (k, t) in enumerate([("en", EN), ("DE-de", DE), (" fr", FR)] * 15)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, EN + "\n" + DE, "mul", "c", "l"), (103, "?!", "en", None, None)]
    got = detect_languages(table(spark, rows), "id", "text", "lang").orderBy("id", "seg_no").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["lang"])
    assert all(by[i] == [["en", "de", "fr"][i % 3]] for i in range(45))
    assert by[100] == by[101] == by[103] == ["und"] and by[102] == ["en", "de"]


def test_without_labels_or_rows(spark):
    assert detect_languages(table(spark, []), "id", "text", "lang").count() == 0
    got = detect_languages(table(spark, [(1, EN, None, None, None), (2, DE, "klingon", None, None)]), "id", "text", "lang").collect()
    assert [r["lang"] for r in got] == ["und", "und"]


def test_label_codes(spark):
    df = spark.createDataFrame([(" EN-us",), ("de_AT",), ("ru",), (None,), ("",)], "lang string")
    assert [r[0] for r in df.select(language_code("lang")).collect()] == ["en", "de", "ru", None, ""]


def test_held_out_accuracy_on_the_table(spark, data):
    """Sentences of languages with a script or label of their own are found on documents that gave no training sentence."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = detect_languages(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang", docs_per_language=20)
    labels = {r[0]: r[1] for r in docs.select("doc_id", language_code("lang")).collect()}
    known = [x for f in FAMILIES.values() for x in f]
    single = [(r["lang"], labels[r["doc_id"]]) for r in got.where("n_segments = 1").collect() if labels[r["doc_id"]] in known]
    assert sum(a == b for a, b in single) >= 0.8 * len(single)  # the labels themselves are wrong in about a tenth
