import math
import os
import random

import numpy as np
import pytest

from textloom.llm.languages import TOKENIZERS, PieceModel, code_of, label_code, language_stretches, plain_words, sentences, train_languages, vocabulary, wrong_labels
from textloom.util import table

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{TOKENIZERS}/piece_bpe_32k.model"), reason="no public tokenizer files")


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r[0], r[1]) for r in table(spark, data, "lang_samples").orderBy("sample_id").select("lang", "text").collect()]


def test_forward_sums_all_segmentations():
    m = PieceModel(["▁", "a", "b", "▁a", "ab", "▁ab"], ["x"])
    p = 1 / 7
    # ▁|a|b, ▁a|b, ▁|ab, ▁ab
    assert abs(float(np.exp(m.score("ab")[0])) - (p**3 + 2 * p**2 + p)) < 1e-12


def test_long_words_are_scored_whole():
    """The scaled sums of long words, alone or with others, are those of exact fractions."""
    from fractions import Fraction

    m = PieceModel(["▁", "a", "b", "▁a", "ab", "ba", "bab"], ["x"])
    p = Fraction(1, 8)
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 15, 16, 17, 64, 500, 3000)]
    m.learn(words)
    for w in words:
        text, sums = "▁" + w, [Fraction(1)]
        for j in range(1, len(text) + 1):
            arcs = [i for i in range(max(0, j - 3), j) if text[i:j] in m.ids]
            sums.append(sum((sums[i] for i in arcs), Fraction(0)) * p if j - 1 in arcs else (sum((sums[i] for i in arcs), Fraction(0)) + sums[j - 1]) * p)
        n = sums[-1]
        wanted = math.log(n.numerator) - math.log(n.denominator)
        assert abs(float(m.score(w)[0]) - wanted) < 1e-6 * len(w)
    # What stands in the middle of a very long word counts.
    assert m.score("a" * 50 + "b" * 200 + "a" * 50)[0] != m.score("a" * 300)[0]


def test_sentences_cover_the_text():
    cases = {
        "One two three. Four five six!": [3, 0], "One two three four! Ok.": [4, 1], "One two three": [0], "one two three four": [4], "Is it so?": [3], "Fine (model Big Line 200). Next one here.": [1, 3], "(Sol y Sombra) It works well now.": [4],
        "It broke. (It was the third one.) We sent it back.": [2, 5, 4], "It broke (we had it for only six days) again.": [0, 7, 1], "(only a name)": [0], "": [], "12 34!": [],
    }
    for text, wanted in cases.items():
        got = sentences(text)
        assert [n for _, _, n, _ in got] == wanted, text
        assert sum(len(w) for *_, w in got) == len(plain_words(text))
    assert len(sentences("(" * 100_000 + "word. " + ")" * 100_000)) == 1


def test_confidence_is_calibrated(samples):
    """Over beginnings of sentences not trained on, the mean confidence is near the share that is right."""
    rest = [s for k, s in enumerate(samples) if k % 3]
    half = PieceModel(vocabulary()).train(rest[1::2])
    m = PieceModel(vocabulary()).train(rest).calibrate(rest[::2], half)
    right, sure = [], []
    for lang, t in samples[::3]:
        for n in (2, 3, 4):
            got = m.stretches(" ".join(plain_words(t)[:n]))
            right.append(got[0][2] == lang)
            sure.append(got[0][3])
    assert len(right) > 500 and abs(sum(right) / len(right) - sum(sure) / len(sure)) < 0.04 and m.temperature > 0.5


def test_held_out_accuracy(samples):
    m = PieceModel(vocabulary()).train([s for k, s in enumerate(samples) if k % 4])
    held = samples[::4]
    hits = sum(m.langs[int(sum(m.score(w) for w in plain_words(t)).argmax())] == lang for lang, t in held)
    assert hits / len(held) > 0.97


def test_mixed_and_labels(spark, samples):
    of = {}
    for lang, t in samples:
        if len(t) > 45 and len(t.split()) > 6:
            of.setdefault(lang, []).append(t)
    en, de, ru = of["en"][0], of["de"][0], of["ru"][0]
    rows = [
        (1, "en", en), (2, "EN_us", en), (3, None, de), (4, " ", de), (5, "de", ru), (6, "English", f"{en} {de}"), (7, "de", f"{de} Voilà! {de}"), (8, "fr", "Short one."),
        (14, "en", f"{en} (Das gefällt mir.) {en}"), (15, "en", f"{en} {en} Das gefällt mir."), (16, "en", f"{en} Das gefällt mir! {en}"), (17, "en", f"{en} (" + ") (".join(of["de"][:5]) + f") {en}"), (18, "de", f"{de} {'xy' * 60} {de}"),
        (9, "fr", None), (10, "fr", ""), (11, None, "12345 67890 !!! " * 5), (12, "en", f"{en} (model Schöne Linie 200)"), (3, None, de), (None, "en", de), (13, "deutsch", de * 2000),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, n_words int")
    model = train_languages(spark.createDataFrame(samples, "lang string, text string"))
    stretches = language_stretches(docs, docs, model=model).cache()
    got = sorted((r.doc_id, r.lang) for r in wrong_labels(docs, docs, model=model).collect())
    assert got == [(3, "de"), (4, "de"), (5, "ru"), (6, "de"), (6, "en"), (14, "de"), (14, "en"), (15, "de"), (15, "en"), (17, "de"), (17, "en")]
    assert [r.lang for r in stretches.where("doc_id = 17").orderBy("stretch_no").collect()] == ["en", "de", "en"]
    assert wrong_labels(docs.where("false"), docs, model=model).count() == 0
    mixed = sorted((r.start, r.end, r.lang) for r in stretches.where("doc_id = 6").collect())
    assert [x[2] for x in mixed] == ["en", "de"] and mixed[0][0] == 0 and mixed[0][1] == mixed[1][0]
    assert stretches.where("confidence < 0 or confidence > 1").count() == 0
    assert language_stretches(docs.where("false"), docs, model=model).count() == 0


def test_label_code(spark):
    df = spark.createDataFrame([("en-GB",), (" Deutsch ",), ("POR",), ("xx",), ("",), (None,), ("und",)], "l string")
    assert [r[0] for r in df.select(label_code("l")).collect()] == ["en", "de", "pt", None, None, None, None]
    assert [code_of(r[0]) for r in df.collect()] == [r[0] for r in df.select(label_code("l")).collect()]
