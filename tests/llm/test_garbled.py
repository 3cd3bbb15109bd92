import dataclasses
from collections import Counter

import pytest

from textloom.llm.garbled import CHAINS, LOSSY, SINGLE, GarbleModel, Repairer, garble, repair_lines, ungarble
from textloom.util import table


@pytest.mark.parametrize("chain", CHAINS, ids=">".join)
def test_chains_invert(chain):
    for word in ("déjà", "größer", "żółw", "пришёл", "São"):
        bad = garble(word, chain)
        if bad is None or bad == word or "�" in bad:
            continue
        back = ungarble(bad, chain)
        assert back == word or len(chain) % 2 or back is None or chain[0] != "utf-8"


@pytest.fixture(scope="module")
def model(spark, data):
    clean = [r[0] for r in table(spark, data, "lang_samples").select("text").collect()]
    return GarbleModel.train(clean, clean), clean


FAMILIES = {"utf-8": [c for c in CHAINS if c[0] == "utf-8"], "single": SINGLE, "lossy": list(LOSSY)}


@pytest.fixture(scope="module")
def held_out(spark, data):
    """The classifier of every second clean sentence with the word counts of a corpus, and the other sentences."""
    clean = [r[0] for r in table(spark, data, "lang_samples").where("text is not null").orderBy("sample_id").select("text").collect()]
    lines = [r[0] for r in table(spark, data.replace("0.001", "0.1"), "encode_lines").where("text is not null").select("text").collect()]
    return Repairer(GarbleModel.train(clean[::2], lines)), clean[1::2]


@pytest.mark.parametrize(("family", "found", "restored"), [("utf-8", 0.99, 0.95), ("single", 0.97, 0.93), ("lossy", 0.95, 0)])
def test_held_out_recall(held_out, family, found, restored):
    """Sentences whose words no bigram was trained on, garbled by every chain; a chain that ends in lower case can't be restored."""
    fix, texts = held_out
    tried = hits = same = keeps_case = 0
    least = {}
    for chain in FAMILIES[family]:
        mine = [(t, g) for t in texts if not t.isascii() and (g := garble(t, chain)) is not None and g != t]
        got = [(t, *fix(g)[:2]) for t, g in mine]
        tried += len(got)
        hits += sum(hit for _, hit, _ in got)
        if chain[-1] != "lower":
            keeps_case += len(got)
            same += sum(back == t for t, _, back in got)
        if len(got) > 20:
            least[chain] = sum(hit for _, hit, _ in got) / len(got)
    # The last of all chains are those between two code pages with Cyrillic letters or frames in the same places.
    assert tried > 400 and hits / tried >= found and same / keeps_case >= restored and min(least.values()) >= 0.85, least


def test_held_out_precision(held_out):
    fix, texts = held_out
    assert not [t for t in texts if fix(t)[0]]


def test_every_row_comes_from_the_classifier(held_out):
    """Without its classes for lost characters, and with clean text always the likeliest, nothing but proven UTF-8 is found."""
    fix, _ = held_out
    model = fix.model
    table = model.table.copy()
    table[0] = 0
    none = Repairer(dataclasses.replace(model, table=table))
    for bad in ("caf\ufffd ouvert", "ungef?hr so", "a \x96 b", "größer".encode("cp1252").decode("cp850")):
        assert fix(bad)[0] and not none(bad)[0], bad
    assert none("fÃ¼r")[0]


@pytest.mark.parametrize("text", ["Ð-series", "who knows?maybe", "3 m²", "37°C", "LINHA ÂNCORA, NÃO É?", "« Île »", "It\xa0stopped\xa0working", "Dіnеrо tіrаdо", "ｏｒｄｅｒ", "²", "", "plain"])
def test_odd_but_intended(model, text):
    assert not Repairer(model[0])(text)[0]


def test_lost_and_partial(model):
    fix = Repairer(model[0])
    assert fix("caf�")[0] and fix("caf�")[3]
    assert fix("der Aufbau fÃ¼r mich – gut")[:2] == (True, "der Aufbau für mich – gut")
    assert fix("a \x96 b")[:2] == (True, "a – b")


def test_rows(spark, model):
    rows = [(1, "fÃ¼r"), (1, "fÃ¼r"), (2, None), (3, ""), (4, "für"), (5, "x" * 100_000 + " Ã©")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "line_id long, text string, restored string")
    clean = spark.createDataFrame([(t,) for t in model[1]], "text string")
    got = {r.line_id: r.restored for r in repair_lines(df, clean).collect()}
    assert got == {1: "für", 5: "x" * 100_000 + " é"}
    assert repair_lines(df.where("false"), clean.where("false")).count() == 0


@pytest.mark.parametrize(("text", "lost"), [("ungef?hr", True), ("who knows?maybe", False), ("Wirklich?", False), ("NÃO É??", False), ("", False), ("?", False)])
def test_question_marks(model, text, lost):
    own = dataclasses.replace(model[0], marked=model[0].marked + Counter({"ungefähr": 50, "é": 50}), lossy=model[0].lossy + Counter({"ungef?hr": 50, "?": 50}), cores=model[0].cores + Counter({"wirklich": 50, "é": 50}))
    assert Repairer(own)(text)[3] == lost


def test_words_are_counted_over_all_lines(spark, model):
    # 15 lines of 60,000 hold the word.
    lines = spark.range(60_000).selectExpr("id as line_id", "case when id % 4000 = 7 then 'ungefähr' when id = 1 then 'ungef?hr' else 'plain words' end as text")
    clean = spark.createDataFrame([(t,) for t in model[1] if "ungefähr" not in t.lower()], "text string")
    assert [(r.line_id, r.lost) for r in repair_lines(lines, clean).collect()] == [(1, True)]
