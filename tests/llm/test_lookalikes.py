import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.lookalikes import Canonicalizer, SpellingTrie, canonical_form, look, lookalike_classes, lookalike_pairs

FORM = Canonicalizer(["café", "office", "Кассир", "сор", "email"])

SAME = [
    ("café", "café"), ("café", "ｃａｆé"), ("office", "of​fice"), ("office", "oﬃce"), ("a b", "a b"), ("a b", "a b"), ("a-b", "a‑b"), ("a-b", "a－b"),
    ("Kelvin", "Kelvin"), ("Mail", "Маіl"), ("Кассир", "Kaccиp"), ("сор", "cop"), ("soft", "so­ft"), ("ij", "ĳ"), ("12", "１２"), ("o", "ο"), ("ẹ́", "ẹ́"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("2", "²"), ("1", "①"), ("1/2", "½"), ("TM", "™"), ("a.", "a"), ("…", "..."), ("’", "'"), ("и", "й"), ("–", "-"), ("a  b", "a b"), ("", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert FORM(a) == FORM(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert FORM(a) != FORM(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20), st.text(max_size=20))
def test_form_is_a_function_of_the_looks(a, b):
    assert (FORM(a) == FORM(b)) == (look(a) == look(b))
    assert FORM(FORM(a)) == FORM(a)
    assert FORM(unicodedata.normalize("NFD", a)) == FORM(a)


def test_canonical_spellings():
    assert FORM("Kaccиp") == "Кассир" and FORM("ｏﬃce!") == "office!" and FORM("​") == ""


def test_budget():
    trie = SpellingTrie(["colour"], budget=1)
    for close in ("colοur", "colaur", "color", "coloour", "co​lour", "olour"):
        assert trie.find(close) == "colour", close
    for far in ("calaur", "colo", "coloourr"):
        assert trie.find(far) is None, far
    assert SpellingTrie(["colour"]).find("colaur") is None and SpellingTrie([]).find("") is None


def test_arcs_of_the_automaton():
    """The trie itself, without any table before it, takes look-alikes, composed and joined letters, marks in any order and hidden characters."""
    trie = SpellingTrie(["Кассир", "café", "office", "ẹ́a", "сор", "cop", "ﬁx"])
    for run, word in (("Kaccиp", "Кассир"), ("cafe\u0301", "café"), ("cafе\u200b\u0301", "café"), ("oﬃce", "office"), ("of\u200bfice", "office"), ("e\u0301\u0323a", "ẹ́a"), ("é\u0323a", "ẹ́a"), ("сop", "cop"), ("fix", "ﬁx"), ("ﬁx", "ﬁx")):
        assert trie.find(run) == word, run
    assert trie.find("cafe") is None and trie.find("Café") is None and trie.find("caf") is None and trie.find("cafés") is None


def test_without_the_arcs_pairs_are_lost(spark, monkeypatch):
    from textloom.llm import lookalikes

    df = spark.createDataFrame([("line", 1, "Кассир"), ("line", 2, "Kaccиp"), ("line", 3, "сор"), ("line", 4, "cop")], "kind string, id long, value string")
    vocab = spark.createDataFrame([("Кассир", 1), ("сор", 2)], "piece string, token long")
    with_arcs = lookalikes.Canonicalizer(["Кассир", "сор"])
    assert with_arcs("сop") == with_arcs("сор") == "сор"
    assert {tuple(r) for r in lookalike_pairs(df, vocab).collect()} == {("line", 1, 2), ("line", 3, 4)}
    without = lookalikes.Canonicalizer(["сор"])
    without.trie = SpellingTrie(["сор"], alike=False)
    assert without("сop") != without("сор")


def test_classes_and_common_spellings(spark, monkeypatch):
    """A third of all rows in one class of exact copies, and two common spellings, dealt out in parts."""
    from textloom.llm import lookalikes

    monkeypatch.setattr(lookalikes, "PART_ROWS", 7)
    rows = [("line", k, "same") for k in range(100)] + [("line", 100 + k, "café") for k in range(30)] + [("line", 200 + k, "cafe\u0301") for k in range(20)] + [("line", 300, "ｃafé"), ("line", 300, "ｃafé"), ("line", 301, "x")]
    df = spark.createDataFrame(rows, "kind string, id long, value string")
    vocab = spark.createDataFrame([("café", 1)], "piece string, token long")
    pairs = [tuple(r) for r in lookalike_pairs(df, vocab).collect()]
    assert len(pairs) == len(set(pairs)) == 30 * 20 + 30 + 20
    got = {r.id: (r.class_id, r.n_spellings, r.n_links) for r in lookalike_classes(df, vocab).collect()}
    assert len(got) == 51 and len({c for c, *_ in got.values()}) == 1
    assert got[100][1:] == (3, 21) and got[200][1:] == (3, 31) and got[300][1:] == (3, 50)
    assert lookalike_classes(df.where("false"), vocab).count() == 0


def test_pairs(spark):
    rows = [("line", 1, "café"), ("line", 2, "café"), ("line", 3, "cafe"), ("line", 4, "café"), ("line", 4, "café"), ("config", 2, "café"), ("config", 9, "ｃafé"), ("line", 5, None), (None, 6, "café"), ("line", None, "café"), ("line", 7, ""), ("line", 8, "​")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "kind string, id long, value string, canonical string")
    vocab = spark.createDataFrame([("café", 1), (None, 2)], "piece string, token long")
    got = {tuple(r) for r in lookalike_pairs(df, vocab).collect()}
    assert got == {("line", 1, 2), ("line", 2, 4), ("config", 2, 9), ("line", 7, 8)}
    assert lookalike_pairs(df.where("false"), vocab.where("false")).count() == 0


def test_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("ｘ" * 100_000,)], "t string")
    vocab = spark.createDataFrame([("x", 1)], "piece string, token long")
    assert [r[0] for r in canonical_form(df, "t", vocab).select("canonical").collect()] == [None, "", "x" * 100_000]
