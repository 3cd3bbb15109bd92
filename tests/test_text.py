import pytest

from textloom.functions import splitting, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("low\\nhill", "low\nhill"), ("a\r\n\r\n\nb\r", "a\nb"), ("tab\there   and  there ", "tab here and there"), ("rate : high :low", "rate: high:low"), (" \t one \n\n two\u00a0\n", "one\ntwo\n"), ("", ""), (None, None)],
)
def test_sanitize(spark, given, wanted):
    assert one(spark, given, text.sanitize) == wanted


def test_garbled_table_follows_the_rule(spark):
    forms = text.garbled_forms()
    assert len(forms) == 110
    for bad, good in forms.items():
        assert one(spark, f"a{bad}b", text.repair_garbled) == f"a{good}b"
    assert one(spark, None, text.repair_garbled) is None


def test_repair_is_one_pass(spark):
    twice = "".join(bytes([b]).decode("cp1252", "replace") for b in "Ã‰".encode())
    assert twice == "Ãƒâ€°" and one(spark, twice, text.repair_garbled) == "Ã‰"
    assert one(spark, "cafÃ© â€“ ok Ã", text.repair_garbled) == "café – ok Ã"


def test_byte_alphabet(spark):
    assert one(spark, "a é\n", text.byte_alphabet) == "aĠÃ©Ċ"
    assert one(spark, "", text.byte_alphabet) == ""
    assert len(set(text.byte_characters())) == 256


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Don't they've I'm it's", ["Don", "'t", " they", "'ve", " I", "'m", " it", "'s"]),
        ("CAN'T we'RE", ["CAN", "'", "T", " we", "'", "RE"]),
        ("two  spaces,12 and½", ["two", "  ", "spaces", ",", "12", " and", "½"]),
        ("\nrow\n\n end", ["\n", "row", "\n", "\n", " end"]),
        ("off<|endoftext|>on <|padding|>", ["off", "<|endoftext|>", "on", " ", "<|padding|>"]),
        ("off<|endof\ntext|>", ["off", "<|", "endof", "\n", "text", "|>"]),
        ("", []),
        (None, None),
    ],
)
def test_split_words(spark, given, wanted):
    assert one(spark, given, lambda c: splitting.split_words(c, ("<|endoftext|>", "<|padding|>"))) == wanted


def test_words_ignores_other_columns_and_bad_rows(spark):
    df = spark.createDataFrame([(1, "a b\nc", "x"), (1, "a b\nc", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, word string")
    rows = splitting.words(df).collect()
    assert len(rows) == 8
    assert {(r.line_no, r.word_no, r.word) for r in rows} == {(0, 0, "a"), (0, 1, " b"), (0, 2, "\n"), (1, 0, "c")}
    assert splitting.words(df.where("false")).count() == 0


def test_occurrences(spark):
    assert one(spark, "the other the", lambda c: splitting.occurrences(c, "the")) == [0, 5, 10]
    assert one(spark, "none", lambda c: splitting.occurrences(c, "")) == []


def test_locations(spark):
    assert tuple(one(spark, "s3://b/k/x", text.split_location)) == (True, "b", "k/x")
    assert tuple(one(spark, "s3://b", text.split_location)) == (True, "b", "")
    assert tuple(one(spark, "/k/x", text.split_location)) == (False, "", "/k/x")


def test_escapes(spark):
    for s in ('a"b\\\n\té\u0001', "", "plain"):
        assert one(spark, one(spark, s, lambda c: text.escape_json("x")), text.unescape_json) == s


def test_character_classes(spark):
    for c, wanted in (("\n", "newline"), ("\t", "space"), ("é", "letter"), ("７", "number"), ("!", "symbol")):
        assert one(spark, c, text.character_class) == wanted


def test_replacements(spark):
    assert one(spark, "‘a’…b", lambda c: text.replace_all(c, {"‘": "'", "’": "'", "…": "...", "a'": "x"})) == "'a'...b"
    assert one(spark, "  x ", lambda c: text.leading_space(c)) == "   x "
    assert one(spark, "a\n", text.newline_as_separator) == "a</s>"
