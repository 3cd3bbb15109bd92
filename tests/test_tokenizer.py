import os
import random
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import binary, sql
from textloom.operators import tokenizer, trimming
from textloom.operators.tokenizer import TOKENIZERS, TokenizerSpec, byte_level_vocab, load

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no public tokenizer files")


@pytest.fixture(scope="module")
def gpt2():
    return tokenizer.gpt2()


#: Sentences without runs of spaces, which the public library splits otherwise.
TEXTS = ["", "Kites drift over Łódź at noon.", "don't we'll they've I'm", "3 apples cost 12,50 €!", "Grüße — naïve façade…", "日本語 текст 🙂", "x = [y for y in range(10)]", "⁂⁂ stars"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    held.encode_special_tokens = True
    return lambda text: held.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_library(gpt2, public, text):
    assert gpt2.encoder()(text) == public(text)
    assert gpt2.decoder()(public(text)) == text


def test_specials_stand_alone(gpt2, public):
    end, pad = gpt2.vocab["<|endoftext|>"], gpt2.vocab["<|padding|>"]
    assert gpt2.encoder()("kites<|endoftext|> drift<|padding|>!") == [*public("kites"), end, *public(" drift"), pad, *public("!")]
    assert gpt2.encoder()("kites<|end\noftext|>") == [*public("kites<|end"), *public("\n"), *public("oftext|>")]


def test_newline_mode(gpt2, public):
    e = replace(gpt2, newline_separator=True, cross_word=False).encoder()
    assert e("Kites drift.\nLow") == [*public("Kites drift"), *public(".</"), *public("s"), *public(">"), *public("Low")]


def scanned(parts, ranks):
    """Merging by looking at all pairs again and again."""
    while len(parts) > 1:
        pair = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if pair not in ranks:
            break
        out, k = [], 0
        while k < len(parts):
            hit = tuple(parts[k : k + 2]) == pair
            out.append("".join(parts[k : k + 2]) if hit else parts[k])
            k += 2 if hit else 1
        parts = out
    return parts


def test_merging_equals_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        pieces, ranked = list("abc"), []
        for _ in range(rng.randrange(1, 9)):
            pair = (rng.choice(pieces), rng.choice(pieces))
            if pair not in ranked:
                ranked.append(pair)
                pieces.append("".join(pair))
        rng.shuffle(ranked)
        ranks = {m: k for k, m in enumerate(ranked)}
        word = [rng.choice("abc") for _ in range(rng.randrange(14))]
        assert tokenizer.merged_parts(list(word), ranks) == scanned(word, ranks)


@pytest.mark.parametrize("make", [lambda n: "\n" * n, lambda n: "".join(random.Random(1).choices("abcdefghijklmnop", k=n)), lambda n: "ab " * n])
def test_time_grows_with_the_text(gpt2, make):
    def took(n):
        best = 1e9
        for _ in range(3):
            e, text = gpt2.encoder(), make(n)
            began = time.perf_counter()
            e(text)
            best = min(best, time.perf_counter() - began)
        return best

    took(1000)
    assert took(80_000) < 8 * took(20_000) + 0.05


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    spec = tokenizer.gpt2() if not hasattr(test_round_trip, "spec") else test_round_trip.spec
    test_round_trip.spec = spec
    assert spec.decoder()(spec.encoder()(text)) == text


def test_pull_equals_whole(gpt2):
    text = "One line.\nAnd another\n\nline, without end" * 50
    e = replace(gpt2, add_bos=True, add_eos=True).encoder()
    for size in (1, 7, 4096):
        parts = list(tokenizer.pull(e, [text[k : k + 13] for k in range(0, len(text), 13)], size))
        assert [t for p in parts for t in p] == e(text) and all(len(p) == size for p in parts[:-1])
    assert list(tokenizer.pull(gpt2.encoder(), [], 5)) == []


def test_pull_merges_as_far_back_as_a_piece_reaches():
    # A piece of 100 letters, which is only made once the last of 100 lines of one letter is there.
    vocab = {"a": 0, "\n": 1, "a\n": 2} | {"a\n" * k: k + 1 for k in range(2, 101)}
    merges = [("a", "\n"), *(("a\n", "a\n" * k) for k in range(1, 100))]
    spec = load("x", vocab, merges, byte_level=False, specials=())
    for text in ("a\n" * 100, "a\n" * 250 + "a", "\n" * 300):
        got = [t for p in tokenizer.pull(spec.encoder(), list(text), 3) for t in p]
        assert got == spec.encoder()(text)


def test_pull_of_a_long_line(gpt2, monkeypatch):
    monkeypatch.setattr(tokenizer, "LONG_LINE", 50)
    text = "It's a very long   line they'll never end, <|endoftext|> 12 34!? " * 20 + "w" * 300
    for step in (1, 7, 90):
        got = [t for p in tokenizer.pull(gpt2.encoder(), [text[k : k + step] for k in range(0, len(text), step)], 11) for t in p]
        assert got == gpt2.encoder()(text)


def test_columns(spark, gpt2):
    df = spark.createDataFrame([(1, "Kites drift low."), (2, None), (3, "")], "doc_id long, text string")
    rows = {r[0]: r for r in df.select("doc_id", tokenizer.encode("text", gpt2).alias("t")).withColumn("back", tokenizer.decode("t", gpt2)).collect()}
    assert rows[1].t == gpt2.encoder()("Kites drift low.") and rows[1].back == "Kites drift low."
    assert rows[2].t is None and rows[2].back is None
    assert rows[3].t == [] and rows[3].back == ""


def test_dictionary_equals_direct(spark, gpt2):
    spec = replace(gpt2, cross_word=False)
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    direct = {r[0]: r[1] for r in df.select("doc_id", tokenizer.encode("text", spec)).collect() if r[1]}
    assert {r[0]: r[1] for r in tokenizer.encode_by_dictionary(df, spec).collect()} == direct


def test_cross_word_merges():
    vocab, merges = byte_level_vocab([("a", "Ġ"), ("aĠ", "b")])
    spec = TokenizerSpec("x", vocab, merges)
    whole = vocab["aĠb"]
    assert spec.encoder()("a b") == [whole]
    assert replace(spec, cross_word=False).encoder()("a b") == [vocab["a"], vocab["Ġ"], vocab["b"]]
    done = [vocab["a"]]
    tokenizer.merge_across(done, [vocab["Ġ"], vocab["b"]], spec.id_merges)
    assert done == [whole]


def test_ready_and_trim(gpt2, public):
    d = gpt2.decoder()
    kite, star = public("kite"), public("⁂")
    assert len(star) > 1 and d.ready(star[:-1]) == 0 and d.ready(star) == len(star)
    assert d.trim(kite + star[:-1]) == kite and d.trim([]) == [] and d.ready(kite + star + kite) == len(kite + star + kite)
    assert d(star[:-1]) == "" and d([None, *kite, 999_999]) == "kite"
    # Wherever a sequence is cut, what is ready is the longest part that is text.
    tokens = public("ab ⁂⁂ é🙂 日本")
    for n in range(len(tokens) + 1):
        whole = max(k for k in range(n + 1) if d.raw(tokens[:k]).decode("utf-8", "replace").isprintable() and "\ufffd" not in d.raw(tokens[:k]).decode("utf-8", "replace"))
        assert d.ready(tokens[:n]) == whole


def test_byte_fallback_and_unknown_pieces():
    vocab = {f"0x{b:02x}": b for b in range(256)} | {"ab": 300, "a": 301, "b": 302, " ": 303}
    spec = load("llama", vocab, [("a", "b")], specials=())
    assert spec.encoder()("ab é") == [300, 303, 0xC3, 0xA9]
    assert spec.decoder()([300, 303, 0xC3, 0xA9]) == "ab é"
    assert spec.decoder().ready([0xC3]) == 1
    none = load("llama", {"a": 1}, [], specials=())
    assert none.encoder()("abc") == [1]


def test_end_of_word():
    vocab, merges = byte_level_vocab([("h", "i</w>")], after=tuple(f"{c}</w>" for c in "hi!'s1") + ("<|startoftext|>", "<|endoftext|>"))
    spec = load("clip", vocab, merges)
    tokens = spec.encoder()("Hi !")
    assert tokens[0] == vocab["<|startoftext|>"] and tokens[-1] == vocab["<|endoftext|>"]
    assert tokens[1] == vocab["hi</w>"]
    assert spec.decoder()(tokens[1:-1]) == "hi! "


def test_ignore_merges_and_width():
    letters = tokenizer.byte_characters()
    vocab = {c: k for k, c in enumerate(letters)} | {"hello": 70_000} | {f"<x{k}>": 300 + k for k in range(66_000)}
    spec = load("llama3", vocab, [], specials=(), add_bos=False, add_eos=False)
    assert spec.encoder()("hello") == [70_000]
    assert spec.wide and spec.pad_token == 0xFFFFFFFF


def test_pads(gpt2):
    assert gpt2.pad_token == 50257
    assert load("llama", {"a": 0}, [], specials=()).pad_token == 65535


def test_single_token_and_exclusion(gpt2, public):
    assert [gpt2.single_token("\\n")] == public("\n")
    with pytest.raises(ValueError):
        gpt2.single_token("two words")
    less = gpt2.without(["Ġdrift"])
    assert public(" drift")[0] not in less.encoder()("Kites drift low.")
    assert less.decoder()(less.encoder()("Kites drift low.")) == "Kites drift low."


PROSE = ["Kites drift low over the hill.", "Nobody minds the rain today!", "Is the gate still open?"]
LINES = "\n" + "".join(f"{p}\n" for p in PROSE)


@pytest.mark.parametrize("way", ["top", "bottom"])
@pytest.mark.parametrize("kept", [1, 2])
def test_trims(gpt2, way, kept):
    e, d = gpt2.encoder(), gpt2.decoder()
    text = "  ".join(PROSE)
    some = PROSE[-kept:] if way == "top" else PROSE[:kept]
    wanted = (" " if way == "top" else "") + "  ".join(some)
    # Below the limit, so one more than the tokens of what stays, and up to those of one sentence more.
    for limit in (len(e(wanted)) + 1, len(e(wanted)) + 4):
        assert d(trimming.sentences_within(e, d, e(text), way, limit)) == wanted
    assert d(trimming.sentences_within(e, d, e(text), way, len(e(wanted)))) != wanted
    lines = "".join(f"\n{p}" for p in some) + "\n" if way == "top" else "\n" + "".join(f"{p}\n" for p in some)
    assert d(trimming.lines_within(e, d, e(LINES), way, len(e(lines)))) == lines
    assert trimming.sentences_within(e, d, e(text), way, 99) == trimming.lines_within(e, d, e(text), way, 99) == e(text)
    assert trimming.lines_within(e, d, e(text), "none", 3) == trimming.sentences_within(e, d, e(text), "none", 3) == []


def test_trims_equal_brute_force(gpt2):
    e, d = gpt2.encoder(), gpt2.decoder()
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["A b c. ", "Word!  ", "Short\nline. ", "x.y z? ", "Déjà vu… ", "No end "]) for _ in range(rng.randrange(1, 12)))
        for limit in (3, 8, 15):
            best = ""
            for m in trimming._SENTENCE.finditer(text):
                part = text[: m.end() + (text[m.end() : m.end() + 1] == "\n")]
                if len(e(part)) >= limit:
                    break
                best = part
            got = trimming.sentences_within(e, d, e(text), "bottom", limit)
            assert got == (e(text) if len(e(text)) <= limit else e(best))


def test_incomplete_sentence(gpt2):
    e, d = gpt2.encoder(), gpt2.decoder()
    kept = lambda t: d(trimming.whole_sentences(e, d, e(t)))
    text = "Kites drift low over the hill in the rain. Nobody minds it at all today."
    assert kept(f"{text} And") == text and kept(f"{text}And then") == text and kept(f"{text}\nAnd") == text
    for same in (text, "One. Two three four five", "no mark at all", "", f"{text} (done)", "  \n"):
        assert kept(same) == same.strip() or kept(same) == same


def test_align(gpt2):
    e, d = gpt2.encoder(), gpt2.decoder()
    tokens = e("ab ⁂⁂⁂ cd")
    for n in range(1, len(tokens) + 2):
        chunk, at = trimming.aligned(e, d, tokens, n)
        assert len(chunk) <= n and d.ready(chunk) == len(chunk) and at <= len(tokens)
        assert d(chunk) == d(tokens[:at]) and at == d.ready(tokens[:n])
    # Letters spelt one by one make room for more text when they are spelt as usual.
    letters = [t for c in "kites drift" for t in e(c)] + e("⁂")[:1] + e("⁂")[1:] + e(" low")
    n = len(letters) - len(e(" low")) - 1
    chunk, at = trimming.aligned(e, d, letters, n)
    assert d(chunk) == "kites drift⁂ low" and at == len(letters)
    assert trimming.aligned(e, d, [], 5) == ([], 0)


def test_binary(spark):
    df = spark.createDataFrame([([1, 65535],), ([],), (None,)], "t array<bigint>")
    got = df.select(binary.to_hex("t").alias("h"), binary.to_binary("t").alias("b"), binary.from_binary(binary.to_binary("t", True), True).alias("back"), binary.from_binary(F.unhex(F.lit("0100FF"))).alias("odd")).collect()
    assert got[0].h == "0100FFFF" and bytes(got[0].b) == b"\x01\x00\xff\xff" and got[0].back == [1, 65535] and got[0].odd == [1]
    assert got[1].h == "" and got[1].back == [] and got[2].b is None
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([([70000],)], "t array<bigint>").select(binary.to_hex("t")).collect()


def test_sql_functions(spark, gpt2):
    sql.register(spark, gpt2, "t")
    assert spark.sql("select t_decode(t_encode('Kites drift')), t_count('Kites drift'), t_count(cast(null as string))").first()[0:3] == ("Kites drift", len(gpt2.encoder()("Kites drift")), None)
    assert [tuple(r) for r in spark.sql("select * from t_explode('two words')").collect()] == [(0, gpt2.vocab["two"], "two"), (1, gpt2.vocab["Ġwords"], "Ġwords")]
