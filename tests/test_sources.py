import json

import pytest

from textloom.operators import ordering, vocabularies
from textloom.sources import resources
from textloom.sources.texts import harvest, json_texts, list_texts, numbered_lines, object_texts, read_texts
from textloom.sources.token_files import TokenFiles


@pytest.fixture()
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.md").write_text("# three")
    lines = ['{"text": "Hello, World!"}', "broken", '{"meta": [{"text": "in"}, {"x": {"text": "deep"}}]}', '{"text": 5}', '{"text": "last"}']
    (tmp_path / "sub" / "c.jsonl").write_text("\n".join(lines))
    (tmp_path / "d.bin").write_text("no")
    return str(tmp_path)


def test_read_texts(spark, corpus):
    got = {r.path: r.text for r in read_texts(spark, corpus, sort_spec="size_descending").collect()}
    assert got == {"a.txt": "one\ntwo", "sub/b.md": "# three", "sub/c.jsonl[0]": "Hello, World!", "sub/c.jsonl[2]": "in***\ndeep", "sub/c.jsonl[4]": "last"}
    assert {r.path for r in read_texts(spark, f"{corpus}/a.txt").collect()} == {"a.txt"}
    assert list_texts(spark, corpus).count() == 3
    with pytest.raises(ValueError):
        list_texts(spark, f"{corpus}/sub", (".none",))


def test_numbered_lines_over_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f"{k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(int(r.line) == r.line_no for r in rows)


def test_object_texts(spark, corpus):
    got = {r.path.rsplit("/", 1)[1]: r.text for r in object_texts(spark, corpus).collect()}
    assert got == {"a.txt": "one\ntwo", "c.jsonl": "Hello, World! 5 last"}


def test_harvest(spark):
    assert harvest({"b": {"text": "x"}, "text": "y"}) == ["x", "y"]
    with pytest.raises(ValueError):
        harvest({"text": 1})
    df = spark.createDataFrame([("[1]",), (None,), ("{}",)], "l string")
    assert [r[0] for r in df.select(json_texts("l")).collect()] == [None, None, []]


def test_orders(spark):
    df = spark.createDataFrame([("b", 1, 5, False), ("a", 1, 9, False), ("c", None, 7, True)], "path string, size long, mod_time long, dir boolean")
    for spec, wanted in (("size_ascending", "abc"), ("size_desc", "abc"), ("path_descending", "cba"), ("name_asc", "abc")):
        assert "".join(r.path for r in ordering.sort_files(df, spec).collect()) == wanted
    assert ordering.newest(df).first().path == "a" and ordering.newest(df, directories=True).first().path == "c"
    assert ordering.newest(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        ordering.sort_files(df, "color_up")
    assert ordering.up_to_date(df.where("path = 'b'"), df.where("path = 'a'")) and not ordering.up_to_date(df, df.where("false"))


def test_token_files(spark, tmp_path):
    spark.dataSource.register(TokenFiles)
    df = spark.createDataFrame([(k, [k, k + 1, 65535]) for k in range(10)] + [(99, None)], "k long, tokens array<bigint>").coalesce(1)
    df.write.format("token_files").mode("append").save(str(tmp_path / "t"))
    back = spark.read.format("token_files").option("context_size", 4).load(str(tmp_path / "t")).orderBy("context_no").collect()
    assert [t for r in back for t in r.tokens] == [t for k in range(10) for t in (k, k + 1, 65535)]
    assert [len(r.tokens) for r in back] == [4] * 7 + [2]
    df.write.format("token_files").option("wide", "true").mode("overwrite").save(str(tmp_path / "t"))
    assert spark.read.format("token_files").option("wide", "true").load(str(tmp_path / "t")).first().tokens[:2] == [0, 1]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([([70000],)], "tokens array<bigint>").write.format("token_files").mode("append").save(str(tmp_path / "u"))


def test_resources(tmp_path):
    (tmp_path / "encoder.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2, "<s>": 3}))
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\n")
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"add_bos_token": True, "bos_token": {"content": "<s>"}, "added_tokens_decoder": {"9": {"content": "<x>"}}}))
    (tmp_path / "special_tokens_map.json").write_text(json.dumps({"bos_token": {"content": "<s>"}, "eos_token": "<x>"}))
    (tmp_path / "special_config.json").write_text(json.dumps({"split_regex": r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(\S){0}|\s+"}))
    spec = resources.load_folder(str(tmp_path))
    assert spec.encoder()("ab") == [3, 2] and spec.vocab["<x>"] == 9 and spec.specials == ("<s>", "<x>")
    assert resources.shard_count('{"weight_map": {"lm_head.weight": "model-00002-of-00003.bin"}}') == 3
    assert resources.without_look_ahead(r"\s+(?!\S)|\s+|[^\s]") == "[\\t\\n\\f\\r ]+|[^\\t\\n\\f\\r ]"


def test_tokenizer_json(tmp_path):
    whole = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"], "ignore_merges": True}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\p{L}+"}}]}, "added_tokens": [{"content": "<z>", "id": 5}]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(whole))
    spec = resources.load_folder(str(tmp_path))
    assert spec.pattern == r"\p{L}+" and spec.ignore_merges and spec.merges == (("a", "b"),) and spec.vocab["<z>"] == 5
    assert resources.processing_steps(str(tmp_path)) == {"pre_tokenizer": ["Split"]}


def test_missing_files(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "file string, size long")
    held = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9)], "file string, size long")
    assert [r.file for r in resources.missing_files(wanted, held).collect()] == ["b"]


def test_vocabularies(spark, tmp_path):
    pieces = spark.createDataFrame([(0, "<unk>", 2), (1, "<s>", 3), (2, "<0x41>", 6), (3, "▁a", 1), (4, "b", 1), (5, "▁ab", 1), (6, " a", 1), (7, "▁", 1), (8, "a", 1), (9, "ab", 1), (10, None, 1)], "id long, piece string, kind int")
    vocab = vocabularies.pieces_to_vocab(pieces)
    got = {r.token: (r.piece, r.special, r.first_token) for r in vocab.collect()}
    assert got[2] == ("0x41", False, 2) and got[1] == ("<s>", True, 1) and got[6] == (" a", False, 3)
    assert [tuple(r) for r in vocabularies.duplicates(vocab).collect()] == [(6, 3, " a")]
    table = vocabularies.merge_table(vocab.where("token = first_token and not special"))
    assert {(r.left, r.right) for r in table.collect()} == {(" ", "a"), (" a", "b"), (" ", "ab"), ("a", "b")}
    assert [r.left + "+" + r.right for r in vocabularies.merge_entries(table).orderBy("rank").collect()] == [" +a", " +ab", " a+b", "a+b"]
    kept, merges = vocabularies.exclude(vocab.select("piece", "token"), spark.createDataFrame([(0, "a", "b"), (1, " ", "a")], "rank int, left string, right string"), spark.createDataFrame([("ab",)], "piece string"))
    assert kept.count() == 9 and [r.rank for r in merges.collect()] == [1]


def test_convert_piece_model(spark, tmp_path):
    import os

    from textloom.operators.tokenizer import TOKENIZERS

    if not os.path.isfile(f"{TOKENIZERS}/piece_bpe_32k.model"):
        pytest.skip("no public tokenizer files")
    vocabularies.convert_piece_model(spark, f"{TOKENIZERS}/piece_bpe_32k.model", str(tmp_path))
    vocab = json.loads((tmp_path / "vocab.json").read_text())
    assert vocab["0x00"] == 3 and vocab[" the"] > 0 and len(vocab) >= 31_900
    assert (tmp_path / "specials.txt").read_text() == "<s>\n</s>\n"
    assert len(json.loads((tmp_path / "merges.json").read_text())) > 50_000
