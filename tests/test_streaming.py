from textloom.operators.contexts import PackSpec
from textloom.operators.tokenizer import TokenizerSpec, byte_level_vocab
from textloom.streaming.encoding import encode_stream, pack_stream, text_stream

VOCAB, MERGES = byte_level_vocab([("a", "b")], after=("<|endoftext|>", "<pad>"))
SPEC = TokenizerSpec("x", VOCAB, MERGES, specials=("<|endoftext|>", "<pad>"))


def test_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab c")
    q = encode_stream(text_stream(spark, str(tmp_path / "in")), SPEC).writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select tokens from encoded").first()[0] == SPEC.encoder()("ab c")


def test_pack_stream_keeps_unfinished_tokens(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "shard int, doc_id long, tokens array<bigint>"
    spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4, 5]), (1, 1, [7])], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        packed = pack_stream(stream, SPEC, PackSpec(4, None, unitrim=False))
        packed.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    run()
    assert [tuple(r.tokens) for r in spark.read.parquet(out).collect()] == [(1, 2, 3, 4)]
    spark.createDataFrame([(0, 3, [6, 7, 8, 9]), (1, 9, None)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.shard, r.context_no, tuple(r.tokens)) for r in spark.read.parquet(out).collect()) == [(0, 0, (1, 2, 3, 4)), (0, 1, (5, 6, 7, 8)), (1, 0, (7, VOCAB['<pad>'], VOCAB['<pad>'], VOCAB['<pad>']))]


def test_stream_packs_as_a_batch_does(spark, tmp_path):
    """With contexts that end on a character's border, where the tokens of one are cut apart."""
    from textloom.operators.contexts import pack_contexts

    text = ["aé", "日本語 ab", "", "🙂🙂🙂", "b" * 9 + "é"]
    rows = [(k % 2, k, SPEC.encoder()(t)) for k, t in enumerate(text * 3)]
    schema = "shard int, doc_id long, tokens array<bigint>"
    docs = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "src")
    spark.createDataFrame([*rows, (0, 99, None), (1, 99, None)], schema).coalesce(1).write.parquet(src)
    pack = PackSpec(5, "b")
    columns = ["shard", "context_no", "tokens", "n_pad"]
    q = pack_stream(spark.readStream.schema(schema).parquet(src), SPEC, pack).writeStream.format("memory").queryName("packed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("packed").select(*columns).collect())) == sorted(map(tuple, pack_contexts(docs, SPEC, pack, ["doc_id"]).select(*columns).collect()))
