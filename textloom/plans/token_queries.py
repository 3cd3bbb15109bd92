"""Queries on encoding, decoding, token files, packing and vocabularies, with the SQL that checks them.

Those that SQL checks use the first 200 merges of gpt2: the same code as for the whole vocabulary, whose
merges SQL can still spell out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import binary, sql
from textloom.functions.text import byte_characters
from textloom.operators import contexts, tokenizer, trimming, vocabularies
from textloom.operators.contexts import PackSpec
from textloom.operators.tokenizer import TOKENIZERS, TokenizerSpec, decode, encode
from textloom.plans.text_queries import SQL_WORDS, quoted, sql_bytes
from textloom.sources.resources import vocab_rows
from textloom.sources.token_files import TokenFiles
from textloom.sources.token_files import token_index as read_index
from textloom.streaming.encoding import encode_stream, pack_stream
from textloom.util import scratch_path, shared_dir, spread, table

#: Merges of the small vocabulary.
MINI_MERGES = 200


@lru_cache(1)
def gpt2() -> TokenizerSpec:
    return tokenizer.gpt2(TOKENIZERS)


@lru_cache(1)
def mini() -> TokenizerSpec:
    return replace(gpt2().first_merges(MINI_MERGES), name="gpt2-mini", cross_word=False)


def vocab_spec(spark: SparkSession, d: str, most: int = 100_000) -> TokenizerSpec:
    """The vocabulary of the table ``vocab``: whole words and bytes, no merges. A vocabulary is bounded."""
    rows = table(spark, d, "vocab").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} pieces")
    return TokenizerSpec("table", {r["piece"]: r["token"] for r in rows}, byte_level=False)


def joined(tokens: str | Column) -> Column:
    """Tokens as text, so that rows compare as plain values."""
    return F.array_join(F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: t.cast("string")), " ")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", "text"))


def _token_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each text with tokens once."""
    return table(spark, d, "token_docs").where("tokens is not null").select("text_id", "path", "tokens").dropDuplicates(["text_id"])


#: Ids of a shard in the queries, so that the number of shards grows with the table.
SHARD_IDS = 500


def _sharded(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).withColumn("shard", F.floor(F.col("text_id") / SHARD_IDS).cast("int"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and gpt2 tokens by language label and source."""
    docs = _docs(spark, d).select("lang", "source", encode("text", gpt2()).alias("t"))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.size("t").cast("bigint")).alias("n_tokens"))


def encode_gpt2(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", joined(encode("text", gpt2())).alias("tokens"))


def encode_mini(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", joined(encode("text", mini())).alias("tokens"))


def encode_mini_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_by_dictionary(_docs(spark, d), mini()).select("doc_id", joined("tokens").alias("tokens"))


def encode_enclosed(spark: SparkSession, d: str) -> DataFrame:
    spec = replace(mini(), add_bos=True, add_eos=True)
    return _docs(spark, d).select("doc_id", joined(encode("text", spec)).alias("tokens"))


def encode_specials(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<|endoftext|>"), F.replace("text", F.lit("\n"), F.lit("<|padding|>")), F.lit("<|endoftext|>"))
    return _docs(spark, d).select("doc_id", joined(encode(text, mini())).alias("tokens"))


#: Pairs of the small vocabulary for merges over the borders of words: a full stop, a space and a capital T.
CROSS_WORD = ((".", "Ġ"), (".Ġ", "T"))


def encode_cross_word(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that merge over the borders of words."""
    vocab, merges = tokenizer.byte_level_vocab(CROSS_WORD)
    spec = TokenizerSpec("cross-word", vocab, merges)
    return _docs(spark, d).select("doc_id", joined(encode("text", spec)).alias("tokens"))


#: Whole words of a vocabulary that ignores merges, with their ids.
WHOLE_WORDS = {"Ġordered": 90_001, "Ġbattery": 90_002, "Delivery": 90_003, "Ġeuros": 90_004}


def encode_whole_words(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a vocabulary that takes whole words first and merges only the others."""
    spec = replace(mini(), vocab={**mini().vocab, **WHOLE_WORDS}, ignore_merges=True)
    return _docs(spark, d).select("doc_id", joined(encode("text", spec)).alias("tokens"))


def encode_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Encoded texts as little-endian buffers of 32 bits, with their number of tokens."""
    held = _docs(spark, d).select("doc_id", encode("text", mini()).alias("t"))
    return held.select("doc_id", F.hex(binary.to_binary("t", wide=True)).alias("buffer"), F.size("t").cast("bigint").alias("n"))


def token_count_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("lang", "source", F.size(encode("text", mini())).cast("bigint").alias("n"))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(encode("text", mini())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_counts_sql(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, mini(), "mini")
    _docs(spark, d).createOrReplaceTempView("textloom_documents")
    return spark.sql("select doc_id, mini_count(text) as n_tokens from textloom_documents")


def explode_sql(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, mini(), "mini")
    _docs(spark, d).createOrReplaceTempView("textloom_documents")
    return spark.sql("select doc_id, pos, token from textloom_documents, lateral mini_explode(text)")


def decode_lines(spark: SparkSession, d: str) -> DataFrame:
    """The encoded lines, decoded with the table's vocabulary."""
    lines = table(spark, d, "encode_lines").where("encoded is not null and text is not null").select("line_id", "encoded").distinct()
    return lines.select("line_id", decode("encoded", vocab_spec(spark, d)).alias("text"))


def decode_token_docs(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).select("text_id", decode("tokens", vocab_spec(spark, d)).alias("text"))


def roundtrip_gpt2(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", decode(encode("text", gpt2()), gpt2()).alias("text"))


def retokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the table's vocabulary as tokens of the small one."""
    out = contexts.retokenize(_token_docs(spark, d), vocab_spec(spark, d), mini())
    return out.select("text_id", joined("tokens").alias("tokens"))


def retokenize_padded(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the small vocabulary, 200 at most that end on a character's border, padded."""
    out = contexts.retokenize(_token_docs(spark, d), vocab_spec(spark, d), mini(), size=200, trim=True)
    return out.select("text_id", joined("tokens").alias("tokens"))


def tokens_ready(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first hundred tokens of a text end on a character's border, and their number up to the last border."""
    held = _docs(spark, d).select("doc_id", F.slice(encode("text", mini()), 1, 100).alias("t"))
    return held.select("doc_id", tokenizer.tokens_ready("t", mini()).alias("ready"), F.size(tokenizer.trim_tokens("t", mini())).alias("n"))


def token_debts(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.debts_frame(spark, vocab_spec(spark, d))


def lookup_words(spark: SparkSession, d: str) -> DataFrame:
    """Ids of whole words, null for those that are no piece."""
    words = _docs(spark, d).select(F.explode(F.split("text", " ")).alias("piece")).distinct()
    return words.select("piece", tokenizer.lookup(F.array("piece"), vocab_spec(spark, d))[0].alias("token"))


def show_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).select("text_id", tokenizer.show_pieces("tokens", vocab_spec(spark, d)).alias("pieces"))


def exclude_tokens(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "vocab").where("length(piece) = 3").select("piece")
    merges = mini().merges_frame(spark)
    kept, left = vocabularies.exclude(table(spark, d, "vocab"), merges, gone)
    return kept.select("piece", "token").unionByName(left.select(F.concat("left", "right").alias("piece"), (-F.col("rank") - 1).cast("bigint").alias("token")))


def merge_table(spark: SparkSession, d: str) -> DataFrame:
    return vocabularies.merge_table(table(spark, d, "vocab"))


def merge_entries(spark: SparkSession, d: str) -> DataFrame:
    return vocabularies.merge_entries(vocabularies.merge_table(table(spark, d, "vocab"))).select("rank", "left", "right", "merged_token")


def id_merges(spark: SparkSession, d: str) -> DataFrame:
    return vocabularies.id_merges(mini().vocab_frame(spark), mini().merges_frame(spark))


def convert_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of a public piece model as a vocabulary."""
    return vocabularies.pieces_to_vocab(vocabularies.read_piece_model(spark, f"{TOKENIZERS}/piece_bpe_32k.model"))


def tokens_u16(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).select("text_id", binary.to_hex("tokens").alias("hex"))


def tokens_u32(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).select("text_id", binary.to_hex("tokens", wide=True).alias("hex"))


def tokens_from_binary(spark: SparkSession, d: str) -> DataFrame:
    held = _token_docs(spark, d).select("text_id", binary.to_binary("tokens").alias("b"))
    return held.select("text_id", joined(binary.from_binary("b")).alias("tokens"))


def decode_binary(spark: SparkSession, d: str) -> DataFrame:
    """Text of tokens stored in 32 bits each."""
    held = _token_docs(spark, d).select("text_id", binary.to_binary("tokens", wide=True).alias("b"))
    return held.select("text_id", decode(binary.from_binary("b", wide=True), vocab_spec(spark, d)).alias("text"))


def vocab_file(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary written as JSON and read again."""
    written = spark.createDataFrame([(vocabularies.vocab_json(table(spark, d, "vocab")),)], "value string")
    return written.select(F.explode(vocab_rows()).alias("e")).select(F.col("e.key").alias("piece"), F.col("e.value").alias("token"))


def _written(spark: SparkSession, contexts_: DataFrame) -> str:
    spark.dataSource.register(TokenFiles)
    folder = scratch_path(spark, "tokens")
    contexts_.write.format("token_files").mode("append").save(folder)
    return folder


def token_files(spark: SparkSession, d: str) -> DataFrame:
    """Contexts written to token files, one per shard, and read again in the order in which they stand there."""
    folder = _written(spark, _fixed(spark, d).select("shard", "context_no", "tokens"))
    back = spark.read.format("token_files").option("context_size", 512).load(folder)
    return back.select(F.regexp_extract("path", r"shard-(\d+)-", 1).cast("int").alias("shard"), "context_no", joined("tokens").alias("tokens"))


def token_index(spark: SparkSession, d: str) -> DataFrame:
    """Sampled contexts in token files, looked up by the offsets of the index."""
    folder = _written(spark, contexts.sample_contexts(_fixed(spark, d), 80).select("shard", "context_no", "tokens"))
    index = read_index(spark, folder).withColumnRenamed("tokens", "n_tokens")
    back = spark.read.format("token_files").option("context_size", 512).load(folder).select(F.substring_index("path", "/", -1).alias("file"), (F.col("context_no") * 1024).alias("offset"), "tokens")
    return index.join(back, ["file", "offset"]).select(F.col("shard").cast("int").alias("shard"), "context_no", "n_tokens", joined("tokens").alias("tokens"))


def document_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each document begins: its context, and the place in it."""
    docs = _sharded(spark, d)
    places = contexts.document_places(contexts.document_index(docs, ["text_id"], path="text_id"), _fixed(spark, d))
    return places.select("shard", F.col("path").cast("bigint").alias("text_id"), "offset", "tokens", "context_no", "at")


def document_index(spark: SparkSession, d: str) -> DataFrame:
    return contexts.document_index(_sharded(spark, d), ["text_id"])


def pack_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 512 tokens without a boundary."""
    packed = contexts.pack_contexts(_sharded(spark, d), vocab_spec(spark, d), PackSpec(512, None, unitrim=False, pad="<|padding|>"), ["text_id"])
    return packed.select("shard", "context_no", "n_pad", joined("tokens").alias("tokens"))


def pack_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 512 tokens that break after sentences."""
    packed = contexts.pack_contexts(_sharded(spark, d), vocab_spec(spark, d), PackSpec(512, ".", unitrim=False, pad="<|padding|>"), ["text_id"])
    return packed.select("shard", "context_no", "n_pad", joined("tokens").alias("tokens"))


def _packed(spark: SparkSession, d: str, pack: PackSpec) -> DataFrame:
    packed = contexts.pack_contexts(_sharded(spark, d), vocab_spec(spark, d), pack, ["text_id"])
    return packed.select("shard", "context_no", "start", "n_pad", joined("tokens").alias("tokens"))


def pack_begin(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 512 tokens that break before full stops."""
    return _packed(spark, d, PackSpec(512, ".", True, unitrim=False, pad="<|padding|>"))


def pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 512 tokens, the next of which begins after the sentence end nearest to 400 tokens."""
    return _packed(spark, d, PackSpec(512, ".", boundary_overlap=400, unitrim=False, pad="<|padding|>"))


def pack_steps(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 512 tokens that begin every 300."""
    return _packed(spark, d, PackSpec(512, None, boundary_overlap=300, unitrim=False, pad="<|padding|>"))


def pack_documents_gpt2(spark: SparkSession, d: str) -> DataFrame:
    """From text to contexts: tokens, end of text, lines kept whole, characters kept whole."""
    docs = contexts.with_shards(_docs(spark, d).select("doc_id", "text"))
    tokens = contexts.tokenize_docs(docs, gpt2(), PackSpec(1024))
    packed = contexts.pack_contexts(tokens, gpt2(), PackSpec(1024), ["doc_id"])
    return packed.select("shard", "context_no", "n_pad", joined("tokens").alias("tokens"))


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return contexts.pack_contexts(_sharded(spark, d), vocab_spec(spark, d), PackSpec(512, None, unitrim=False, pad="<|padding|>"), ["text_id"])


def context_index(spark: SparkSession, d: str) -> DataFrame:
    return contexts.context_index(_fixed(spark, d)).select("shard", "context_no", "offset", "tokens")


def sample_80(spark: SparkSession, d: str) -> DataFrame:
    return contexts.sample_contexts(_fixed(spark, d), 80).select("shard", "context_no")


def sample_50(spark: SparkSession, d: str) -> DataFrame:
    return contexts.sample_contexts(_fixed(spark, d), 50).select("shard", "context_no")


def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return contexts.shuffle_contexts(_fixed(spark, d), 11).select("shard", "context_no")


def pad_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _token_docs(spark, d).select("text_id", joined(contexts.pad_to("tokens", 300, 1)).alias("tokens"))


def boundary_tokens(spark: SparkSession, d: str) -> DataFrame:
    dot = vocab_spec(spark, d).single_token(".")
    return _token_docs(spark, d).select("text_id", F.explode(contexts.boundary_positions("tokens", dot).cast("array<bigint>")).alias("at"))


def _trimmed(function: Callable, *args, spec: Callable[[], TokenizerSpec] = gpt2) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        held = _docs(spark, d).select("doc_id", encode("text", spec()).alias("t"))
        return held.select("doc_id", decode(function("t", spec(), *args), spec()).alias("text"))

    return run


def streaming_encode(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream, encoded and written until none is left."""
    schema = table(spark, d, "documents").schema
    shared_dir(spark)
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet" if not _is_folder(spark, f"{d}/documents.parquet") else "*.parquet").parquet(d if not _is_folder(spark, f"{d}/documents.parquet") else f"{d}/documents.parquet")
    encoded = encode_stream(stream.where("text is not null").select("doc_id", "text"), mini()).select("doc_id", "tokens")
    query = encoded.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("doc_id bigint, tokens array<bigint>").parquet(out).select("doc_id", joined("tokens").alias("tokens"))


def streaming_pack(spark: SparkSession, d: str) -> DataFrame:
    """The texts as a stream, packed into contexts of 512 tokens as they come."""
    source, out, state = (scratch_path(spark, x) for x in ("pack-source", "pack-out", "pack-state"))
    docs = _sharded(spark, d).select("shard", F.col("text_id").alias("doc_id"), "tokens")
    # A row without tokens ends its shard's stream.
    ends = docs.groupBy("shard").agg((F.max("doc_id") + 1).alias("doc_id")).select("shard", "doc_id", F.lit(None).cast("array<bigint>").alias("tokens"))
    docs.unionByName(ends).write.parquet(source)
    stream = spark.readStream.schema("shard int, doc_id bigint, tokens array<bigint>").parquet(source)
    packed = pack_stream(stream, vocab_spec(spark, d), PackSpec(512, None, unitrim=False, pad="<|padding|>"))
    packed.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("shard int, context_no bigint, tokens array<bigint>, n_pad int").parquet(out).select("shard", "context_no", "n_pad", joined("tokens").alias("tokens"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {f.__name__: f for f in (encode_gpt2, encode_mini, encode_mini_dictionary, encode_enclosed, encode_specials, encode_cross_word, encode_whole_words, encode_buffer, token_count_by_lang, token_histogram, token_counts_sql, explode_sql, decode_lines, decode_token_docs, roundtrip_gpt2, retokenize_docs, retokenize_padded, tokens_ready, token_debts, lookup_words, show_pieces, exclude_tokens, merge_table, merge_entries, id_merges, convert_pieces, tokens_u16, tokens_u32, tokens_from_binary, decode_binary, vocab_file, token_files, token_index, document_index, document_places, pack_fixed, pack_boundary, pack_begin, pack_overlap, pack_steps, pack_documents_gpt2, context_index, sample_80, sample_50, shuffle, pad_tokens, boundary_tokens, streaming_encode, streaming_pack)} | {
    "trim_newlines_top": _trimmed(trimming.trim_newlines, "top", 150, spec=mini),
    "trim_newlines_bottom": _trimmed(trimming.trim_newlines, "bottom", 150, spec=mini),
    "trim_sentences_top": _trimmed(trimming.trim_sentences, "top", 40),
    "trim_sentences_bottom": _trimmed(trimming.trim_sentences, "bottom", 40),
    "trim_incomplete_sentence": _trimmed(trimming.trim_incomplete_sentence),
    "align_and_size": _trimmed(trimming.align_and_size, 50),
}


def sql_queries() -> dict[str, str]:
    """SQL for the queries above; the small vocabulary is spelt out, so this needs the tokenizer files."""
    spec = mini()
    letters = lambda p: "".join(p)
    bracketed = f"'⟨' || array_to_string({sql_bytes('w')}, '⟩⟨') || '⟩'"
    for a, b in spec.merges:
        bracketed = f"replace({bracketed}, {quoted(f'⟨{a}⟩⟨{b}⟩')}, {quoted(f'⟨{letters(a + b)}⟩')})"
    ids = "map {" + ", ".join(f"{quoted(p)}: {i}" for p, i in spec.vocab.items()) + "}"
    # Each different word is merged once.
    encoded = f"""
        vocab_map as materialized (select {ids} as m),
        dw as materialized (select distinct unnest({SQL_WORDS}) as w from documents where text is not null),
        enc as materialized (select w, list_transform(string_split(substr(b, 2, length(b) - 2), '⟩⟨'), lambda p: m[p]) as t from (select w, {bracketed} as b from dw), vocab_map),
        word as (select doc_id, unnest({SQL_WORDS}) as w, generate_subscripts({SQL_WORDS}, 1) as k from documents where text is not null),
        tok as materialized (select doc_id, flatten(list(t order by k)) as t from word join enc using (w) group by doc_id),
        doc as (select d.doc_id, d.lang, d.source, coalesce(tok.t, []) as t from documents d left join tok using (doc_id) where d.text is not null)"""
    mini_tokens = f"with {encoded} select doc_id, array_to_string(t, ' ') as tokens from doc"
    eot = spec.vocab["<|endoftext|>"]
    special = {"<|endoftext|>": eot, "<|padding|>": spec.vocab["<|padding|>"]}
    parts = "regexp_split_to_array('<|endoftext|>' || replace(text, chr(10), '<|padding|>') || '<|endoftext|>', '<\\|endoftext\\|>|<\\|padding\\|>')"
    # The continuation bytes of the byte alphabet: a border lies where the next piece does not begin with one.
    inner = "[" + ", ".join(str(i) for p, i in spec.vocab.items() if p[0] in byte_characters()[0x80:0xC0]) + "]"
    border = lambda t, n: f"list_max(list_filter(range(0, least(len({t}), {n}) + 1), lambda k: k = 0 or k = len({t}) or not list_contains({inner}, {t}[k + 1])))"
    texts = "(select distinct text_id, path, tokens from token_docs where tokens is not null)"
    cross_vocab, _ = tokenizer.byte_level_vocab(CROSS_WORD)
    cross = f"'⟨' || array_to_string({sql_bytes('text')}, '⟩⟨') || '⟩'"
    for a, b in CROSS_WORD:
        cross = f"replace({cross}, {quoted(f'⟨{a}⟩⟨{b}⟩')}, {quoted(f'⟨{a + b}⟩')})"
    cross_ids = "map {" + ", ".join(f"{quoted(p)}: {i}" for p, i in cross_vocab.items()) + "}"
    whole = "map {" + ", ".join(f"{quoted(p)}: {i}" for p, i in WHOLE_WORDS.items()) + "}"
    whole_words = encoded.replace("enc as materialized (", f"plain as materialized (").replace("word as (", f"enc as materialized (select w, case when ({whole})[array_to_string({sql_bytes('w')}, '')] is not null then [({whole})[array_to_string({sql_bytes('w')}, '')]] else t end as t from plain), word as (", 1)
    from_texts = encoded.replace("documents", "src").replace("doc_id", "text_id").replace("d.lang, d.source, ", "")
    # Texts without their special tokens, each part one text of its own.
    in_parts = encoded.replace("documents", "src").replace("doc_id", "part_id").replace("d.lang, d.source, ", "")
    stream = f"""
        flat as (select (text_id // {SHARD_IDS})::int as shard, text_id, unnest(tokens) as t, generate_subscripts(tokens, 1) as k from {texts}),
        numbered as (select shard, t, row_number() over (partition by shard order by text_id, k) - 1 as pos from flat)"""
    fixed = f"with {stream}, pad as (select min(token) as p from vocab where piece = '<|padding|>') select shard, pos // 512 as context_no, (512 - count(*))::int as n_pad, string_agg(t, ' ' order by pos) || repeat(' ' || any_value(p), (512 - count(*))::int) as tokens from numbered, pad group by shard, pos // 512"
    grid = f"with {stream} select shard, pos // 512 as context_no, min(pos) as first from numbered group by all"
    pieces = r"(select piece, min(token) as token from vocab where piece is not null and piece <> '' group by piece)"
    table_sql = f"""
        with v as {pieces}, c as (select piece as merged, token as merged_token, unnest(range(1, length(piece))) as k from v where length(piece) > 1)
        select l.piece as "left", r.piece as "right", c.merged, l.token as left_token, r.token as right_token, c.merged_token
        from c join v l on l.piece = substr(c.merged, 1, c.k) join v r on r.piece = substr(c.merged, c.k + 1)"""
    merges = "(values " + ", ".join(f"({k}, {quoted(a)}, {quoted(b)})" for k, (a, b) in enumerate(spec.merges)) + ') as m(rank, "left", "right")'
    vocab_values = "(values " + ", ".join(f"({quoted(p)}, {i}::bigint)" for p, i in spec.vocab.items()) + ") as v(piece, token)"
    gone = "(select piece from vocab where length(piece) = 3)"
    swap4 = "lambda t: substr(printf('%04x', t), 3, 2) || substr(printf('%04x', t), 1, 2)"
    swap8 = "lambda t: substr(printf('%08x', t), 7, 2) || substr(printf('%08x', t), 5, 2) || substr(printf('%08x', t), 3, 2) || substr(printf('%08x', t), 1, 2)"
    def recurrence(following: str) -> str:
        """Contexts of 512 tokens of which the next begins where ``following`` says, by the boundaries b and the beginning start."""
        return f"""
            with recursive dot as (select min(token) as d from vocab where piece = '.'), pad as (select min(token) as p from vocab where piece = '<|padding|>'),
            s as (select (text_id // {SHARD_IDS})::int as shard, flatten(list(tokens order by text_id)) as t from {texts} group by all),
            stream as (select shard, t, len(t) as n, list_filter(range(0, len(t)), lambda k: t[k + 1] = dot.d) as b from s, dot),
            r(shard, context_no, start) as (select shard, 0::bigint, 0::bigint from stream where n > 0 union all
                select r.shard, context_no + 1, {following} from r join stream using (shard) where n - start > 512)
            select shard, context_no, start, (512 - len(c))::int as n_pad, array_to_string(list_resize(c, 512, p), ' ') as tokens
            from (select shard, context_no, start, list_slice(t, start + 1, start + 512) as c from r join stream using (shard)), pad"""

    def trimmed(line: str, order: str) -> str:
        """Whole lines, spelt as ``line``, of at most 150 tokens together."""
        own = re.sub(r"\b(vocab_map|dw|enc|word|tok|doc)\b", r"\1_l", in_parts)
        return f"""
            with cut as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
            src as (select doc_id * 100000 + k as part_id, doc_id, k, {line} as text from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as k from cut)),
            {own}, {encoded},
            summed as (select src.doc_id, k, text, sum(len(t)) over (partition by src.doc_id order by k {order}) as n from src join doc_l using (part_id)),
            kept as (select doc_id, string_agg(text, '' order by k) filter (n <= 150) as part from summed group by doc_id)
            select d.doc_id, case when len(doc.t) <= 150 then d.text else coalesce(part, '') end as text
            from documents d join doc using (doc_id) join kept using (doc_id) where d.text is not null"""

    inside = "list_filter(b, lambda x: x > start and x < start + 512)"
    nearest = f"list_min(list_transform({inside}, lambda x: abs(x - start - 400) * 100000000000 + x)) % 100000000000"
    return {
        "encode_mini": mini_tokens,
        "trim_newlines_top": trimmed("chr(10) || line", "desc"),
        "trim_newlines_bottom": trimmed("line || chr(10)", "asc"),
        "encode_specials": f"""
            with cut as (select doc_id, {parts} as parts, text from documents where text is not null),
            src as (select doc_id * 100000 + k as part_id, doc_id, k, len(parts) as n, text from (select doc_id, parts, unnest(parts) as text, generate_subscripts(parts, 1) as k from cut)),
            {in_parts}
            select doc_id, array_to_string(list_filter(flatten(list(list_concat(t, case when k = n then [] when k = 1 or k = n - 1 then [{eot}] else [{special['<|padding|>']}] end) order by k)), lambda x: x is not null), ' ') as tokens
            from src join doc using (part_id) group by doc_id""",
        "encode_cross_word": f"with ids as (select {cross_ids} as m) select doc_id, case when text = '' then '' else array_to_string(list_transform(string_split(substr(b, 2, length(b) - 2), '⟩⟨'), lambda p: m[p]), ' ') end as tokens from (select doc_id, text, {cross} as b from documents where text is not null), ids",
        "encode_whole_words": f"with {whole_words} select doc_id, array_to_string(t, ' ') as tokens from doc",
        "tokens_ready": f"with {encoded}, cutoff as (select doc_id, t, least(len(t), 100) as n100, {border('t', 100)} as n from doc) select doc_id, n = n100 as ready, n::int as n from cutoff",
        "retokenize_padded": f"with src as (select distinct text_id, text from token_docs where tokens is not null), {from_texts} select text_id, array_to_string(list_resize(list_slice(t, 1, {border('t', 200)}), 200, {spec.pad_token}), ' ') as tokens from doc",
        "decode_binary": "select distinct text_id, text from token_docs where tokens is not null",
        "vocab_file": "select piece, token from vocab",
        "token_index": f"with fixed as ({fixed}) select shard, context_no, 512::bigint as n_tokens, tokens from fixed where context_no % 5 < 4",
        "document_places": f'with i as (select (text_id // {SHARD_IDS})::int as shard, text_id, (coalesce(sum(len(tokens)) over (partition by text_id // {SHARD_IDS} order by text_id rows between unbounded preceding and 1 preceding), 0))::bigint as "offset", len(tokens) as tokens from {texts}), n as (select shard, max("offset" + tokens) as total from i group by shard) select shard, text_id, "offset", tokens, least("offset" // 512, (total - 1) // 512) as context_no, "offset" - 512 * least("offset" // 512, (total - 1) // 512) as at from i join n using (shard)',
        "pack_begin": recurrence(f"coalesce(list_max({inside}), start + 512)"),
        "pack_overlap": recurrence(f"coalesce({nearest} + 1, start + 512)"),
        "pack_steps": recurrence("start + 300"),
        "streaming_pack": fixed,
        "streaming_encode": mini_tokens,
        "encode_mini_dictionary": f"with {encoded} select doc_id, array_to_string(t, ' ') as tokens from doc where len(t) > 0",
        "encode_enclosed": f"with {encoded} select doc_id, array_to_string(list_concat([{eot}], t, [{eot}]), ' ') as tokens from doc",
        "encode_buffer": f"with {encoded} select doc_id, upper(array_to_string(list_transform(t, {swap8}), '')) as buffer, len(t) as n from doc",
        "token_count_by_lang": f"with {encoded} select lang, source, count(*) as n_docs, sum(len(t))::bigint as n_tokens from doc group by lang, source",
        "token_histogram": f"with {encoded} select token::bigint as token, count(*) as n from (select unnest(t) as token from doc) group by token",
        "token_counts_sql": f"with {encoded} select doc_id, len(t) as n_tokens from doc",
        "explode_sql": f"with {encoded} select doc_id, (generate_subscripts(t, 1) - 1)::int as pos, unnest(t)::bigint as token from doc",
        "decode_lines": "select distinct line_id, text from encode_lines where encoded is not null and text is not null",
        "decode_token_docs": "select distinct text_id, text from token_docs where tokens is not null",
        "roundtrip_gpt2": "select doc_id, text from documents where text is not null",
        "retokenize_docs": f"with {encoded.replace('documents', 'src').replace('doc_id', 'text_id').replace('d.lang, d.source, ', '')} select text_id, array_to_string(t, ' ') as tokens from doc".replace("with ", "with src as (select distinct text_id, text from token_docs where tokens is not null), ", 1),
        "token_debts": r"select token, case when regexp_full_match(piece, '0x[89ab][0-9a-f]') then -1 when regexp_full_match(piece, '0x[cd][0-9a-f]') then 1 when regexp_full_match(piece, '0xe[0-9a-f]') then 2 when regexp_full_match(piece, '0xf[0-9a-f]') then 3 else 0 end as debt from vocab",
        "lookup_words": "select w.piece, v.token from (select distinct unnest(string_split(text, ' ')) as piece from documents where text is not null) w left join vocab v on v.piece = w.piece",
        "show_pieces": f"select text_id, string_agg(piece, '|' order by k) as pieces from (select text_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as k from {texts}) join vocab using (token) group by text_id",
        "exclude_tokens": f'select piece, token from vocab where piece not in {gone} union all select "left" || "right", -rank - 1 from {merges} where "left" not in {gone} and "right" not in {gone} and "left" || "right" not in {gone}',
        "merge_table": table_sql,
        "merge_entries": f'select (row_number() over (order by merged_token, "left", "right") - 1)::int as rank, "left", "right", merged_token from ({table_sql})',
        "id_merges": f'with v as (select * from {vocab_values}) select a.token as left_token, b.token as right_token, c.token as merged_token from {merges} join v a on a.piece = "left" join v b on b.piece = "right" join v c on c.piece = "left" || "right"',
        "tokens_u16": f"select text_id, upper(array_to_string(list_transform(tokens, {swap4}), '')) as hex from {texts}",
        "tokens_u32": f"select text_id, upper(array_to_string(list_transform(tokens, {swap8}), '')) as hex from {texts}",
        "tokens_from_binary": f"select text_id, array_to_string(tokens, ' ') as tokens from {texts}",
        "token_files": f"select shard, context_no, tokens from ({fixed})",
        "document_index": f'select (text_id // {SHARD_IDS})::int as shard, path, (coalesce(sum(len(tokens)) over (partition by text_id // {SHARD_IDS} order by text_id rows between unbounded preceding and 1 preceding), 0))::bigint as "offset", len(tokens) as tokens from {texts}',
        "pack_fixed": fixed,
        "pack_boundary": f"""
            with recursive dot as (select min(token) as d from vocab where piece = '.'), pad as (select min(token) as p from vocab where piece = '<|padding|>'),
            s as (select (text_id // {SHARD_IDS})::int as shard, flatten(list(tokens order by text_id)) as t from {texts} group by all),
            stream as (select shard, t, len(t) as n, list_filter(range(0, len(t)), lambda k: t[k + 1] = dot.d) as b from s, dot),
            r(shard, context_no, start) as (select shard, 0::bigint, 0::bigint from stream union all
                select r.shard, context_no + 1, coalesce(list_max(list_filter(b, lambda x: x > start and x < start + 512)) + 1, start + 512) from r join stream using (shard) where n - start > 512)
            select shard, context_no, (512 - len(c))::int as n_pad, array_to_string(list_resize(c, 512, p), ' ') as tokens
            from (select shard, context_no, list_slice(t, start + 1, start + 512) as c from r join stream using (shard)), pad""",
        "context_index": f'select shard, context_no, context_no * 512 as "offset", 512::bigint as tokens from ({grid})',
        "sample_80": f"select shard, context_no from ({grid}) where context_no % 5 < 4",
        "sample_50": f"select shard, context_no from ({grid}) where context_no % 2 < 1",
        "shuffle": f"select shard, context_no from ({grid})",
        "pad_tokens": f"select text_id, array_to_string(list_resize(list_slice(tokens, 1, 300), 300, 1), ' ') as tokens from {texts}",
        "boundary_tokens": f"select text_id, k - 1 as at from (select text_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as k from {texts}) where token = (select min(token) from vocab where piece = '.')",
    }
