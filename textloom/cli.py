"""Command line: tokenize a corpus into token files, decode or retokenize token files, convert piece models, and a small REPL."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators import contexts, ordering, tokenizer, vocabularies
from textloom.operators.contexts import PackSpec
from textloom.operators.tokenizer import TOKENIZERS, TokenizerSpec
from textloom.sources.resources import load_folder
from textloom.sources.texts import list_texts, read_texts
from textloom.sources.token_files import COMMITTED, TokenFiles, decode_files, token_index
from textloom.functions.text import repair_garbled
from textloom.util import materialize


def load_tokenizer(name: str, tokenizers: str = TOKENIZERS) -> TokenizerSpec:
    """``gpt2`` from the folder of public tokenizer files, or the tokenizer of a local folder."""
    return tokenizer.gpt2(tokenizers) if name == "gpt2" else load_folder(name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tokenize", help="pack the texts under a folder into token files")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--tokenizer", default="gpt2")
    t.add_argument("--tokenizers", default=TOKENIZERS, help="folder of public tokenizer files")
    t.add_argument("--context", type=int, default=2048)
    t.add_argument("--boundary", default="\\n", help="boundary token; empty for none")
    t.add_argument("--boundary-begin", action="store_true")
    t.add_argument("--overlap", type=int, default=-1)
    t.add_argument("--eot", default="<|endoftext|>")
    t.add_argument("--pad", default=None)
    t.add_argument("--no-unitrim", action="store_true")
    t.add_argument("--sampling", type=int, default=100)
    t.add_argument("--shuffle", type=int, default=None, metavar="SEED")
    t.add_argument("--reorder", default="none", help="none, shuffle, or size, path or name with _ascending or _descending")
    t.add_argument("--sanitize", action="store_true")
    t.add_argument("--repair-encoding", action="store_true")
    t.add_argument("--exclude", default="", help="pieces to leave out, separated by commas")
    t.add_argument("--uint32", action="store_true")
    t.add_argument("--shards", type=int, default=None)
    t.add_argument("--retokenize", action="store_true", help="even if the output is newer than every input")
    d = sub.add_parser("decode", help="text of token files")
    r = sub.add_parser("retokenize", help="token files of one vocabulary as those of another")
    for x in (d, r):
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--tokenizer", default="gpt2")
        x.add_argument("--tokenizers", default=TOKENIZERS)
        x.add_argument("--context", type=int, default=2048)
        x.add_argument("--uint32", action="store_true")
    r.add_argument("--to", required=True)
    r.add_argument("--to-uint32", action="store_true")
    r.add_argument("--unitrim", action="store_true")
    c = sub.add_parser("convert", help="vocabulary files of a piece model")
    c.add_argument("--model", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--verbose-merges", action="store_true")
    i = sub.add_parser("repl", help="tokens of the lines of standard input")
    i.add_argument("--tokenizer", default="gpt2")
    i.add_argument("--tokenizers", default=TOKENIZERS)
    return p


def tokenize(spark: SparkSession, a: argparse.Namespace) -> int:
    """Returns the number of tokens written; 0 if the output is newer than all inputs."""
    spark.dataSource.register(TokenFiles)
    if not a.retokenize and _is_written(spark, a.output) and ordering.up_to_date(list_texts(spark, a.input), list_texts(spark, a.output, (".tokens",))):
        return 0
    spec = load_tokenizer(a.tokenizer, a.tokenizers)
    if a.exclude:
        spec = spec.without(a.exclude.split(","))
    pack = PackSpec(a.context, a.boundary or None, a.boundary_begin, a.overlap, not a.no_unitrim, a.eot, a.pad)
    docs = read_texts(spark, a.input, a.sanitize, a.reorder)
    if a.repair_encoding:
        docs = docs.withColumn("text", repair_garbled("text"))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(a.shards)).cast("int")) if a.shards else contexts.with_shards(docs, "path")
    order = ["rank", "line_no", "path"]
    # Encoded once, for the index of documents and the contexts.
    tokens = materialize(contexts.tokenize_docs(docs, spec, pack).select("shard", *order, "tokens"), "tokens")
    packed = contexts.pack_contexts(tokens, spec, pack, order)
    held = contexts.sample_contexts(packed, a.sampling)
    if a.shuffle is not None:
        held = contexts.shuffle_contexts(held, a.shuffle).withColumnRenamed("shard", "of_shard")
    held, seen = contexts.packing_metrics(held)
    held.write.format("token_files").option("wide", str(a.uint32 or spec.wide).lower()).mode("overwrite").save(a.output)
    contexts.document_index(tokens, order).write.mode("overwrite").json(f"{a.output}.docs")
    token_index(spark, a.output).write.mode("overwrite").json(f"{a.output}.contexts")
    print(json.dumps(seen.get))
    return seen.get["tokens"] or 0


def _is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a committed job's token files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMITTED}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "repl":
        encoder = load_tokenizer(a.tokenizer, a.tokenizers).encoder()
        back = {i: p for p, i in encoder.spec.vocab.items()}
        for line in sys.stdin:
            tokens = encoder(line.rstrip("\n").replace("\\n", "\n"))
            print(tokens, "|".join(back[t] for t in tokens))
        return 0
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if a.command == "tokenize":
        tokenize(spark, a)
    elif a.command == "convert":
        vocabularies.convert_piece_model(spark, a.model, a.output, a.verbose_merges)
    else:
        spark.dataSource.register(TokenFiles)
        spec = load_tokenizer(a.tokenizer, a.tokenizers)
        if a.command == "decode":
            decode_files(spark, a.input, a.output, spec, a.uint32, a.context)
        else:
            held = spark.read.format("token_files").option("wide", str(a.uint32).lower()).option("context_size", a.context).load(a.input)
            target = load_tokenizer(a.to, a.tokenizers)
            out = contexts.retokenize(held, spec, target, a.context, a.unitrim)
            out.select("tokens").write.format("token_files").option("wide", str(a.to_uint32 or target.wide).lower()).mode("overwrite").save(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
