"""Structured Streaming: encoding and sanitizing as stateless steps, packing into contexts with state per shard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.text import sanitize
from textloom.operators.contexts import Packer, PackSpec, aligner
from textloom.operators.tokenizer import Shared, TokenizerSpec, encode


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the text files that arrive in a folder, a file a document."""
    held = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return held.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def encode_stream(stream: DataFrame, spec: TokenizerSpec, clean: bool = False, text: str = "text") -> DataFrame:
    """Adds ``tokens`` to a stream with a text column; no state, so any trigger and output mode will do."""
    source = sanitize(text) if clean else F.col(text)
    return stream.withColumn("tokens", encode(source, spec))


def pack_stream(stream: DataFrame, spec: TokenizerSpec, pack: PackSpec, order: str = "doc_id") -> DataFrame:
    """(shard, context_no, tokens, n_pad) from a stream of (shard, ``order``, tokens).

    The state of a shard is the tokens of its unfinished context and a counter. Documents of one batch
    are packed in their order, batches as they come. A row with null tokens ends its shard's stream: the
    unfinished context is padded and emitted.
    """
    size = pack.context_size
    pad = spec.single_token(pack.pad) if pack.pad else spec.pad_token
    boundary = spec.single_token(pack.boundary) if pack.boundary else None
    shared = Shared(spec)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ([], 0)
        align = aligner(shared()) if pack.unitrim else None
        packer = Packer(size, boundary, pack.boundary_begin, pack.boundary_overlap, align)
        packer.held = [int(t) for t in held]
        rows = []
        docs = sorted((r for p in parts for r in zip(p[order], p["tokens"], strict=True)), key=lambda r: r[0])
        for _, tokens in docs:
            for c in packer.finish() if tokens is None else packer.feed([int(t) for t in tokens]):
                rows.append((int(key[0]), int(number), c + [pad] * (size - len(c)), size - len(c)))
                number += 1
        state.update((packer.held, int(number)))
        yield pd.DataFrame(rows, columns=["shard", "context_no", "tokens", "n_pad"])

    return stream.groupBy("shard").applyInPandasWithState(run, "shard int, context_no bigint, tokens array<bigint>, n_pad int", "held array<bigint>, number bigint", "append", GroupStateTimeout.NoTimeout)
