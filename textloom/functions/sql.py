"""Tokenizers as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from textloom.functions.text import sanitize
from textloom.operators.tokenizer import Decoder, Encoder, TokenizerSpec

__all__ = ["register", "sanitize"]


def register(spark: SparkSession, spec: TokenizerSpec, prefix: str = "tok") -> None:
    """Registers ``<prefix>_encode(text)``, ``_decode(tokens)``, ``_count(text)``, ``_encode_binary(text)`` and the
    table function ``_explode(text)`` with (pos, token, piece). Null gives null; for the table function no row."""
    held = spark.sparkContext.broadcast(spec)

    def function(make, kind: pa.DataType, returns: str):
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = make()
            for part in parts:
                yield pa.array([None if x is None else f(x) for x in part.to_pylist()], kind)

        run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return arrow_udf(run, returns)

    def count():
        e = Encoder(held.value)
        return lambda t: len(e(t))

    def binary():
        import numpy as np

        e = Encoder(held.value)
        return lambda t: np.asarray(e(t), "<u4").tobytes()

    spark.udf.register(f"{prefix}_encode", function(lambda: Encoder(held.value), pa.list_(pa.int64()), "array<bigint>"))
    spark.udf.register(f"{prefix}_decode", function(lambda: Decoder(held.value), pa.string(), "string"))
    spark.udf.register(f"{prefix}_count", function(count, pa.int64(), "bigint"))
    spark.udf.register(f"{prefix}_encode_binary", function(binary, pa.binary(), "binary"))

    class Explode:
        def __init__(self):
            self.encoder = Encoder(held.value)
            self.pieces = {i: p for p, i in held.value.vocab.items()}

        def eval(self, text: str):
            if text is not None:
                for k, t in enumerate(self.encoder(text)):
                    yield k, t, self.pieces.get(t)

    spark.udtf.register(f"{prefix}_explode", udtf(Explode, returnType="pos int, token bigint, piece string"))
