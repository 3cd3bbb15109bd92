"""Tokens as little-endian bytes and back, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textloom.functions.text import ColumnLike, col


def to_hex(tokens: ColumnLike, wide: bool = False) -> Column:
    """Hex of a token sequence, 16 or 32 bits each, little-endian; an id too large for the width is an error."""
    digits, most = (8, 0xFFFFFFFF) if wide else (4, 0xFFFF)

    def one(t: Column) -> Column:
        big = F.lpad(F.hex(t), digits, "0")
        little = F.concat(*[F.substr(big, F.lit(k), F.lit(2)) for k in range(digits - 1, 0, -2)])
        return F.when(t.between(0, most), little).otherwise(F.raise_error(F.concat(F.lit("token "), t.cast("string"), F.lit(f" does not fit into {digits * 4} bits"))))

    return F.array_join(F.transform(col(tokens), one), "")


def _arrow(one, kind: pa.DataType, returns: str):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if x is None else one(x) for x in part.to_pylist()], kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returns)


def to_binary(tokens: ColumnLike, wide: bool = False) -> Column:
    """A token sequence as bytes; an id too large for the width is an error. Long sequences take linear time."""
    most, kind = (0xFFFFFFFF, "<u4") if wide else (0xFFFF, "<u2")

    def one(t: list) -> bytes:
        a = np.asarray(t, np.int64)
        if len(a) and (a.min() < 0 or a.max() > most):
            raise ValueError(f"a token does not fit into {8 * int(kind[2])} bits")
        return a.astype(kind).tobytes()

    return _arrow(one, pa.binary(), "binary")(col(tokens))


def to_binary_for(tokens: ColumnLike, vocab_size: int, force_wide: bool = False) -> Column:
    """Bytes of the width a vocabulary needs: 32 bits if it has more than 65,536 pieces or if forced."""
    return to_binary(tokens, force_wide or vocab_size > 65_536)


def from_binary(data: ColumnLike, wide: bool = False) -> Column:
    """Tokens of little-endian bytes; bytes at the end that make no whole token are left out."""
    width = 4 if wide else 2
    return _arrow(lambda b: np.frombuffer(b[: len(b) - len(b) % width], f"<u{width}").astype(np.int64), pa.list_(pa.int64()), "array<bigint>")(col(data))
