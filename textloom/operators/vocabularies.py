"""Vocabularies as DataFrames: conversion of piece models, derivation of merges, exclusion, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of pieces in a piece model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def parse_piece_model(data: bytes) -> list[tuple[int, str, float, int]]:
    """(id, piece, score, kind) of a serialized piece model: field 1 holds a piece each, of fields 1 text, 2 score, 3 kind."""
    import struct

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out, at
            shift += 7

    def fields(at: int, end: int):
        while at < end:
            key, at = varint(at)
            wire = key & 7
            if wire == 0:
                value, at = varint(at)
            elif wire == 1:
                value, at = data[at : at + 8], at + 8
            elif wire == 5:
                value, at = data[at : at + 4], at + 4
            elif wire == 2:
                n, at = varint(at)
                value, at = (at, at + n), at + n
            else:
                raise ValueError("not a piece model")
            yield key >> 3, value

    out = []
    for number, span in fields(0, len(data)):
        if number == 1 and isinstance(span, tuple):
            piece, score, kind = "", 0.0, NORMAL
            for f, v in fields(*span):
                if f == 1:
                    piece = data[v[0] : v[1]].decode("utf-8")
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            out.append((len(out), piece, score, kind))
    return out


def read_piece_model(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score, kind) of a piece model file. Such a file is one small message."""
    with open(path, "rb") as f:
        return spark.createDataFrame(parse_piece_model(f.read()), "id bigint, piece string, score double, kind int")


def pieces_to_vocab(pieces: DataFrame) -> DataFrame:
    """(token, piece, special, first_token) of (id, piece, kind): the lower one eighth block is a space, ``<0xNN>`` is a byte ``0xNN``.

    Control and user-defined pieces are special. Of several ids with one spelling the lowest is
    ``first_token`` of all of them; where it differs from ``token``, the row is a duplicate.
    """
    shown = F.when(F.col("kind") == BYTE, F.regexp_replace("piece", r"^<(0x[0-9A-Fa-f]{2})>$", "$1")).otherwise(F.replace("piece", F.lit("▁"), F.lit(" ")))
    held = pieces.where("piece is not null").select(F.col("id").alias("token"), shown.alias("piece"), F.col("kind").isin(CONTROL, USER_DEFINED).alias("special"))
    return held.withColumn("first_token", F.min("token").over(Window.partitionBy("piece")))


def duplicates(vocab: DataFrame) -> DataFrame:
    """(old_id, new_id, repr) of the ids whose spelling another, lower id has."""
    return vocab.where("token <> first_token").select(F.col("token").alias("old_id"), F.col("first_token").alias("new_id"), F.col("piece").alias("repr"))


def merge_table(vocab: DataFrame) -> DataFrame:
    """(left, right, merged, left_token, right_token, merged_token): every split of a piece, between characters, whose halves are pieces.

    Two equi-joins on the halves; a piece of n characters makes n - 1 candidates, never pairs of pieces.
    Null pieces take no part; of several ids of one piece the lowest counts.
    """
    v = vocab.where("piece is not null and piece <> ''").groupBy("piece").agg(F.min("token").alias("token"))
    n = F.char_length("piece")
    cuts = v.where(n > 1).select(F.col("piece").alias("merged"), F.col("token").alias("merged_token"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    halves = cuts.select("merged", "merged_token", F.expr("substring(merged, 1, k)").alias("left"), F.expr("substring(merged, k + 1)").alias("right"))
    lefts = v.select(F.col("piece").alias("left"), F.col("token").alias("left_token"))
    rights = v.select(F.col("piece").alias("right"), F.col("token").alias("right_token"))
    return halves.join(lefts, "left").join(rights, "right").select("left", "right", "merged", "left_token", "right_token", "merged_token")


def merge_entries(table: DataFrame) -> DataFrame:
    """The merge table with ``rank``, from 0: by the id merged into, ties by left and right, so that the order is always the same.

    Single characters have no merge. The rank is over one vocabulary, which is bounded.
    """
    order = Window.orderBy("merged_token", "left", "right")
    return table.where(F.char_length("merged") > 1).withColumn("rank", F.row_number().over(order) - 1)


def exclude(vocab: DataFrame, merges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (piece, token) and merges (rank, left, right) without the pieces excluded and the merges that make or use them."""
    gone = excluded.select("piece").distinct()
    kept = vocab.join(gone, "piece", "left_anti")
    for part in (F.concat("left", "right"), F.col("left"), F.col("right")):
        merges = merges.withColumn("piece", part).join(gone, "piece", "left_anti").drop("piece")
    return kept, merges


def id_merges(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(left_token, right_token, merged_token) of ranked merges; those with a piece that is in no vocabulary are left out."""
    ids = vocab.where("piece is not null").groupBy("piece").agg(F.min("token").alias("token"))
    side = lambda name: ids.select(F.col("piece").alias(name), F.col("token").alias(f"{name}_token"))
    return merges.withColumn("merged", F.concat("left", "right")).join(side("left"), "left").join(side("right"), "right").join(side("merged"), "merged").select("left_token", "right_token", "merged_token")


def vocab_json(vocab: DataFrame) -> str:
    """vocab.json of (piece, token), in order of ids. A vocabulary is bounded."""
    import json

    rows = vocab.select("piece", "token").orderBy("token").collect()
    return json.dumps({r[0]: r[1] for r in rows}, ensure_ascii=False)


def merges_json(entries: DataFrame, verbose: bool = False) -> str:
    """merges.json of ranked entries: pairs, or objects with the pieces and ids."""
    import json

    rows = entries.orderBy("rank").collect()
    if verbose:
        return json.dumps([{k: r[k] for k in ("left", "right", "merged", "left_token", "right_token", "merged_token")} for r in rows], ensure_ascii=False)
    return json.dumps([[r["left"], r["right"]] for r in rows], ensure_ascii=False)


def specials_text(vocab: DataFrame) -> str:
    """specials.txt: special pieces, the shortest in bytes first, ties in order."""
    rows = vocab.where("special").select("piece").distinct().orderBy(F.octet_length("piece"), "piece").collect()
    return "".join(f"{r[0]}\n" for r in rows)


def duplicates_json(vocab: DataFrame) -> str:
    import json

    return json.dumps([{"old_id": r[0], "new_id": r[1], "repr": r[2]} for r in duplicates(vocab).orderBy("old_id").collect()], ensure_ascii=False)


def convert_piece_model(spark: SparkSession, path: str, out_dir: str, verbose: bool = False) -> None:
    """Writes vocab.json, merges.json, specials.txt and duplicates.json of a piece model into a folder."""
    import os

    vocab = pieces_to_vocab(read_piece_model(spark, path)).cache()
    os.makedirs(out_dir, exist_ok=True)
    own = vocab.where("token = first_token")
    contents = {"vocab.json": vocab_json(own), "merges.json": merges_json(merge_entries(merge_table(own.where("not special"))), verbose), "specials.txt": specials_text(vocab), "duplicates.json": duplicates_json(vocab)}
    for name, text in contents.items():
        with open(os.path.join(out_dir, name), "w", encoding="utf-8") as f:
            f.write(text)
    vocab.unpersist()
