"""Packing of documents' tokens into contexts of a fixed size, in order, with padding, indexes, sampling and shuffling.

Documents are dealt to shards of bounded size; within a shard their order is given by sort columns. A
sorted partition streams through the packer, which keeps the unfinished context and the document at hand,
so a shard of any size is packed in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.tokenizer import TokenizerSpec, encode, flat_lists, recode
from textloom.operators.trimming import aligned

#: Documents of a shard, on average, where no shard is given.
SHARD_DOCS = 50_000


@dataclass(frozen=True)
class PackSpec:
    """Settings of a packing job. ``boundary_overlap`` -1: the next context begins after the last boundary.

    With a boundary and an overlap of 0 or more it begins at the boundary nearest to that many tokens
    from the beginning; without a boundary, that many tokens after the beginning. ``boundary_begin``:
    the boundary token opens the next context instead of closing this one.
    """

    context_size: int = 2048
    boundary: str | None = "\n"
    boundary_begin: bool = False
    boundary_overlap: int = -1
    unitrim: bool = True
    end_of_text: str = "<|endoftext|>"
    pad: str | None = None


class Packer:
    """Cuts a stream of tokens into contexts. Feed it sequences, then finish it; both give contexts.

    No token is ever dropped, no context is empty, and a boundary at the very beginning of a context is
    never taken for its end.
    """

    def __init__(self, size: int, boundary: int | None = None, begin: bool = False, overlap: int = -1, align=None):
        self.size, self.boundary, self.begin, self.overlap, self.align = size, boundary, begin, overlap, align
        self.held: list[int] = []
        # Where the next context begins in what is held, and how many tokens of the stream went before what is held.
        self.at = self.gone = 0

    @property
    def position(self) -> int:
        """Where in the stream the next context begins."""
        return self.gone + self.at

    def _cut(self, given: list[int]) -> tuple[list[int], int]:
        """The context at the beginning of some tokens, and where the next begins."""
        context, stop = self.align(given, self.size) if self.align else (given[: self.size], self.size)
        if stop <= 0:
            context, stop = given[: self.size], self.size
        if self.boundary is None:
            return context, min(self.overlap, stop) if self.overlap > 0 else stop
        found = [k for k in range(1, stop) if given[k] == self.boundary]
        if not found:
            return context, stop
        at = found[-1] if self.overlap < 0 else min(found, key=lambda k: (abs(k - self.overlap), k))
        return context, at if self.begin else at + 1

    def feed(self, tokens: list[int]) -> Iterator[list[int]]:
        self.held += tokens
        while len(self.held) - self.at > self.size:
            context, start = self._cut(self.held[self.at : self.at + 2 * self.size])
            yield context
            self.at += start
        # Once a sequence, so that its tokens are moved once.
        del self.held[: self.at]
        self.gone += self.at
        self.at = 0

    def finish(self) -> Iterator[list[int]]:
        if self.held:
            yield self.held
        self.gone += len(self.held)
        self.held = []


def aligner(spec: TokenizerSpec):
    """The function that ends a context on a character's border, for a Packer."""
    e, d = spec.encoder(), spec.decoder()
    return lambda tokens, size: aligned(e, d, tokens, size)


def with_shards(docs: DataFrame, key: str = "doc_id", per_shard: int = SHARD_DOCS) -> DataFrame:
    """Adds ``shard``: a hash of the key over as many shards as keep each near ``per_shard`` documents."""
    n = max(1, math.ceil(docs.count() / per_shard))
    return docs.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def tokenize_docs(docs: DataFrame, spec: TokenizerSpec, pack: PackSpec = PackSpec(), text: str = "text", into: str = "tokens") -> DataFrame:
    """Adds the tokens of each document with the end-of-text token behind them; a null text counts as empty."""
    eot = spec.single_token(pack.end_of_text)
    return docs.withColumn(into, F.concat(encode(F.coalesce(F.col(text), F.lit("")), spec), F.array(F.lit(eot).cast("bigint"))))


def document_index(docs: DataFrame, order: list[str], path: str = "path", tokens: str = "tokens") -> DataFrame:
    """(shard, path, offset, tokens): where in its shard's stream each document begins, and its length."""
    n = F.size(tokens).cast("bigint")
    before = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = docs.select("shard", F.col(path).alias("path"), *[c for c in order if c not in ("shard", "path")], n.alias("tokens"))
    return counted.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"), "tokens")


def document_places(index: DataFrame, contexts: DataFrame) -> DataFrame:
    """(shard, path, offset, tokens, context_no, at): the document index with the context in which each document begins, and where in it.

    contexts: (shard, context_no, start) of pack_contexts; with an overlap the last context that holds the
    beginning counts. A document without a context, as one of a sampled-out one, has the context before it.
    """
    both = contexts.select("shard", F.col("start").alias("offset"), F.lit(0).alias("kind"), "context_no", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("tokens"))
    both = both.unionByName(index.select("shard", "offset", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("context_no"), F.col("path").cast("string").alias("path"), "tokens"))
    before = Window.partitionBy("shard").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == 0, F.struct("context_no", "offset")), ignorenulls=True).over(before)
    placed = both.withColumn("c", begun).where("kind = 1")
    return placed.select("shard", "path", "offset", "tokens", F.col("c.context_no").alias("context_no"), (F.col("offset") - F.col("c.offset")).alias("at"))


def pack_contexts(docs: DataFrame, spec: TokenizerSpec, pack: PackSpec, order: list[str], tokens: str = "tokens") -> DataFrame:
    """(shard, context_no, start, tokens, n_pad) from documents with columns ``shard`` and ``tokens``.

    ``start`` is where in the shard's stream of tokens a context begins.

    ``order`` names the columns that order documents within a shard; rows equal in all of them may come in
    any order. Null tokens count as none. The last context of a shard is padded.
    """
    pad = spec.single_token(pack.pad) if pack.pad else spec.pad_token
    boundary = spec.single_token(pack.boundary) if pack.boundary else None
    held = docs.sparkSession.sparkContext.broadcast(spec)
    size = pack.context_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(held.value) if pack.unitrim else None
        packer, shard, number, out = None, None, 0, []

        def emit(contexts: Iterator[list[int]]) -> None:
            nonlocal number
            for c in contexts:
                # The packer stands at the beginning of the context it has just given.
                out.append((shard, number, packer.position, c))
                number += 1

        def flush() -> pa.RecordBatch:
            lists = [c + [pad] * (size - len(c)) for *_, c in out]
            columns = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), flat_lists(lists), pa.array([size - len(r[3]) for r in out], pa.int32())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["shard", "context_no", "start", "tokens", "n_pad"])

        for batch in batches:
            for s, t in zip(batch.column("shard").to_pylist(), batch.column("tokens"), strict=True):
                if packer is None or s != shard:
                    if packer:
                        emit(packer.finish())
                    packer, shard, number = Packer(size, boundary, pack.boundary_begin, pack.boundary_overlap, align), s, 0
                emit(packer.feed(t.values.to_pylist() if t.is_valid else []))
                if len(out) * size > 1_000_000:
                    yield flush()
        if packer:
            emit(packer.finish())
        yield flush()

    needed = docs.select("shard", *[c for c in order if c not in ("shard", tokens)], F.col(tokens).alias("tokens"))
    spread = needed.repartition("shard").sortWithinPartitions("shard", *order)
    return spread.select("shard", "tokens").mapInArrow(run, "shard int, context_no bigint, start bigint, tokens array<bigint>, n_pad int")


def pad_to(tokens: str | Column, size: int, pad: int) -> Column:
    """A sequence cut to ``size`` tokens, or padded to them."""
    c = F.slice(F.col(tokens) if isinstance(tokens, str) else tokens, 1, size)
    return F.concat(c, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(0), F.lit(size) - F.size(c))))


def boundary_positions(tokens: str | Column, boundary: int) -> Column:
    """Positions, from 0, of a boundary token."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    at = F.filter(F.transform(c, lambda x, i: F.when(x == boundary, i)), lambda i: i.isNotNull())
    return at


def sample_contexts(contexts: DataFrame, percent: int, number: str | Column = "context_no") -> DataFrame:
    """The same share of every run of contexts: of 100 / gcd(percent, 100) in a row, the first so many."""
    if not 0 <= percent <= 100:
        raise ValueError("the percentage lies between 0 and 100")
    run = 100 // math.gcd(percent, 100)
    number = F.col(number) if isinstance(number, str) else number
    return contexts.where(F.pmod(number, F.lit(run)) < round(percent / 100 * run))


def shuffle_contexts(contexts: DataFrame, seed: int, *key: str) -> DataFrame:
    """All contexts in an order that depends on the seed and their key alone."""
    return contexts.orderBy(F.xxhash64(F.lit(seed), *(key or ("shard", "context_no"))), *(key or ("shard", "context_no")))


def context_index(contexts: DataFrame) -> DataFrame:
    """(shard, context_no, offset, tokens): where in its shard's file each context begins."""
    before = Window.partitionBy("shard").orderBy("context_no").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("tokens").cast("bigint")
    return contexts.select("shard", "context_no", n.alias("tokens")).withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def retokenize(df: DataFrame, source: TokenizerSpec, target: TokenizerSpec, size: int | None = None, trim: bool = False, tokens: str = "tokens") -> DataFrame:
    """Tokens of one vocabulary as those of another; with a size cut, trimmed to a character's border if wanted, and padded."""
    from textloom.operators.tokenizer import trim_tokens

    out = df.withColumn(tokens, recode(tokens, source, target))
    if size is None:
        return out
    out = out.withColumn(tokens, F.slice(tokens, 1, size))
    if trim:
        out = out.withColumn(tokens, trim_tokens(tokens, target))
    return out.withColumn(tokens, pad_to(tokens, size, target.pad_token))


def packing_metrics(contexts: DataFrame, name: str = "packing"):
    """The contexts with an observation of their number, tokens and pads; read it after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return contexts.observe(seen, F.count("*").alias("contexts"), F.sum(F.size("tokens")).alias("tokens"), F.sum("n_pad").alias("pads")), seen
