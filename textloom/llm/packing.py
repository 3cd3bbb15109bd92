"""Problem 5: fill contexts of a fixed number of tokens with whole documents, leaving little room empty.

A grouping genetic algorithm works on blocks of documents: crossover injects whole well-filled contexts
of one parent into the other, contexts that would hold a document twice are dissolved, and the displaced
documents are put back by best fit. Each block evolves on several islands in parallel; between epochs
the best solution of an island migrates to its neighbour. A block's emptiest contexts are then dissolved,
and their documents meet those of other blocks in blocks of their own, until one block is left; so at the
end a single context of all may be far from full. Only a document longer than a context is cut.
"""

from __future__ import annotations

import base64
import os
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.util import clashless, materialize, spread

#: Folder of public tokenizer files; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split pattern of the gpt2 vocabulary.
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Documents of a block, on average; a block is one unit of work.
BLOCK_ITEMS = 3000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 30, 6
#: Documents that evolve at least, where full contexts are set aside; share of a block's contexts, the emptiest, that go on to the next level.
EVOLVED_ITEMS, EMPTIEST = 300, 0.1


def _gpt2(folder: str):
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("gpt2-plain", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) in gpt2 tokens of each document that has an id and a text that is not empty.

    A document that stands there several times comes out once, with the longest of its texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _gpt2(tokenizers)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    held = clashless(docs, ["doc_id", "text"]).where("doc_id is not null and text <> ''")
    return spread(held).mapInArrow(count, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


class Bins:
    """Contexts under construction, found by the room they have left: a bit per amount of room that occurs."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.members: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _index(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.members.append(list(items))
        self.room.append(self.capacity - sum(self.sizes[i] for i in items))
        self._index(len(self.room) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Puts each item where the least room stays; opens a context where none has room."""
        for i in items:
            size = self.sizes[i]
            fitting = self.mask >> size
            if not fitting:
                self.add_bin([i])
                continue
            r = size + (fitting & -fitting).bit_length() - 1
            stack = self.by_room[r]
            b = stack.pop()
            if not stack:
                self.mask &= ~(1 << r)
            self.members[b].append(i)
            self.room[b] = r - size
            self._index(b)


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer contexts are better; among as many, unevenly filled ones, which leave usable room together."""
    c = bins.capacity
    return -len(bins.members), sum((1 - r / c) ** 2 for r in bins.room)


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Child of ``a`` with some of the fullest contexts of ``b``, whole."""
    order = sorted(range(len(b.members)), key=lambda k: (b.room[k], rng.random()))
    well = order[: max(1, len(order) // 2)]
    injected = rng.sample(well, max(1, len(well) // rng.choice((2, 3, 4))))
    taken = {i for k in injected for i in b.members[k]}
    child, displaced = Bins(a.sizes, a.capacity), []
    for k in injected:
        child.add_bin(b.members[k])
    for items in a.members:
        if taken.isdisjoint(items):
            child.add_bin(items)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: -a.sizes[i])
    child.best_fit(displaced)
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Dissolves the emptiest contexts and a few others, and puts their documents back by best fit."""
    order = sorted(range(len(a.members)), key=lambda k: -a.room[k])
    gone = set(order[: max(1, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 50)))
    child, displaced = Bins(a.sizes, a.capacity), []
    for k, items in enumerate(a.members):
        if k in gone:
            displaced += items
        else:
            child.add_bin(items)
    displaced.sort(key=lambda i: -a.sizes[i] + rng.random() * 8)
    child.best_fit(displaced)
    return child


def perfect(bins: Bins) -> bool:
    """Whether all contexts but one at most are full to the last token, so that nothing is left to improve."""
    return sum(r > 0 for r in bins.room) <= 1


def _grouped(assigned: list[int]) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(assigned):
        groups.setdefault(b, []).append(i)
    return list(groups.values())


def best_fit_decreasing(sizes: list[int], capacity: int, items: Iterable[int] | None = None) -> Bins:
    """The packing that evolution begins with and has to beat."""
    bins = Bins(sizes, capacity)
    bins.best_fit(sorted(range(len(sizes)) if items is None else items, key=lambda i: (-sizes[i], i)))
    return bins


def evolve(sizes: list[int], capacity: int, population: list[list[int]], seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """One epoch on one island. population: for each solution the context of each item; returned best first.

    Full contexts of the best solution are set aside, as far as EVOLVED_ITEMS items are left; among the rest
    contexts are joined, dissolved and filled again, first for fewer of them, then for all room in as few as
    can be. Ends early when all contexts but one are full.
    """
    rng = random.Random(seed)

    def bins_of(groups: Iterable[list[int]]) -> Bins:
        bins = Bins(sizes, capacity)
        for items in groups:
            bins.add_bin(items)
        return bins

    given = sorted((bins_of(_grouped(p)) for p in population), key=fitness, reverse=True) or [best_fit_decreasing(sizes, capacity)]
    best = given[0]
    order = sorted(range(len(best.members)), key=lambda k: (best.room[k] == 0, rng.random()))
    free, aside = set(), []
    for k in order:
        if best.room[k] or len(free) < EVOLVED_ITEMS:
            free.update(best.members[k])
        else:
            aside.append(best.members[k])

    def seeded() -> Bins:
        bins = Bins(sizes, capacity)
        bins.best_fit(sorted(free, key=lambda i: (-sizes[i] * rng.uniform(0.7, 1.3), i)))
        return bins

    alive = [bins_of([x for items in b.members if (x := [i for i in items if i in free])]) for b in given[:POPULATION]]
    alive += [seeded() for _ in range(POPULATION - len(alive))]
    scored = sorted(((fitness(b), k, b) for k, b in enumerate(alive)), key=lambda x: (x[0], -x[1]), reverse=True)
    for generation in range(generations):
        if perfect(scored[0][2]):
            break
        a, b = rng.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
        child = crossover(*((a[2], b[2]) if a[0] >= b[0] else (b[2], a[2])), rng)
        if generation % 3 == 2:
            child = mutate(child, rng)
        scored.append((fitness(child), len(alive) + generation, child))
        scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        del scored[POPULATION:]
    out = []
    for _, _, bins in scored:
        assigned = [0] * len(sizes)
        for b, items in enumerate([*aside, *bins.members]):
            for i in items:
                assigned[i] = b
        out.append(assigned)
    return out


def settled(sizes: np.ndarray, assigned: np.ndarray, capacity: int) -> np.ndarray:
    """The context of each item, or -1 for items of the emptiest contexts, which meet those of other blocks."""
    if not len(assigned):
        return assigned
    room = capacity - np.bincount(assigned, weights=sizes)
    gone = [b for b in np.argsort(-room, kind="stable")[: max(1, int(len(room) * EMPTIEST))] if room[b] > 0]
    return np.where(np.isin(assigned, gone), -1, assigned)


ISLAND = "block bigint, island int, sizes binary, population binary, elite binary"


def _epoch(capacity: int, epoch: int, generations: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for block, island, raw, pop, migrant in zip(part.block, part.island, part.sizes, part.population, part.migrant, strict=True):
                sizes = np.frombuffer(raw, np.int32).tolist()
                n = len(sizes)
                unpack = lambda x: np.frombuffer(x, np.int32).reshape(-1, n).tolist() if x is not None and n else []  # noqa: E731, B023
                seed = (int(block) * 1_000_003 + int(island)) * 31 + epoch
                best = evolve(sizes, capacity, unpack(pop) + unpack(migrant), seed, generations)
                rows.append((block, island, raw, np.array(best, np.int32).tobytes(), np.array(best[0], np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["block", "island", "sizes", "population", "elite"])

    return run


def pack_counts(counts: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(doc_id, piece_no, start, n_tokens, context_id) from (doc_id, n_tokens).

    A document within the capacity lies whole in one context. A longer one is cut into full contexts and
    a rest, and the rest is packed as a document is. Documents without tokens are in no context. Every
    token of every document lies in exactly one piece. ``context_id`` names a context within the result.
    """
    held = materialize(counts.where("n_tokens > 0").withColumn("full", F.floor(F.col("n_tokens") / capacity).cast("int")).withColumn("rest", (F.col("n_tokens") % capacity).cast("int")), "counts")
    long = held.where("full > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"))
    full = long.select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.format_string("full-%d-%d", "doc_id", "piece_no").alias("context_id"))
    result = full
    items = held.where("rest > 0").select("doc_id", "rest", "full")
    level, blocks = 0, max(1, round(items.count() / BLOCK_ITEMS))
    while True:
        placed = materialize(_pack_level(items, level, blocks, capacity, islands, epochs, generations), "placed")
        here = placed.where("bin >= 0")
        rest = here.select("doc_id", F.col("full").alias("piece_no"), (F.col("full").cast("bigint") * capacity).alias("start"), F.col("rest").cast("bigint").alias("n_tokens"), F.format_string("mixed-%d-%d-%d", F.lit(level), "block", "bin").alias("context_id"))
        result = result.unionByName(rest)
        if blocks == 1:
            return result
        # A level takes about a tenth of the contexts of the one before, so there are few.
        items = placed.where("bin < 0").select("doc_id", "rest", "full")
        level, blocks = level + 1, min(blocks // 2, max(1, round(items.count() / BLOCK_ITEMS)))


def _pack_level(items: DataFrame, level: int, blocks: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(block, doc_id, rest, full, bin): the contexts of the items of each block; -1 for those that go on to the next level, if there is one."""
    gathered = items.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rest", "doc_id", "full"))).alias("items"))
    # A block is bounded by the hash that fills it, so its items fit in a row.
    gathered = materialize(gathered, "blocks")
    as_bytes = F.pandas_udf(lambda s: s.map(lambda a: np.asarray(a, np.int32).tobytes()), "binary")
    state = gathered.select("block", as_bytes(F.col("items.rest")).alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.select("block", "island", "sizes", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    for epoch in range(epochs):
        # A few islands a task, so that starting a worker weighs little.
        spread = state.repartition(max(1, blocks * islands // 3), "block", "island")
        state = materialize(spread.mapInPandas(_epoch(capacity, epoch, generations), ISLAND), "islands")
        elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
        if epoch + 1 < epochs:
            state = state.drop("elite").join(elite, ["block", "island"])

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for block, island, raw, elite in zip(part.block, part.island, part.sizes, part.elite, strict=True):
                sizes, bins = np.frombuffer(raw, np.int32), np.frombuffer(elite, np.int32)
                least = float(np.square(np.bincount(bins, weights=sizes) / capacity).sum()) if len(bins) else 0.0
                rows.append((block, island, int(bins.max(initial=-1)) + 1, -least, settled(sizes, bins, capacity) if blocks > 1 else bins))
            yield pd.DataFrame(rows, columns=["block", "island", "n", "uneven", "bins"])

    solved = state.select("block", "island", "sizes", "elite").mapInPandas(best, "block bigint, island int, n int, uneven double, bins array<int>")
    chosen = solved.groupBy("block").agg(F.min_by("bins", F.struct("n", "uneven", "island")).alias("bins"))
    placed = gathered.join(chosen, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    return placed.select("block", "x.items.doc_id", "x.items.rest", "x.items.full", F.col("x.bins").alias("bin"))


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizers: str = TOKENIZERS, **options) -> DataFrame:
    """Assigns the documents, measured in gpt2 tokens, to contexts of ``capacity`` tokens; see pack_counts."""
    return pack_counts(token_counts(docs, tokenizers), capacity, **options)
