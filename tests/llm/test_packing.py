import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import packing
from textloom.llm.packing import TOKENIZERS, best_fit_decreasing, evolve, fitness, pack_counts, token_counts
from textloom.util import table


def test_evolve_is_a_partition_within_capacity():
    rng = random.Random(5)
    for seed in range(5):
        sizes = [rng.randrange(1, 100) for _ in range(200)]
        population = evolve(sizes, 100, [], seed)
        again = evolve(sizes, 100, population + population[:1], seed + 1)
        assert max(again[0]) <= max(population[0])
        for solution in again:
            fill = {}
            for i, b in enumerate(solution):
                fill[b] = fill.get(b, 0) + sizes[i]
            assert len(solution) == len(sizes) and max(fill.values()) <= 100
        assert max(again[0]) + 1 <= -(-sum(sizes) // 100) * 1.05


def test_evolve_finds_what_best_fit_does_not():
    """Triplets that fill 40 contexts to the last token: best fit, with which evolution begins, needs more."""
    rng = random.Random(1)
    sizes = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(1, 60), 2))
        sizes += [a, b - a, 60 - b]
    assert len(best_fit_decreasing(sizes, 60).members) > 40
    assert max(evolve(sizes, 60, [], 3, generations=300)[0]) + 1 == 40


@pytest.fixture(scope="module")
def real_sizes(spark, data):
    docs = table(spark, data.replace("0.001", "0.01"), "documents")
    return [r.n_tokens for r in token_counts(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("capacity", [512, 1024])
def test_evolution_beats_its_seed_on_real_sizes(real_sizes, capacity):
    """Documents of at least a sixth of a context, the ones that don't fill gaps: fewer contexts than best fit, or less room outside the emptiest."""
    sizes = [n % capacity for n in real_sizes if n % capacity >= capacity // 6]
    seed = best_fit_decreasing(sizes, capacity)
    assert len(sizes) > 50
    population = []
    for epoch in range(4):
        population = evolve(sizes, capacity, population, epoch, generations=200)
    fill = Counter()
    for i, b in enumerate(population[0]):
        fill[b] += sizes[i]
    mine = (-len(fill), sum((x / capacity) ** 2 for x in fill.values()))
    assert mine > fitness(seed)


def test_blocks_meet(spark, monkeypatch):
    """The contexts of all blocks together are at most one more than the tokens need."""
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 60)
    rng = random.Random(4)
    counts = [(k, rng.choice([1, 2, 3, 5, 9, 17, 30, 41, 64, 150])) for k in range(2000)]
    got = pack_counts(spark.createDataFrame(counts, "doc_id long, n_tokens long"), 64).cache()
    fill = [r.n for r in got.groupBy("context_id").agg(F.sum("n_tokens").alias("n")).collect()]
    assert max(fill) <= 64 and sum(fill) == sum(n for _, n in counts)
    assert len(fill) <= -(-sum(fill) // 64) + 1
    assert len({r.context_id.split("-")[1] for r in got.where("context_id like 'mixed%'").select("context_id").collect()}) > 2


def test_pack_counts(spark):
    rng = random.Random(2)
    counts = {k: rng.choice([1, 5, 30, 64, 65, 200, 128]) for k in range(700)} | {9000: 0}
    df = spark.createDataFrame([(k, n, 3) for k, n in counts.items()], "doc_id long, n_tokens long, block int").select("doc_id", "n_tokens")
    got = pack_counts(df, 64).cache()
    per = {r.doc_id: sorted((p.start, p.n_tokens) for p in r.p) for r in got.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_tokens")).alias("p")).collect()}
    for k, n in counts.items():
        if n:
            wanted = [(s, min(64, n - s)) for s in range(0, n, 64)]
            assert per[k] == wanted
    assert 9000 not in per
    fill = [r.n for r in got.groupBy("context_id").agg(F.sum("n_tokens").alias("n")).collect()]
    assert max(fill) <= 64 and sum(fill) / len(fill) > 0.97 * 64


def test_empty(spark):
    assert pack_counts(spark.createDataFrame([], "doc_id long, n_tokens long"), 64).count() == 0


@pytest.mark.skipif(not os.path.isfile(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no public tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "This is a test.", 0), (1, "This", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, "a" * 20_000, 0), (5, "<|endoftext|>", 0)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 5 and set(got) == {1, 4, 5} and got[5] > 1
