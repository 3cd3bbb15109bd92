import random

import pytest

from textloom.operators import contexts
from textloom.operators.contexts import Packer, PackSpec
from textloom.operators.tokenizer import TokenizerSpec

SPEC = TokenizerSpec("x", {"<pad>": 0, "<|endoftext|>": 1, **{chr(97 + k): k + 2 for k in range(20)}}, specials=("<pad>", "<|endoftext|>"), byte_level=False)


def brute(tokens, size, boundary, begin):
    start, out = 0, []
    while len(tokens) - start > size:
        out.append(tokens[start : start + size])
        at = [k for k in range(start + 1, start + size) if tokens[k] == boundary]
        start = (at[-1] + (0 if begin else 1)) if at else start + size
    if start < len(tokens):
        out.append(tokens[start:])
    return out


@pytest.mark.parametrize("begin", [False, True])
def test_packer_equals_brute_force(begin):
    rng = random.Random(1)
    for _ in range(500):
        tokens = [rng.randrange(6) for _ in range(rng.randrange(60))]
        size = rng.randrange(2, 9)
        packer, got = Packer(size, 3, begin), []
        at = 0
        while at < len(tokens):
            n = rng.randrange(1, 7)
            got += packer.feed(tokens[at : at + n])
            at += n
        assert got + list(packer.finish()) == brute(tokens, size, 3, begin)


def test_overlap_without_boundary():
    packer = Packer(4, None, overlap=2)
    assert list(packer.feed([1, 2, 3, 4, 5, 6])) + list(packer.finish()) == [[1, 2, 3, 4], [3, 4, 5, 6]]


def test_pack_contexts(spark):
    rows = [(s, k, [2 + (k + j) % 5 for j in range(k % 7)]) for s in range(3) for k in range(20)] + [(3, 0, None), (4, 0, [])]
    df = spark.createDataFrame(rows, "shard int, k long, tokens array<bigint>").repartition(5)
    got = contexts.pack_contexts(df, SPEC, PackSpec(8, "b", unitrim=False), ["k"]).collect()
    for s in range(3):
        stream = [t for r in rows if r[0] == s for t in r[2]]
        mine = [r.tokens[: 8 - r.n_pad] for r in sorted((r for r in got if r.shard == s), key=lambda r: r.context_no)]
        assert mine == brute(stream, 8, 3, False)
    assert all(len(r.tokens) == 8 and r.tokens[8 - r.n_pad :] == [0] * r.n_pad for r in got)
    assert {r.shard for r in got} == {0, 1, 2}
    assert contexts.pack_contexts(df.where("false"), SPEC, PackSpec(8, "b", unitrim=False), ["k"]).count() == 0


def test_start_and_offsets(spark):
    """Contexts say where in the stream they begin, whatever the overlap."""
    rows = [(s, k, [2 + (k * 3 + j) % 5 for j in range(k % 9)]) for s in range(2) for k in range(30)]
    df = spark.createDataFrame(rows, "shard int, k long, tokens array<bigint>")
    for pack in (PackSpec(8, "b", unitrim=False), PackSpec(8, "b", boundary_begin=True, unitrim=False), PackSpec(8, "b", boundary_overlap=3, unitrim=False), PackSpec(8, None, boundary_overlap=5, unitrim=False)):
        got = contexts.pack_contexts(df, SPEC, pack, ["k"]).collect()
        for s in range(2):
            stream = [t for r in rows if r[0] == s for t in r[2]]
            mine = sorted((r for r in got if r.shard == s), key=lambda r: r.context_no)
            assert [r.context_no for r in mine] == list(range(len(mine)))
            assert all(r.tokens[: 8 - r.n_pad] == stream[r.start : r.start + 8 - r.n_pad] for r in mine)


def test_index_sampling_and_shuffle(spark):
    df = spark.createDataFrame([(0, k, [2] * (k + 1)) for k in range(10)], "shard int, path long, tokens array<bigint>")
    index = {r.path: (r.offset, r.tokens) for r in contexts.document_index(df, ["path"]).collect()}
    assert index[0] == (0, 1) and index[3] == (6, 4)
    numbered = spark.createDataFrame([(0, k) for k in range(100)], "shard int, context_no long")
    for percent in (0, 7, 25, 50, 80, 100):
        assert contexts.sample_contexts(numbered, percent).count() == percent
    one, two = ([r[1] for r in contexts.shuffle_contexts(numbered, s).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(100)) and one != two
    with pytest.raises(ValueError):
        contexts.sample_contexts(numbered, 101)


def test_pad_to(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<bigint>")
    assert [r[0] for r in df.select(contexts.pad_to("t", 2, 9)).collect()] == [[1, 2], [9, 9]]
    assert [r[0] for r in df.select(contexts.boundary_positions("t", 3)).collect()] == [[2], []]
