import random

import numpy as np
import pytest

from textloom.llm.splitting import greedy_cuts, oversized_kinds, split_oversized


def brute(n, cuts, size, overlap):
    """Piece starts one after another, each as far as it may be."""
    overlap = min(max(overlap, 0), size - 1)
    out = [(0, True)]
    while True:
        reach = out[-1][0] + (size if len(out) == 1 else max(size - overlap, 1))
        if reach >= n:
            return out
        within = [c for c in cuts if out[-1][0] < c <= reach]
        out.append((within[-1], True) if within else (reach, False))


def test_greedy_cuts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 6))]
        sizes = [rng.randrange(1, 12) for _ in texts]
        overlaps = [rng.choice([-1, 0, 1, 3, 20]) for _ in texts]
        cuts = [sorted(rng.sample(range(1, n), rng.randrange(0, n))) if n > 1 else [] for n in texts]
        begins = np.cumsum([0, *texts[:-1]])
        flat = np.array([b + c for b, cs in zip(begins, cuts, strict=True) for c in cs], np.int64)
        of = np.array([k for k, cs in enumerate(cuts) for _ in cs], np.int64)
        text, pos, natural = greedy_cuts(np.array(texts), flat, of, np.array(sizes), np.array(overlaps))
        for k, n in enumerate(texts):
            got = [(int(p - begins[k]), bool(x)) for t, p, x in zip(text, pos, natural, strict=True) if t == k]
            assert got == brute(n, cuts[k], sizes[k], overlaps[k])


@pytest.fixture(scope="module")
def tables(spark):
    jobs = spark.createDataFrame(
        [(1, 4, ".", False, 1, 1), (1, 2, ".", False, 1, 0), (2, 3, "\\n", True, -1, 1), (3, 3, "", False, 0, 1), (4, 3, None, None, None, None), (None, 9, ".", False, 0, 1), (5, 3, "no piece", False, 0, 1)],
        "job_id long, context_size int, boundary string, boundary_begin boolean, boundary_overlap int, updated_at long",
    )
    vocab = spark.createDataFrame([(".", 9), ("0x0a", 8), ("a", 1), (None, 7)], "piece string, token long")
    return jobs, vocab


def test_pieces_and_kinds(spark, tables):
    jobs, vocab = tables
    rows = [(1, 1, [1, 1, 9, 1, 1, 9, 1]), (1, 1, [1, 1, 9, 1, 1, 9, 1]), (2, 2, [1, 1, 8, 1, 8, 1, 1]), (3, 3, [1] * 7), (4, 1, None), (5, None, [1] * 9), (6, 99, [1] * 9), (7, 1, [1] * 4), (8, 1, []), (9, 4, [1, None, 1, 1]), (10, 1, [1] * 9 + [9]), (11, 5, [1] * 4)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text_id long, job_id long, tokens array<bigint>, context_size string")
    kinds = {r.text_id: r.kind for r in oversized_kinds(docs, jobs, vocab).collect()}
    assert kinds == {1: "at_boundary", 2: "at_boundary", 3: "forced", 9: "forced", 10: "forced", 11: "forced"}
    got = {}
    for r in split_oversized(docs, jobs, vocab).orderBy("text_id", "piece_no").collect():
        got.setdefault(r.text_id, []).append(r)
    assert set(got) == {1, 2, 3, 7, 9, 10, 11}
    limits = {1: 4, 2: 3, 3: 3, 7: 4, 9: 3, 10: 4, 11: 3}
    for r in rows:
        if r[0] in got:
            pieces = got[r[0]]
            assert all(p.tokens == r[2][p.start : p.end] and len(p.tokens) <= limits[r[0]] for p in pieces)
            assert [t for p in pieces for t in p.tokens[p.n_overlap :]] == r[2]
    assert [(p.start, p.end, p.n_overlap) for p in got[1]] == [(0, 3, 0), (2, 6, 1), (5, 7, 1)]
    assert [(p.start, p.end) for p in got[2]] == [(0, 2), (2, 4), (4, 7)]


def test_empty(spark, tables):
    jobs, vocab = tables
    docs = spark.createDataFrame([], "text_id long, job_id long, tokens array<bigint>")
    assert oversized_kinds(docs, jobs, vocab).count() == 0
    assert split_oversized(docs, jobs.where("false"), vocab).count() == 0
