import random
from collections import Counter

import pytest

from textloom.llm import leakage
from textloom.llm.leakage import RARITY, LeakIndex, find_leaks, widely_held, words
from textloom.util import table


@pytest.fixture(scope="module")
def items(spark, data):
    return [(r[0], r[1]) for r in table(spark, data, "eval_items").select("eval_id", "text").orderBy("eval_id").collect()]


def test_words():
    assert words("<b>Hello</b>,  W​orld! ｋｉｔｅｓ&nbsp;2x") == ["hello", "world", "kites", "2", "x"]


def indexed(items):
    """The index of some items, with their widely held words counted one by one."""
    each = {i: set(words(t)) for i, t in items}
    n = Counter(w for ws in each.values() for w in ws)
    most = {i: RARITY * min(n[w] for w in ws) for i, ws in each.items() if ws}
    return LeakIndex((i, t, [w for w in each[i] if n[w] > most[i]]) for i, t in items)


def planted(rng, w, share, changed, pieces=1):
    """A passage of so many of an item's words, some of them changed or left out, in one piece or several, between other words."""
    k = -(-round(len(w) * share * 1000) // 1000)
    start = rng.randrange(len(w) - k + 1)
    part = [rng.choice(["", "other"]) if rng.random() < changed else x for x in w[start : start + k]]
    filler = "I compared it with many other models before ordering and I am very happy with it indeed".split()
    doc = filler * rng.randrange(1, 40)
    for j in range(pieces):
        doc += part[j * k // pieces : (j + 1) * k // pieces] + filler
    return " ".join(doc)


def test_widely_held(spark, items):
    df = spark.createDataFrame(items, "eval_id long, text string")
    got = {r.eval_id: set(r.widely) for r in widely_held(df).collect()}
    index = indexed(items)
    assert set(got) == set(index.ids)
    again = LeakIndex((i, t, got[i]) for i, t in items if i in got)
    assert all((a == b).all() for a, b in zip(index.own, again.own, strict=True)) and any(not own.all() for own in index.own)


@pytest.mark.parametrize(("share", "changed", "pieces", "least"), [(0.7, 0.08, 1, 0.99), (0.7, 0.08, 2, 0.98), (0.6, 0.125, 1, 0.97), (0.52, 0.125, 1, 0.9), (0.52, 0, 1, 0.99)])
def test_planted(items, share, changed, pieces, least):
    rng = random.Random(4)
    index = indexed(items)
    tried = found = 0
    for i, text in rng.sample(items, 200) * 2:
        tried += 1
        found += i in {e for e, _ in index.search(planted(rng, text.split(), share, changed, pieces).upper())}
    assert tried == 400 and found / tried >= least


@pytest.mark.parametrize("share", [0.25, 0.45])
def test_less_than_half_is_no_case(items, share):
    rng = random.Random(5)
    index = indexed(items)
    assert sum(i in {e for e, _ in index.search(planted(rng, text.split(), share, 0))} for i, text in rng.sample(items, 200)) <= 2


def test_sketch_recall_against_all_shingles(spark, data, items, monkeypatch):
    """The sketches find what an index of all shingles does, where one shared shingle makes a candidate."""
    index = indexed(items)
    monkeypatch.setattr(leakage, "PARTITIONS", ((1 << 62, 1 << 62, 1),))
    full = indexed(items)
    assert len(full.sketch) > len(index.sketch)
    docs = [r[0] for r in table(spark, data.replace("0.001", "0.01"), "documents").where("text is not null").select("text").collect()]
    rng = random.Random(6)
    docs += [planted(rng, text.split(), rng.choice((0.5, 0.55, 0.7)), 0.125, rng.choice((1, 2))) for _, text in items]
    got = {(k, e) for k, t in enumerate(docs) for e, _ in index.search(t)}
    wanted = {(k, e) for k, t in enumerate(docs) for e, _ in full.search(t)}
    assert len(wanted) > 150 and got <= wanted and len(got) >= 0.99 * len(wanted)


def test_blocks_change_nothing(spark, data, items):
    docs = table(spark, data.replace("0.001", "0.01"), "documents")
    df = spark.createDataFrame(items, "eval_id long, text string")
    one, eight, forty = ({tuple(r) for r in find_leaks(docs, df, block_items=-(-len(items) // n)).collect()} for n in (1, 8, 40))
    assert one and one == eight == forty
    index = indexed(items)
    assert one == {(r.doc_id, e, s) for r in docs.where("text is not null").collect() for e, s in index.search(r.text)}


def test_other_names_and_numbers(items):
    index = indexed(items)
    swapped = lambda text: " ".join("Zorbl" if w[:1].isupper() and k else "4711" if any(map(str.isdigit, w)) else w for k, w in enumerate(text.split()))
    assert sum(i in {e for e, _ in index.search(swapped(text))} for i, text in items) <= 0.02 * len(items)


def test_rows(spark, items):
    rows = [(1, items[0][1]), (1, items[0][1]), (2, None), (None, items[0][1]), (3, ""), (4, "word " * 50_000 + items[1][1])]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, eval_id long")
    ev = spark.createDataFrame([*items[:5], (None, "x y z"), (77, None), (78, "a b"), (79, "")], "eval_id long, text string")
    got = {(r.doc_id, r.eval_id) for r in find_leaks(docs, ev).collect()}
    assert {(1, items[0][0]), (4, items[1][0])} <= got and {d for d, _ in got} == {1, 4}
    assert find_leaks(docs.where("false"), ev).count() == 0 and find_leaks(docs, ev.where("false")).count() == 0


def test_items_that_repeat_a_shingle_often():
    r = random.Random(72)
    item = [w for j in range(40) for w in ("buy", "it", "now", *(f"u{j}{x}" for x in range(r.randint(1, 5))))]
    doc = ["x" if r.random() < r.choice((0.1, 0.15, 0.2)) else w for w in item]
    assert indexed([(1, " ".join(item))]).search(" ".join(doc)) == [(1, 1.0)]
