"""Problem 6: passages of evaluation items inside documents.

Size-partitioned MinHash containment search: items are partitioned by their number of shingles, each
partition with its own sketch length and threshold, and the share of an item's bottom hashes that stand
among a document's shingles estimates how much of the item the document contains, however long the
document is. Candidates are verified by exact shingle containment: matching shingles are chained into
running passages, and the item words these cover are counted.
"""

from __future__ import annotations

import html
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.lookalikes import look
from textloom.util import clashless, materialize, spread

#: Words of a shingle. An eighth of the words may be changed, which leaves two thirds of such shingles whole.
SHINGLE = 3
#: Partitions of the items by their number of shingles: (up to, hashes kept of an item, hashes that make a candidate).
PARTITIONS = ((16, 16, 1), (32, 32, 2), (64, 48, 3), (128, 64, 4), (1 << 62, 96, 6))
#: Least share of an item's words, least words of a passage, and words that may be changed or left out between two shingles.
SHARE, PASSAGE_WORDS, GAP = 0.5, 5, 4
#: Least share of the item's own words (names, numbers) in the passages found that must match.
OWN = 0.5
#: A word is an item's own if at most this many times as many items hold it as hold the item's rarest word.
RARITY = 4
#: Items searched at once; more are taken in blocks, which give the same rows.
BLOCK_ITEMS = 20_000

_TAG = regex.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+")


def words(text: str) -> list[str]:
    """Words of a text apart from case, punctuation, spacing, markup and the look of letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall((text if text.isascii() else look(text)).casefold())


def shingle_hashes(w: list[str]) -> list[int]:
    """Hashes of the shingles of some words, in their order, the same whatever else is searched for; as signed numbers."""
    hashes = (xxhash.xxh64_intdigest("\n".join(w[k : k + SHINGLE])) for k in range(len(w) - SHINGLE + 1))
    return [h - (1 << 64) if h >> 63 else h for h in hashes]


def widely_held(items: DataFrame) -> DataFrame:
    """(eval_id, widely): the words of each item that more items hold than its own ones.

    An item's own words, names and numbers most of them, are those that at most RARITY times as many items hold
    as hold its rarest word; so an item that is held several times, in equal or nearly equal words, has its own, too.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, w) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sorted(set(words(text)))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string())], ["eval_id", "word"])

    held = items.mapInArrow(each, "eval_id bigint, word string").distinct()
    counted = held.join(held.groupBy("word").agg(F.count("*").alias("n")), "word")
    per = counted.groupBy("eval_id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("all"))
    most = RARITY * F.col("all")[0]["n"]
    return per.select("eval_id", F.transform(F.filter("all", lambda x: x.n > most), lambda x: x.word).alias("widely"))


class LeakIndex:
    """Sketches of evaluation items, searched by documents one at a time. items: (id, text, the words of it that are not its own)."""

    def __init__(self, items: Iterable[tuple[int, str, Iterable[str]]]):
        self.ids: list[int] = []
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        #: Which words of each item are its own.
        self.own: list[np.ndarray] = []
        self.positions: list[dict[int, list[int]]] = []
        self.need: list[int] = []
        kept: list[list[int]] = []
        for i, text, widely in items:
            w = words(text)
            if len(w) < SHINGLE:
                continue
            self.ids.append(i)
            self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
            shared = set(widely)
            self.own.append(np.array([x not in shared for x in w]))
            at: dict[int, int] = {}
            for p, h in enumerate(shingle_hashes(w)):
                at.setdefault(h, p)
            keep, need = next((keep, need) for most, keep, need in PARTITIONS if len(at) <= most)
            self.need.append(min(need, len(at)))
            kept.append([at[h] for h in sorted(at)[:keep]])
        self.base = max(2, len(self.vocab))
        postings: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            codes = self.codes(w).tolist()
            at_code: dict[int, list[int]] = defaultdict(list)
            for p, c in enumerate(codes):
                at_code[c].append(p)
            self.positions.append(dict(at_code))
            for p in kept[k]:
                postings[codes[p]].append(k)
        self.sketch = np.array(sorted(postings), np.int64)
        self.owners = [postings[c] for c in self.sketch.tolist()]

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Shingles as numbers; -1 where a word is in no item. Texts of fewer words than a shingle count as one."""
        if len(w) < SHINGLE:
            return np.array([], np.int64)
        out = np.zeros(len(w) - SHINGLE + 1, np.int64)
        valid = np.ones(len(out), bool)
        for k in range(SHINGLE):
            part = w[k : len(w) - SHINGLE + 1 + k]
            out = out * self.base + part
            valid &= part >= 0
        return np.where(valid, out, -1)

    def search(self, text: str) -> list[tuple[int, float]]:
        """(item, share of its words) for each item the text gives away."""
        get = self.vocab.get
        w = np.array([get(x, -1) for x in words(text)], np.int64)
        codes = self.codes(w)
        seen = np.unique(codes)
        at = np.searchsorted(self.sketch, seen)
        at[at == len(self.sketch)] = 0
        hits = at[self.sketch[at] == seen] if len(self.sketch) and len(seen) else []
        found: Counter = Counter(k for h in hits for k in self.owners[h])
        out = []
        candidates = [k for k, n in found.items() if n >= self.need[k]]
        if candidates:
            places = [(q, c) for q, c in enumerate(codes.tolist()) if c >= 0]
            for k in candidates:
                share = self.contained(k, places, w)
                if share >= SHARE:
                    out.append((self.ids[k], share))
        return out

    def contained(self, k: int, places: list[tuple[int, int]], w: np.ndarray) -> float:
        """Share of an item's words that stand in running passages of a document."""
        at, item = self.positions[k], self.words[k]
        chains: list[list] = []  # first and last item position, last document position, matched positions, first document position
        live: list[list] = []  # those that a match at q can still go on from
        for q, c in places:
            if c in at:
                live = [chain for chain in live if q - chain[2] <= GAP + SHINGLE]
            for p in at.get(c, ()):
                best = None
                for chain in reversed(live):
                    dp, dq = p - chain[1], q - chain[2]
                    if 1 <= dp <= GAP + SHINGLE - 1 and 1 <= dq <= GAP + SHINGLE and abs(dp - dq) <= 2:
                        best = chain
                        break
                if best is None:
                    chains.append([p, p, q, {p, p + 1, p + 2}, q])
                    live.append(chains[-1])
                else:
                    best[1], best[2] = p, q
                    best[3].update((p, p + 1, p + 2))
        covered: set[int] = set()
        matched: set[int] = set()
        beside: set[int] = set()
        for chain in chains:
            first, last, q, hit = chain[:4]
            before, q0 = extended(item, w, first, chain[4], -1, hit)
            behind, q1 = extended(item, w, last + SHINGLE - 1, q + SHINGLE - 1, 1, hit)
            if behind + 1 - before >= PASSAGE_WORDS:
                covered.update(range(before, behind + 1))
                matched |= hit
                beside |= {p for p, q in ((before - 1, q0 - 1), (behind + 1, q1 + 1)) if 0 <= p < len(item) and 0 <= q < len(w)}
        own = [p for p in covered if self.own[k][p]]
        if not own or sum(p in matched for p in own) < OWN * len(own):
            return 0.0
        # Where words of the passages are changed, the first or last word of one may be, too, and then ends it.
        if len(covered) > len(matched):
            covered |= beside
        return len(covered) / len(item)


def extended(item: np.ndarray, doc: np.ndarray, p: int, q: int, way: int, matched: set[int]) -> tuple[int, int]:
    """Where a passage ends in the item and in the document if it goes on, word by word, past changed, left out or added single words."""
    m, n = len(item), len(doc)
    while True:
        for dp, dq in ((1, 1), (2, 2), (2, 1), (1, 2)):
            a, b = p + way * dp, q + way * dq
            if 0 <= a < m and 0 <= b < n and item[a] == doc[b]:
                p, q = a, b
                matched.add(p)
                break
        else:
            return p, q


FOUND = "doc_id bigint, eval_id bigint, share double"


def find_leaks(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, eval_id, share): documents that contain at least half of an item's words in running passages.

    Items are the stated query set: they are searched for in blocks of ``block_items``, each against all
    documents; what is an item's own is settled over all items before, so blocks change nothing. Null ids and
    null or empty texts give no row; of repeated rows with different texts the largest share holds. Items of
    fewer than SHINGLE words are never found, as a few words are no case.
    """
    spark = docs.sparkSession
    held = clashless(docs, ["doc_id", "text"]).where("doc_id is not null and text <> ''")
    queries = items.where("eval_id is not null and text is not null").select("eval_id", "text")
    known = materialize(queries.join(widely_held(queries), "eval_id"), "items")
    blocks = max(1, -(-known.count() // block_items))
    result = None
    for k in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(LeakIndex((r[0], r[1], r[2]) for r in block.collect()))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(i, e, s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e, s in index.value.search(t)]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "eval_id", "share"])

        found = spread(held).mapInArrow(search, FOUND)
        result = found if result is None else result.unionByName(found)
    return result.groupBy("doc_id", "eval_id").agg(F.max("share").alias("share"))
