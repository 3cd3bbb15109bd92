"""Problem 2: one form for text that looks the same on screen but differs in its code points.

Letter runs of a value traverse a trie of the vocabulary's spellings with a weighted edit automaton that
reads the code points as they stand: an arc is crossed at no cost by every code point of the same look, a
composed letter or a ligature crosses several arcs at once, and characters that show nothing stay where they
are. The canonical spelling is the vocabulary's. Runs the trie does not accept, and everything between runs,
are normalized by table. Within a cost of zero the automaton accepts exactly the spellings of one look, so
values come out equal if and only if they look the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.util import materialize, spread

#: Letters of other alphabets and the Latin letters of the same shape.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ο": "o", "ν": "v", "ϳ": "j",
    # Other signs of the same shape as a letter
    "µ": "μ", "ɑ": "a", "ɡ": "g",
}

#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣－"

#: Ranges whose compatibility form is the same sign in another width or a joined letter.
SAME_SIGN = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x01C4, 0x01C6), (0x212A, 0x212B), (0x2126, 0x2126))

_RUN = regex.compile(r"[\p{L}\p{M}\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️]+")
_PLAIN = regex.compile(r"[\x20-\x7e\n\t\r]*")
_ZERO = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️]")


def _one(c: str) -> str:
    """What a single code point looks like, as decomposed Latin-preferring characters; empty if it shows nothing."""
    if _ZERO.fullmatch(c):
        return ""
    if any(lo <= ord(c) <= hi for lo, hi in SAME_SIGN):
        c = unicodedata.normalize("NFKC", c)
    out = []
    for x in unicodedata.normalize("NFD", c):
        if unicodedata.category(x) == "Zs":
            x = " "
        out.append("-" if x in HYPHENS else LOOKALIKES.get(x, x))
    return "".join(out)


class _Looks(dict):
    """Table of the looks of code points, filled on demand, for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = _one(chr(code))
        return self[code]


_LOOKS = _Looks()


def look(text: str) -> str:
    """The looks of a text: equal for two texts if and only if they look the same."""
    # NFD also puts several accents of one letter into their fixed order.
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_LOOKS)))


def _table_form(shown: str) -> str:
    """Spelling of a letter run that no vocabulary holds; a function of its looks alone.

    A run with a letter only Cyrillic has is spelt in Cyrillic throughout, any other stays as its looks.
    """
    if any("Ѐ" <= c <= "ӿ" for c in shown):
        return unicodedata.normalize("NFC", "".join(_CYRILLIC.get(c, c) for c in unicodedata.normalize("NFD", shown)))
    return shown


_CYRILLIC = {latin: c for c, latin in reversed(LOOKALIKES.items()) if "Ѐ" <= c <= "ӿ" and c not in "ҮүӀӏԚԛԜԝԁһ"}


def _letters(run: str) -> Iterator[str]:
    """The letters of a run, each with the marks and the characters that show nothing behind it."""
    at = 0
    for k in range(1, len(run)):
        if not (unicodedata.combining(run[k]) or _LOOKS[ord(run[k])] == ""):
            yield run[at:k]
            at = k
    if run:
        yield run[at:]


class SpellingTrie:
    """Trie of canonical spellings, searched with a weighted edit automaton over the code points of a text.

    Arcs hold the decomposed characters of the spellings. Reading a code point costs nothing if it is the
    arc's, or looks like it (unless ``alike`` is false); one that looks like several characters, such as a
    composed letter or a ligature, crosses as many arcs. Reading one that shows nothing costs nothing and
    crosses none. Another character in the place of an arc's, one too many and one left out cost ``other``
    each. With the default budget of zero a spelling is accepted if and only if it looks like the text read.
    Among several accepted ones the cheapest is taken, then the one equal to its own looks, then the first in
    code point order.
    """

    def __init__(self, spellings: Iterable[str], budget: float = 0.0, other: float = 1.0, alike: bool = True):
        #: For each node its children by the arc's character, and the same by the looks of that character.
        self.arcs: list[dict[str, int]] = [{}]
        self.crossed: list[dict[str, list[int]]] = [{}]
        self.final: dict[int, int] = {}
        self.budget, self.other, self.alike = budget, other, alike
        self.words = sorted(set(spellings), key=lambda w: (look(w) != w, w))
        for k, word in enumerate(self.words):
            node = 0
            for c in unicodedata.normalize("NFD", word):
                for part in self._read(c):
                    label = c if len(self._read(c)) == 1 else part
                    if (to := self.arcs[node].get(label)) is None:
                        to = self.arcs[node][label] = len(self.arcs)
                        self.arcs.append({})
                        self.crossed.append({})
                        self.crossed[node].setdefault(part, []).append(to)
                    node = to
            self.final.setdefault(node, k)

    def _read(self, c: str) -> str:
        """The characters whose arcs a code point crosses at no cost, one after the other."""
        return _LOOKS[ord(c)] if self.alike else unicodedata.normalize("NFD", c)

    def find(self, run: str) -> str | None:
        """The canonical spelling of a run, or None."""
        states = self._left_out({0: 0.0})
        for letter in _letters(run):
            read = "".join(map(self._read, letter))
            # Several marks of a letter are read in their fixed order, whichever way they stand.
            for part in unicodedata.normalize("NFD", read) if len(letter) > 1 else read:
                reached: dict[int, float] = {}
                for node, cost in states.items():
                    for to in self.crossed[node].get(part, ()):
                        reached[to] = min(cost, reached.get(to, cost))
                    if cost + self.other <= self.budget:
                        for to in (node, *self.arcs[node].values()):
                            reached[to] = min(cost + self.other, reached.get(to, cost + self.other))
                if not reached:
                    return None
                states = self._left_out(reached)
        ends = [(cost, self.final[n]) for n, cost in states.items() if n in self.final]
        return self.words[min(ends)[1]] if ends else None

    def _left_out(self, states: dict[int, float]) -> dict[int, float]:
        """States with those reached by leaving out characters of a spelling."""
        open_states = [n for n, cost in states.items() if cost + self.other <= self.budget]
        while open_states:
            node = open_states.pop()
            cost = states[node] + self.other
            for to in self.arcs[node].values():
                if cost < states.get(to, 1e9):
                    states[to] = cost
                    if cost + self.other <= self.budget:
                        open_states.append(to)
        return states


class Canonicalizer:
    """Canonical form of whole texts; remembers the runs it has met, up to ``keep`` of them."""

    def __init__(self, spellings: Iterable[str], keep: int = 200_000):
        self.trie, self.known, self.keep = SpellingTrie(spellings), {}, keep

    def run(self, text: str) -> str:
        if (out := self.known.get(text)) is None:
            out = self.trie.find(text)
            if out is None:
                out = _table_form(look(text))
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[text] = out
        return out

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for m in _RUN.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()] if _PLAIN.fullmatch(text, at, m.start()) else look(text[at : m.start()]))
            out.append(self.run(m.group()))
            at = m.end()
        if at < len(text):
            out.append(look(text[at:]))
        return unicodedata.normalize("NFC", "".join(out))


def spellings_of(vocab: DataFrame, max_pieces: int = 100_000) -> list[str]:
    """The words among a vocabulary's pieces. A vocabulary is bounded; more than ``max_pieces`` is an error."""
    pieces = [r[0] for r in vocab.where("piece is not null").select(F.trim("piece")).limit(max_pieces + 1).collect()]
    if len(pieces) > max_pieces:
        raise ValueError(f"the vocabulary has more than {max_pieces} pieces")
    return sorted({p for p in pieces if len(p) > 1 and p.isalpha()})


def canonical_form(df: DataFrame, text: str | Column, vocab: DataFrame, into: str = "canonical") -> DataFrame:
    """Adds the canonical form of a text column. Null stays null, an empty text and one of nothing but
    characters that show nothing give an empty text; repeated rows are kept."""
    known = df.sparkSession.sparkContext.broadcast(spellings_of(vocab))

    def canonical(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        form = Canonicalizer(known.value)
        for part in texts:
            yield pa.array([None if t is None else form(t) for t in part.to_pylist()], pa.string())

    from pyspark.sql.functions import arrow_udf

    def arrow_canonical(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from canonical(texts)

    arrow_canonical.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(into, arrow_udf(arrow_canonical, "string")(text))


#: Rows of one spelling that meet in one task; spellings with more are dealt out. Parts into which the values of every class are dealt before they are filtered.
PART_ROWS, PARTS = 2_000, 16


def _alike(values: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, look, raw, id) of the values whose look has several spellings, each once, and (kind, look, raw, n) with their number.

    Looks and spellings are told apart by two independent 64-bit hashes of the canonical form and of the code
    points. Sizes are aggregated before anything is joined, and the values of a class are dealt to PARTS tasks,
    so a class of exact copies, be it a third of all rows, costs one row in the join and is filtered by many tasks.
    """
    given = values.where("kind is not null and id is not null and value is not null").select("kind", "id", "value")
    forms = canonical_form(spread(given), F.col("value"), vocab)
    two = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))
    held = materialize(forms.select("kind", "id", two("canonical").alias("look"), two("value").alias("raw")), "looks")
    several = held.groupBy("kind", "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("kind", "look")
    dealt = several.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    inside = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(dealt, ["kind", "look", "part"]).drop("part")
    ids = materialize(inside.distinct(), "alike")
    return ids, ids.groupBy("kind", "look", "raw").agg(F.count("*").alias("n"))


def lookalike_classes(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kind, id, class_id, n_spellings, n_links): one row for each value whose look has another spelling.

    ``class_id`` names the look within its kind; ``n_spellings`` counts the spellings of the look and
    ``n_links`` the values of the class that are spelt otherwise. This is the form that grows with the values
    and not with their pairs. Null kinds, ids and values give no row, repeated rows one.
    """
    ids, sizes = _alike(values, vocab)
    of = sizes.groupBy("kind", "look").agg(F.sum("n").alias("total"), F.count("*").alias("n_spellings"))
    per = sizes.join(of, ["kind", "look"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    each = ids.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(per, ["kind", "look", "raw", "part"])
    name = F.format_string("%016x%016x", "look.a", "look.b")
    return each.select("kind", "id", name.alias("class_id"), "n_spellings", (F.col("total") - F.col("n")).alias("n_links"))


def lookalike_pairs(values: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kind, id_lo, id_hi): ids whose values look the same but differ in code points; see lookalike_classes for a form without pairs.

    Null kinds, ids and values give no pair; repeated rows and several equal values of an id give a pair once.
    Distinct spellings are paired before their ids are, and both sides of two common spellings are dealt out, so
    no task meets more than PART_ROWS values of each.
    """
    ids, sizes = _alike(values, vocab)
    parts = sizes.withColumn("n", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    other = parts.select("kind", "look", F.col("raw").alias("raw2"), F.col("n").alias("n2"))
    pairs = parts.join(other, ["kind", "look"]).where("raw < raw2")
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")).select("*", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("part2"))
    dealt = ids.join(parts, ["kind", "look", "raw"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    both = pairs.join(dealt, ["kind", "look", "raw", "part"])
    both = both.join(dealt.select("kind", "look", F.col("raw").alias("raw2"), F.col("id").alias("id2"), F.col("part").alias("part2")), ["kind", "look", "raw2", "part2"])
    return both.where("id <> id2").select("kind", F.least("id", "id2").alias("id_lo"), F.greatest("id", "id2").alias("id_hi")).distinct()
