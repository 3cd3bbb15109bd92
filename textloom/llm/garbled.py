"""Problem 3: text whose bytes were read in a wrong encoding.

A multinomial classifier over hashed byte bigrams, trained on synthetically garbled words, predicts the
exact chain of encodings of each word that holds more than ASCII; the chain is then inverted, the result
must decode strictly, and it must be more plausible than what stood there. What was lost for good
(replacement characters) is found, too, but not restored.

The bigrams are trained on the clean sentences alone, at most ``CLEAN_ROWS`` of them, garbled by every chain. The
word counts a judgement rests on are those of all lines: Spark counts them, and each line gets the counts that its
words may ask for by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.lookalikes import LOOKALIKES, look
from textloom.util import spread

#: Clean sentences that the classifier is trained on, at most; the table of them is fixed and far smaller.
CLEAN_ROWS = 20_000
#: Buckets of the hashed byte bigrams.
BUCKETS = 8192
#: Summed log-ratio of word counts from which single-byte encodings count as proven.
PROOF = 2.0
#: How much less likely than clean text, as a logarithm, the bigrams of a word with lost characters may be: the words it may have been decide then.
LOSSY_MARGIN = 6.0

#: Encodings in which text was written and read; a chain is write, read, write, read, ... and may end in lower-casing.
WRITTEN = ("cp1252", "cp1250", "cp1251", "koi8-r", "iso8859-2", "mac-roman", "cp437", "cp850", "cp866")
READ = ("latin-1", "cp1252", "cp1250", "cp1251", "mac-roman", "cp437", "cp850", "cp1254", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r", "cp866")
#: The first bytes of the letters and signs of the nine languages in UTF-8, read as latin-1.
LEADS = "ÂÃÄÅÐÑâ"

#: The letters beyond ASCII of the nine languages.
ALPHABET = set("äöüßàâæçéèêëîïôœùûÿáíóúñìòãõąćęłńśźżабвгдежзийклмнопрстуфхцчшщъыьэюяё")
#: Encodings in which letters, and not signs, stand where the second bytes of UTF-8 are.
CYRILLIC = ("iso8859-5", "koi8-r", "cp866")
UTF8 = [("utf-8", r) for r in READ]
CHAINS: list[tuple[str, ...]] = [
    *UTF8,
    *[(*a, *b) for a in UTF8[:2] for b in UTF8[:2]],
    *[(*a, *a) for a in UTF8[2:]],
    *[(*a, "lower") for a in UTF8[:4]],
    *[(*UTF8[a], *UTF8[a], "lower") for a in (0, 1)],
    *[(w, r) for w in WRITTEN for r in READ if w != r],
]

_RANK = {c: k for k, c in enumerate(CHAINS)}
SINGLE = [c for c in CHAINS if c[0] != "utf-8"]

_NON_ASCII = regex.compile(r"[^\x00-\x7f]+")
_NON_ASCII_ONE = regex.compile(r"[^\x00-\x7f]")
_CONTROL = regex.compile("[\x80-\x9f]")
_SPLIT = regex.compile(r"[ \n\t\r]+")
_DIGITS = regex.compile("[0-9]+")


def _read_table(encoding: str) -> list[str]:
    """Byte to character; bytes the encoding leaves open read as the control of the same number, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


READS = {e: _read_table(e) for e in {*READ, *WRITTEN}}
UNREADS = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in READS.items()}
for _e in ("cp1252", "cp1250", "cp1251", "cp1254"):
    for _b in range(0x80, 0xA0):
        UNREADS[_e].setdefault(chr(_b), _b)
UNLOWER: dict[str, dict[str, list[int]]] = {}
for _e, _t in READS.items():
    UNLOWER[_e] = defaultdict(list)
    for _b, _c in enumerate(_t):
        if _b >= 0x80 and len(_c.lower()) == 1:
            UNLOWER[_e][_c.lower()].append(_b)
    for _b in range(0x80, 0xA0):
        if _b not in UNLOWER[_e][chr(_b)] and _e in ("cp1252", "cp1250", "cp1251", "cp1254"):
            UNLOWER[_e][chr(_b)].append(_b)

#: Characters that may stand for the second or a later byte of a UTF-8 character, as read by each encoding, in any case.
_LATER = {e: frozenset(c for c, b in UNREADS[e].items() if 0x80 <= b < 0xC0) | frozenset(c for c, bs in UNLOWER[e].items() if any(0x80 <= b < 0xC0 for b in bs)) for e in READS}


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text as the chain garbles it, or None where its characters can't be written."""
    if chain in LOSSY:
        return LOSSY[chain](text)
    for k in range(0, len(chain) - 1, 2):
        try:
            raw = text.encode(chain[k])
        except UnicodeEncodeError:
            return None
        table = READS[chain[k + 1]]
        text = "".join([table[b] for b in raw])
    return text.lower() if len(chain) % 2 else text


#: Chains that lose characters for good: written as ASCII with question marks, read as UTF-8 with replacement
#: characters, and UTF-8 read as latin-1 without its controls, which often leaves only the first byte of a character.
LOSSY = {
    ("ascii", "?"): lambda text: _NON_ASCII_ONE.sub("?", text),
    ("utf-8", "\ufffd"): lambda text: _NON_ASCII_ONE.sub("\ufffd", text),
    ("utf-8", "latin-1", "without controls"): lambda text: _CONTROL.sub("", text.encode("utf-8", "surrogatepass").decode("latin-1")),
}
MARKED, REPLACED, STRIPPED = LOSSY


def _strict(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def _unlowered(run: str, encoding: str) -> str | None:
    """A lower-cased run as strict UTF-8: characters whose case is open take the first byte that can stand there."""
    options = UNLOWER[encoding]
    out, need = bytearray(), 0
    for c in run:
        if need:
            fits = [b for b in options.get(c, ()) if 0x80 <= b < 0xC0]
            need -= 1
        else:
            fits = [b for b in options.get(c, ()) if b >= 0xC2 and b < 0xF5]
            # Between the lead bytes of a character and its lower-case form, those of the nine alphabets come first.
            fits.sort(key=lambda b: b not in (0xC2, 0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xE2))
            need = (1 if fits[0] < 0xE0 else 2 if fits[0] < 0xF0 else 3) if fits else 0
        if not fits:
            return None
        out.append(fits[0])
    return _strict(bytes(out), "utf-8") if not need else None


class _Back(dict):
    """What each character read in one single-byte encoding was in the other it was written in, for str.translate; a NUL where it can't be."""

    def __init__(self, written: str, read: str):
        super().__init__({k: chr(k) for k in range(128)})
        for c, b in UNREADS[read].items():
            if ord(c) > 127 and (before := _strict(bytes([b]), written)) is not None:
                self[ord(c)] = before

    def __missing__(self, code: int) -> str:
        return "\0"


_back_table = lru_cache(None)(_Back)


def ungarble(word: str, chain: tuple[str, ...]) -> str | None:
    """The word before the chain, strictly decoded; None if the chain can't have made it.

    Of a chain with UTF-8, runs that don't decode are left as they stand if another one does, so that a
    word joined from a garbled and an intended part is still restored.
    """
    if len(chain) == 2 and chain[0] != "utf-8":
        if word.isascii():
            return None
        before = word.translate(_back_table(*chain))
        return None if "\0" in before else before
    steps = list(chain)
    if chain[0] == "utf-8" and _LATER[chain[-2] if len(chain) % 2 else chain[-1]].isdisjoint(word):
        return None
    lowered = len(steps) % 2 == 1
    if lowered:
        steps.pop()
    while steps:
        read, written = steps.pop(), steps.pop()
        table, hits = UNREADS[read], 0

        def back(m: regex.Match, read: str = read, written: str = written, table: dict = table, low: bool = lowered) -> str:
            nonlocal hits
            run = m.group()
            if written == "utf-8":
                # An intended letter next to a garbled stretch is none the table can have made.
                parts = ["".join(p) for _, p in groupby(run, key=(UNLOWER[read] if low else table).__contains__)]
                back_to = [_unlowered(p, read) if low else _strict(bytes(table[c] for c in p), "utf-8") if p[0] in table else None for p in parts]
                new = "".join(p if b is None else b for p, b in zip(parts, back_to, strict=True)) if any(b is not None for b in back_to) else None
            else:
                new = None if any(c not in table for c in run) else _strict(bytes(table[c] for c in run), written)
            if new is None:
                return run
            hits += 1
            return new

        after = _NON_ASCII.sub(back, word)
        if not hits or (written != "utf-8" and hits < len(_NON_ASCII.findall(word))):
            return None
        word, lowered = after, False
    return word


def features(word: str, marks: bool = False) -> list[int]:
    """Hashed byte bigrams of a word, framed by spaces. Of ASCII-only bigrams those with a question mark may tell of lost characters, if wanted; others say nothing of an encoding."""
    raw = f" {word} ".encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw[k : k + 2]) % BUCKETS for k in range(len(raw) - 1) if raw[k] > 127 or raw[k + 1] > 127 or (marks and 63 in raw[k : k + 2])]


def usual(word: str) -> bool:
    """Whether a word has letters of the nine languages only, and not of two alphabets."""
    letters = [c for c in word.lower() if c.isalpha()]
    cyrillic = sum("\u0400" <= c < "\u0530" for c in letters)
    return cyrillic in (0, len(letters)) and all(c.isascii() or c in ALPHABET for c in letters)


def words_of(text: str) -> list[str]:
    return _SPLIT.split(text)


def _disguises(word: str) -> Iterator[str]:
    """Odd but intended spellings of a word, which belong to the clean class."""
    import unicodedata

    yield unicodedata.normalize("NFD", word)
    back = {v: k for k, v in reversed(LOOKALIKES.items())}
    yield "".join(back.get(c, c) for c in word)
    yield "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in word)
    for sign in " ­​‍⁠﻿ ":
        yield word[: len(word) // 2] + sign + word[len(word) // 2 :]


@dataclass
class GarbleModel:
    """Multinomial naive Bayes over hashed byte bigrams, one class per chain and one for clean text."""

    table: np.ndarray | None = None
    chains: list[tuple[str, ...] | None] = field(default_factory=list)
    letters: set[str] = field(default_factory=set)
    # How often words were seen, by their core.
    cores: Counter = field(default_factory=Counter)
    # Words with question marks kept, and the same with every non-ASCII character as a question mark.
    marked: Counter = field(default_factory=Counter)
    lossy: Counter = field(default_factory=Counter)

    @classmethod
    def train(cls, clean: Iterable[str], seen: Iterable[str] = ()) -> GarbleModel:
        """The classifier from clean sentences, garbled by every chain. The words of these and of further texts are counted."""
        model = cls()
        good: Counter = Counter()
        for text in clean:
            good.update(words_of(text))
            good.update(words_of(text.upper()))
        counted = good + Counter(w for text in seen for w in words_of(text) if "\ufffd" not in w)
        common = "–—‘’“”„«»…€£©®°±²³½¼¾№™·§ØøÐðµ¿¡×"
        model.letters = {c for w in good for c in w if ord(c) > 127} | set(common)
        # Letters of Western and Central European languages and of Russian.
        model.letters |= {chr(k) for k in (*range(0xC0, 0x180), *range(0x410, 0x450), 0x401, 0x451) if chr(k).isalpha()}
        model.letters |= {x for c in model.letters for x in (c.lower(), c.upper()) if len(x) == 1}
        sources = Counter({w: min(n, 5) for w, n in good.items() if not w.isascii()})
        for sign in common:
            for w in (sign, f"{sign}12", f"12{sign}C", f"a{sign}b", f"({sign}5)"):
                sources[w] += 1
        counts = [np.full(BUCKETS, 0.05)]
        for w, n in (*sources.items(), *((w, min(n, 5)) for w, n in good.items() if w.isascii() and "?" in w)):
            for f in features(w, marks=True):
                counts[0][f] += n
        for w in list(good)[:4000]:
            for d in _disguises(w):
                for f in features(d):
                    counts[0][f] += 0.2
        model.chains = [None]
        for chain in (*CHAINS, *LOSSY):
            c = np.full(BUCKETS, 0.05)
            made = 0
            for w, n in sources.items():
                g = garble(w, chain)
                if g is not None and g != w:
                    made += 1
                    for f in features(g, marks=chain == MARKED):
                        c[f] += n
            if made:
                counts.append(c)
                model.chains.append(chain)
        stacked = np.stack(counts)
        model.table = np.log(stacked / stacked.sum(axis=1, keepdims=True)).astype(np.float32)
        for w, n in counted.items():
            for key in counted_as(w):
                model.counts_of(key)[key[1:]] += n
        return model

    def counts_of(self, key: str) -> Counter:
        """The counts a key of counted_as() belongs to."""
        return {"c": self.cores, "m": self.marked, "l": self.lossy}[key[0]]

    def seen_as(self, word: str) -> int:
        """How often a word was seen, whatever punctuation stands around it, in whatever case and with whatever digits."""
        return self.cores[core(word)]

    def disguised(self, word: str, n: int) -> bool:
        """Whether a word is spelt with other characters but looks like a known one, and what it may have been, seen n times, is not far more common."""
        return (shown := look(word)) != word and n < 30 * self.seen_as(shown)

    def lossy_class(self, word: str) -> tuple[str, ...] | None:
        """The lossy chain that the classifier takes a word for rather than for clean text; None if for none that can have made it."""
        if "\ufffd" in word:
            able = REPLACED
        elif "?" in word:
            able = MARKED
        elif not word.isascii() and all(c.isascii() or c in LEADS for c in word):
            able = STRIPPED
        else:
            return None
        if able not in self.chains:
            return None
        scores = self.table[[0, self.chains.index(able)]][:, features(word, marks=True)].sum(axis=1)
        return able if scores[1] > scores[0] - LOSSY_MARGIN else None

    def lost_evidence(self, text: str) -> float:
        """Evidence that characters of a text are lost: that they were replaced, or that only the first byte of each is left.

        The classifier picks the words; a replacement character proves itself. Any other word counts by how much more
        common the words are that would look like it with their non-ASCII characters lost than the word as it
        stands. A question mark that ends a known word may be one, and so may one that stands alone, unless the
        sentence goes on in lower case.
        """
        words = _TOKEN.findall(text)
        shouted = text.upper() == text
        total = 0.0
        for w in dict.fromkeys(words):
            chain = self.lossy_class(w)
            if chain == REPLACED:
                total += PROOF
            if chain not in (MARKED, STRIPPED):
                continue
            key = marked_core(w)
            if chain == STRIPPED and sum(c.isascii() and c.isalpha() for c in w) < 2:
                continue
            if key == "?":
                at = words.index(w)
                behind = words[at + 1] if at + 1 < len(words) else ""
                if not behind[:1].isalpha() or not (behind[0].islower() or shouted and at):
                    continue
            literal = self.marked[key]
            n = self.lossy[_NON_ASCII_ONE.sub("?", key)] - literal
            if key != "?" and "?" not in (bare := key.rstrip("?")):
                # A core's count holds that of the word with its question marks. In a large table first bytes alone are met often, too.
                known = self.cores[bare] - (literal if bare != key else 0)
                if known >= 3 and (bare != key or n < 30 * (known + 1)):
                    continue
            if n >= 3 and not self.disguised(w, n):
                total += max(0.0, float(np.log((n + 0.5) / (literal + 1.0))))
        return total

    def likelihoods(self, word: str) -> dict[tuple[str, ...], float]:
        """The classifier's log-likelihood of a word by each chain."""
        scores = self.table[:, features(word)].sum(axis=1)
        return {c: float(x) for c, x in zip(self.chains, scores, strict=True) if c is not None}

    def candidates(self, word: str) -> Iterator[tuple[tuple[str, ...], str]]:
        """The chains that can have garbled a word, each with the word before it, in the order of their likelihood."""
        scores = self.table[:, features(word)].sum(axis=1)
        # A character of UTF-8 is garbled into two at least.
        single = all(len(run) == 1 for run in _NON_ASCII.findall(word))
        for k in np.argsort(-scores):
            chain = self.chains[k]
            if chain is None or chain in LOSSY:
                continue
            if single if chain[0] == "utf-8" else scores[k] < scores[0]:
                continue
            before = ungarble(word, chain)
            if before is not None and before != word and self.plausible(before, word):
                yield chain, before

    def plausible(self, before: str, word: str) -> bool:
        """Whether what a chain makes anew of a word is characters of the known languages."""
        return not any(ord(c) > 127 and c not in self.letters for c in set(before) - set(word))

    def asked(self, word: str) -> set[str]:
        """Keys of the counts that judging and restoring a word may ask for, whatever the counts are."""
        out = set()
        if self.lossy_class(word) in (MARKED, STRIPPED):
            key = marked_core(word)
            out |= {f"m{key}", f"l{_NON_ASCII_ONE.sub('?', key)}", f"c{key.rstrip('?')}"}
        return out if word.isascii() else out | {f"c{c}" for c in self._cores_asked(word)}

    def _cores_asked(self, word: str) -> set[str]:
        out = {core(word), core(look(word))}
        for chain, before in self.candidates(word):
            out.add(core(before))
            if chain[0] == "utf-8":
                if not before.isascii():
                    out |= self._cores_asked(before)
                if not needs_count(chain) and usual(before):
                    return out
        if look(word) == word or _CONTROL.search(word) or not usual(word):
            # What a text's other words prove is tried on this one, too.
            for chain in SINGLE:
                before = ungarble(word, chain)
                if before is not None and self.plausible(before, word):
                    out.add(core(before))
        return out

    def judge(self, word: str) -> Verdict:
        """What chains may have garbled a word.

        Chains are tried in the order of their likelihood. Strict UTF-8 that gives nothing but characters
        of the known languages is proof, first that which gives letters of the nine. Of single-byte encodings, where almost anything decodes, each
        possible chain is kept with its evidence: how much more common the word before is than what
        stands there. A word that looks like a known one is intended.
        """
        open_chains = {}
        rare = None
        known = self.seen_as(word)
        for chain, before in self.candidates(word):
            n = self.seen_as(before)
            if chain[0] == "utf-8":
                if needs_count(chain) and (n < 3 or self.disguised(word, n)):
                    continue
                again = self.judge(before) if not before.isascii() else None
                found = Verdict(again.chain + chain, again.before) if again and again.chain else Verdict(chain, before)
                if usual(found.before):
                    return found
                rare = rare or found
                continue
            # A single letter is evidence only if it is far more common; a single sign never is.
            tells = len(core(before)) >= 2 or (core(word).isalpha() and core(before).isalpha() and n >= 30 * (known + 1))
            evidence = np.log((n + 0.5) / (known + 1.0)) if n and tells and not self.disguised(word, n) else 0.0
            open_chains[chain] = (before, max(0.0, float(evidence)), n, not usual(before))
        return rare or Verdict(None, None, open_chains)


@dataclass
class Verdict:
    """The proven chain and the word before it; else the open chains, each with the word before, its evidence and count, and whether it is no usual word."""

    chain: tuple[str, ...] | None
    before: str | None
    open: dict[tuple[str, ...], tuple[str, float, int, bool]] = field(default_factory=dict)


class Repairer:
    """Finds and repairs garbled words in whole texts; remembers up to ``keep`` words."""

    def __init__(self, model: GarbleModel, keep: int = 200_000):
        self.model, self.known, self.keep = model, {}, keep

    def word(self, w: str) -> Verdict:
        if (hit := self.known.get(w)) is None:
            hit = self.model.judge(w)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[w] = hit
        return hit

    def by_controls(self, words: list[str]) -> tuple[str, ...] | None:
        """The single-byte chain that makes the most common words of all words with controls, of those the classifier prefers to clean text for each; then the likeliest. If none fits all words, the usual one; none if the classifier prefers none."""
        fits: dict[tuple[str, ...], list[float]] = {}
        for w in words:
            of = self.model.likelihoods(w)
            for chain, before in self.model.candidates(w):
                if chain[0] != "utf-8":
                    fit = fits.setdefault(chain, [0, 0.0, 0.0])
                    fit[0] += 1
                    fit[1] += float(np.log(self.model.seen_as(before) + 0.5))
                    fit[2] += of[chain]
        whole = {c: (round(f[1], 6), c == ("cp1252", "latin-1"), f[2]) for c, f in fits.items() if f[0] == len(words)}
        return max(whole, key=whole.get) if whole else ("cp1252", "latin-1") if fits else None

    def __call__(self, text: str) -> tuple[bool, str, str | None, bool]:
        """(garbled, restored text, chain or None, lost): lost if characters are gone for good.

        The evidence for a single-byte chain adds up over the words of a text and proves it from
        ``PROOF`` on; words that prove nothing by themselves are then restored by it, too.
        """
        if text.isascii():
            lost = "?" in text and self.model.lost_evidence(text) >= PROOF
            return lost, text, None, lost
        proven: Counter = Counter()
        evidence: Counter = Counter()
        best: Counter = Counter()
        odd: Counter = Counter()
        for w in {w for w in _TOKEN.findall(text) if not w.isascii()}:
            verdict = self.word(w)
            if verdict.chain:
                proven[verdict.chain] += 1
            for chain, (_before, e, n, strange) in verdict.open.items():
                odd[chain] += strange
                if e > 0:
                    evidence[chain] += e
                    best[chain] = max(best[chain], n)
        # Of encodings that agree on all words that tell, the one that makes usual words of the others counts, then the more usual one.
        likely = max(evidence, key=lambda c: (round(evidence[c], 6), -odd[c], -_RANK[c])) if evidence else None
        single = likely if likely and evidence[likely] >= PROOF and best[likely] >= 3 else None
        # Nobody writes controls of the upper half. If nothing else proves a chain, the one that makes the most common words is taken.
        if single is None and not proven and _CONTROL.search(text):
            single = self.by_controls([w for w in _TOKEN.findall(text) if _CONTROL.search(w)])
        if not proven and single is None:
            lost = _SUSPECT.search(text) is not None and self.model.lost_evidence(text) >= PROOF
            return lost, text, None, lost

        def fix(m: regex.Match) -> str:
            w = m.group()
            if w.isascii():
                return w
            verdict = self.word(w)
            if verdict.chain:
                return verdict.before
            hit = verdict.open.get(single)
            if hit and hit[1] > 0:
                return hit[0]
            # A word that is no evidence is restored along with the others, unless it hides something on purpose and is not known otherwise.
            before = ungarble(w, single) if single else None
            if before is not None and look(w) != w and (usual(w) or not usual(before) or not self.model.seen_as(before)):
                return w
            if before is None or any(ord(c) > 127 and c not in self.model.letters for c in set(before) - set(w)):
                return w
            kept = len(core(w)) > 1 and self.model.seen_as(w) > self.model.seen_as(before)
            return w if kept else before

        main = min(proven, key=lambda c: (-proven[c], c)) if proven else single
        # Beside characters that were restored only replacement characters are sure to be lost.
        return True, _TOKEN.sub(fix, text), ">".join(main), "\ufffd" in text and any(self.model.lossy_class(w) == REPLACED for w in _TOKEN.findall(text))


_SUSPECT = regex.compile(f"[?\ufffd{LEADS}]")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def marked_core(word: str) -> str:
    """A word as core() has it, but with its question marks."""
    return _DIGITS.sub("0", word.strip(_PUNCTUATION.replace("?", "")).lower())


def needs_count(chain: tuple[str, ...]) -> bool:
    """Whether a chain of UTF-8 is proven only by a known word, as Cyrillic look-alikes in Latin words decode by it, too."""
    return chain[-2:] == ("cp1251", "lower") or chain[1] in CYRILLIC


def counted_as(word: str) -> list[str]:
    """Keys a word counts for: c and its core, and if characters of it are or may be lost, m and l with its marked core and that without them."""
    marked = marked_core(word)
    lossy = _NON_ASCII_ONE.sub("?", marked)
    return [f"c{c}" for c in (core(word),) if c] + ([f"m{marked}", f"l{lossy}"] if "?" in lossy else [])


@lru_cache(1 << 16)
def core(word: str) -> str:
    """A word without the ASCII punctuation around it, in lower case, all digits alike."""
    return _DIGITS.sub("0", word.strip(_PUNCTUATION).lower())


_TOKEN = regex.compile(r"[^ \n\t\r]+")


def train_garble_model(clean: DataFrame, rows: int = CLEAN_ROWS) -> GarbleModel:
    """The classifier, from at most ``rows`` sentences known to be clean (a fixed table, column ``text``)."""
    return GarbleModel.train(r[0] for r in clean.where("text is not null").select("text").limit(rows).collect())


REPAIRED = "line_id bigint, text string, restored string, chain string, lost boolean"
#: What separates words, as in words_of().
_BETWEEN = "[ \n\t\r]+"
#: An ASCII word or text without a question mark can't have been garbled; the JVM drops it before Python sees it.
_OPEN = "(octet_length({0}) > char_length({0}) or contains({0}, '?'))"


def word_counts(lines: DataFrame, clean: DataFrame) -> DataFrame:
    """(key, n): how often the words of all lines, and of the clean sentences as they stand and in capitals, count for each key of counted_as()."""
    texts = lines.select("text").union(clean.select("text")).union(clean.select(F.upper("text")))
    words = texts.select(F.explode(F.split("text", _BETWEEN)).alias("word")).where("word <> '' and not contains(word, '\ufffd')")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in counted_as(w)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["key", "n"])

    counted = words.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(keys, "key string, n bigint")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def repair_lines(lines: DataFrame, clean: DataFrame, model: GarbleModel | None = None) -> DataFrame:
    """(line_id, text, restored, chain, lost): one row for each line with garbled text.

    ``restored`` is the text as first written, as far as it can be had; where characters are lost for
    good ``lost`` is true, and they stay replacement characters or question marks. Null texts, empty ones and ASCII
    without question marks are clean. Lines delivered twice come out once per different text. Words are counted
    over all of ``lines``; of a given ``model`` only bigrams and letters are used.
    """
    spark = lines.sparkSession
    model = model or train_garble_model(clean)
    held = spark.sparkContext.broadcast(GarbleModel(model.table, model.chains, letters=model.letters))
    given = lines.where(f"text is not null and {_OPEN.format('text')}").select("line_id", "text")
    # Texts are told apart by a hash; those that share one get the counts for the words of both.
    given = spread(given).distinct().withColumn("h", F.xxhash64("text"))
    words = given.select("h", F.explode(F.array_distinct(F.split("text", _BETWEEN))).alias("word")).where(_OPEN.format("word"))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, k) for w in batch.column(0).to_pylist() for k in held.value.asked(w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([k for _, k in out], pa.string())], ["word", "key"])

    # Distinct words are few bytes but much work, so they are dealt to all cores.
    asked = words.select("word").distinct().repartition(spark.sparkContext.defaultParallelism).mapInArrow(asks, "word string, key string")
    # Neither words nor keys hold tabs or line ends.
    known = asked.join(word_counts(lines, clean), "key").groupBy("word").agg(F.array_join(F.collect_list(F.concat_ws("\t", "key", "n")), "\n").alias("counts"))
    counts = words.join(known, "word").groupBy("h").agg(F.collect_set("counts").alias("counts"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps what was broadcast, so each task counts in a model of its own.
        model = GarbleModel(held.value.table, held.value.chains, letters=held.value.letters)
        fix, loaded = Repairer(model), set()
        for batch in batches:
            out = []
            for i, t, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(model.cores) >= fix.keep:
                    for c in (loaded, model.cores, model.marked, model.lossy):
                        c.clear()
                for entries in counts or ():
                    if entries not in loaded:
                        loaded.add(entries)
                        for entry in entries.split("\n"):
                            key, n = entry.split("\t")
                            model.counts_of(key)[key[1:]] = int(n)
                garbled, restored, chain, lost = fix(t)
                if garbled:
                    out.append((i, t, restored, chain, lost))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["line_id", "text", "restored", "chain", "lost"])

    return given.join(counts, "h", "left").select("line_id", "text", "counts").mapInArrow(repair, REPAIRED)
