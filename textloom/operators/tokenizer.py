"""Tokenizers as immutable specifications, and encoding and decoding of DataFrames with them.

A specification holds vocabulary, merges, specials and behaviour flags. Encoding runs in Arrow batches
with a cache of words per worker: most words of a batch are met again, so the merge loop runs once per
different word, and no words are shuffled.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textloom.functions.splitting import LINE, PATTERN, PLAIN_PATTERN, pattern_with
from textloom.functions.text import byte_characters

#: Folder of public tokenizer files; a parameter wherever a published vocabulary is loaded.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")

_BYTE_PIECE = regex.compile(r"0x([0-9a-fA-F]{2})")


@dataclass(frozen=True)
class TokenizerSpec:
    """Everything that defines a tokenizer. ``vocab`` maps pieces to ids, ``merges`` are in order of rank."""

    name: str
    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...] = ()
    specials: tuple[str, ...] = ()
    pattern: str = PATTERN
    byte_level: bool = True
    normalizer: dict[str, str] = field(default_factory=dict)
    lower_case: bool = False
    prefix_space: bool = True
    lead_space: bool = False
    end_of_word: str = ""
    punctuation: tuple[str, ...] = ()
    ignore_merges: bool = False
    newline_separator: bool = False
    bos: str | None = None
    eos: str | None = None
    pad: str | None = None
    add_bos: bool = False
    add_eos: bool = False
    cross_word: bool = True

    @cached_property
    def byte_fallback(self) -> dict[int, int]:
        """Byte to id for vocabularies with ``0xNN`` pieces."""
        return {int(m[1], 16): i for p, i in self.vocab.items() if (m := _BYTE_PIECE.fullmatch(p))}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(self.merges):
            out.setdefault(pair, k)
        return out

    @cached_property
    def id_merges(self) -> dict[tuple[int, int], int]:
        """Pairs of ids to the id they merge into; merges of which a piece is in no vocabulary are left out."""
        v = self.vocab
        return {(v[a], v[b]): v[a + b] for a, b in self.merges if a in v and b in v and a + b in v}

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """Id to bytes."""
        back = {c: b for b, c in enumerate(byte_characters())}
        out = {}
        for p, i in self.vocab.items():
            if p in self.specials:
                out[i] = p.encode()
            elif m := _BYTE_PIECE.fullmatch(p):
                out[i] = bytes([int(m[1], 16)])
            elif self.byte_level and all(c in back for c in p):
                out[i] = bytes(back[c] for c in p)
            else:
                out[i] = p.encode()
        return out

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    @property
    def wide(self) -> bool:
        """Whether ids need 32 bits in token files."""
        return self.vocab_size > 65_536

    @property
    def pad_token(self) -> int:
        """The pad named; else a special that names padding; else the largest id of the token width."""
        for p in ([self.pad] if self.pad else []) + [s for s in self.specials if "pad" in s.lower()]:
            if p in self.vocab:
                return self.vocab[p]
        return 0xFFFFFFFF if self.wide else 0xFFFF

    def token(self, piece: str) -> int | None:
        return self.vocab.get(piece)

    def single_token(self, text: str) -> int:
        """The id of a piece, or of a text that encodes to one token, bos and eos aside; ValueError if it does not.

        The two characters ``\\n`` stand for a newline.
        """
        text = text.replace("\\n", "\n")
        if (known := self.vocab.get(text)) is not None:
            return known
        got = replace(self, add_bos=False, add_eos=False).encoder()(text)
        if len(got) != 1:
            raise ValueError(f"{text!r} is {len(got)} tokens, not one")
        return got[0]

    def without(self, excluded: Iterable[str]) -> TokenizerSpec:
        """The tokenizer without some pieces, the merges that make them or use them, and the specials of that name."""
        gone = set(excluded)
        merges = tuple(m for m in self.merges if m[0] + m[1] not in gone and m[0] not in gone and m[1] not in gone)
        return replace(self, vocab={p: i for p, i in self.vocab.items() if p not in gone}, merges=merges, specials=tuple(s for s in self.specials if s not in gone))

    def first_merges(self, n: int) -> TokenizerSpec:
        """The tokenizer that stops after the first ``n`` merges; any prefix of ranked merges is a tokenizer."""
        made = {a + b for a, b in self.merges[n:]}
        vocab = {p: i for p, i in self.vocab.items() if p not in made or p in self.specials}
        return replace(self, name=f"{self.name}-{n}", merges=self.merges[:n], vocab=vocab)

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"piece": pa.array(list(self.vocab), pa.string()), "token": pa.array(list(self.vocab.values()), pa.int64())}))

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        left, right = zip(*self.merges, strict=True) if self.merges else ((), ())
        return spark.createDataFrame(pa.table({"rank": pa.array(range(len(left)), pa.int32()), "left": pa.array(left, pa.string()), "right": pa.array(right, pa.string())}))

    def encoder(self) -> Encoder:
        return Encoder(self)

    def decoder(self) -> Decoder:
        return Decoder(self)


class Encoder:
    """Encodes texts with one specification; keeps the tokens of up to ``keep`` different words, with hit counters."""

    def __init__(self, spec: TokenizerSpec, keep: int = 200_000):
        self.spec, self.keep = spec, keep
        self.cache: dict[str, tuple[int, ...]] = {}
        self.hits = self.misses = 0
        self.line = regex.compile(LINE)
        self.word = regex.compile(pattern_with(spec.specials, spec.pattern))
        self.special = {s: spec.vocab[s] for s in spec.specials if s in spec.vocab}
        self.letters = byte_characters()
        self.joins = spec.id_merges if spec.cross_word and not spec.ignore_merges else {}

    def split(self, text: str) -> list[str]:
        spec = self.spec
        for k, v in sorted(spec.normalizer.items(), key=lambda x: (-len(x[0]), x[0])):
            text = text.replace(k, v)
        out = []
        for line in self.line.findall(text):
            if spec.newline_separator:
                line = line.replace("\n", "</s>")
            if spec.lower_case:
                line = "".join(w if w in self.special else w.lower() for w in self.word.findall(line))
            out += self.word.findall(line)
        if not spec.prefix_space:
            out = [s for w in out if (s := w.strip())]
        return out

    def bpe(self, word: str) -> tuple[int, ...]:
        """Tokens of one word; see merged_parts."""
        spec = self.spec
        text = "".join([self.letters[b] for b in word.encode()]) if spec.byte_level else word
        if spec.ignore_merges and text in spec.vocab:
            return (spec.vocab[text],)
        parts = list(text)
        if spec.end_of_word and parts:
            parts[-1] += spec.end_of_word
        parts = merged_parts(parts, spec.ranks)
        out: list[int] = []
        for p in parts:
            if (t := spec.vocab.get(p)) is not None:
                out.append(t)
            elif spec.byte_fallback:
                out += [spec.byte_fallback[b] for b in p.encode() if b in spec.byte_fallback]
        return tuple(out)

    def tokens_of(self, word: str) -> tuple[int, ...]:
        if (out := self.cache.get(word)) is not None:
            self.hits += 1
            return out
        self.misses += 1
        out = (self.special[word],) if word in self.special else self.bpe(word)
        if len(self.cache) >= self.keep:
            self.cache.clear()
        self.cache[word] = out
        return out

    def plain(self, text: str) -> list[int]:
        """Tokens of a text as it stands, without a leading space, bos or eos."""
        out: list[int] = []
        self.append(out, self.split(text))
        return out

    def append(self, out: list[int], words: Iterable[str]) -> None:
        """Appends the tokens of words to those of the words before them."""
        cached, joins = self.cache.get, self.joins
        for word in words:
            if (new := cached(word)) is None:
                new = self.tokens_of(word)
            else:
                self.hits += 1
            if joins and out and new and (out[-1], new[0]) in joins:
                merge_across(out, new, joins)
            else:
                out += new

    def __call__(self, text: str | None) -> list[int] | None:
        """Tokens of a text; None for None, nothing (or bos and eos) for an empty one."""
        if text is None:
            return None
        spec = self.spec
        out = self.plain(f" {text}" if spec.lead_space else text)
        bos = spec.vocab.get(spec.bos) if spec.add_bos and spec.bos else None
        eos = spec.vocab.get(spec.eos) if spec.add_eos and spec.eos else None
        return ([bos] if bos is not None else []) + out + ([eos] if eos is not None else [])


def merged_parts(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges adjacent parts: the pair of the lowest rank first, all its occurrences from the left, until no pair has a rank.

    Parts form a linked list, pairs a heap by rank and place, so n parts take n log n steps.
    """
    n = len(parts)
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
    if not heap:
        return parts
    heapify(heap)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    while heap:
        rank = heap[0][0]
        made = []
        # A merge may make a pair of a lower rank; that one waits until all occurrences of this pair are merged.
        while heap and heap[0][0] == rank:
            k = heappop(heap)[1]
            right = after[k]
            if parts[k] and right >= 0 and ranks.get((parts[k], parts[right])) == rank:
                parts[k] += parts[right]
                parts[right] = ""
                after[k] = after[right]
                if after[k] >= 0:
                    before[after[k]] = k
                made += [before[k], k]
        for k in made:
            if k >= 0 and parts[k] and after[k] >= 0 and (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                heappush(heap, (r, k))
    return [p for p in parts if p]


def merge_across(done: list[int], new: Iterable[int], joins: dict[tuple[int, int], int]) -> None:
    """Appends a word's tokens to ``done``, merging over the border of the words wherever a pair of ids merges; what a merge makes is tried with what stands before it.

    Every merge takes a token away, so the time is that of the tokens appended.
    """
    for t in new:
        done.append(t)
        while len(done) > 1 and (m := joins.get((done[-2], done[-1]))) is not None:
            done[-2:] = [m]


#: Characters of one line from which a pull encodes its words before the line is complete.
LONG_LINE = 1 << 16


def pull(encoder: Encoder, texts: Iterable[str], size: int) -> Iterator[list[int]]:
    """Tokens of a text that arrives in pieces, ``size`` at a time; the last pull gives the rest.

    The pulls joined are the tokens of the whole text. A line is encoded once it is complete, as words never
    span one; of a line longer than LONG_LINE the words that nothing still to come can change are encoded
    before, unless a normalizer or lower case might change them. A merge makes a piece of the vocabulary, so
    it can take only tokens whose pieces together are shorter than the longest one: those are held back.
    """
    spec = encoder.spec
    inner = Encoder(replace(spec, add_bos=False, add_eos=False, lead_space=False), encoder.keep)
    ends = [spec.vocab.get(t) if on and t else None for on, t in ((spec.add_bos, spec.bos), (spec.add_eos, spec.eos))]
    length = {i: len(p) for p, i in spec.vocab.items()}
    longest = max(length.values(), default=0) if inner.joins else 0
    cuttable = spec.pattern in (PATTERN, PLAIN_PATTERN) and not spec.normalizer and not spec.lower_case and spec.prefix_space
    # A word is settled by what follows it: one character more, or a special literal or contraction begun.
    margin = max([4, *map(len, spec.specials)])
    out: list[int] = []
    held, most = " " if spec.lead_space else "", LONG_LINE
    first = [ends[0]] if ends[0] is not None else []
    for text in texts:
        held += text
        *lines, held = held.split("\n")
        for line in lines:
            inner.append(out, inner.split(f"{line}\n"))
        if cuttable and len(held) > most:
            words = inner.split(held)
            at, sure = 0, 0
            while sure + 2 < len(words) and at + len(words[sure]) + margin < len(held):
                at += len(words[sure])
                sure += 1
            inner.append(out, words[:sure])
            held = held[at:]
            most = max(LONG_LINE, 2 * len(held))
        free, open_length = len(out), 0
        while free and open_length < longest:
            free -= 1
            open_length += length.get(out[free], 0)
        if first and free:
            out[:0], first, free = first, [], free + len(first)
        whole = free // size * size
        for k in range(0, whole, size):
            yield out[k : k + size]
        del out[:whole]
    inner.append(out, inner.split(held))
    out = first + out + ([ends[1]] if ends[1] is not None else [])
    for k in range(0, len(out), size):
        yield out[k : k + size]


class Decoder:
    """Decodes tokens with one specification."""

    def __init__(self, spec: TokenizerSpec):
        self.spec = spec
        self.pieces = spec.pieces

    def raw(self, tokens: Iterable[int | None]) -> bytes:
        get = self.pieces.get
        return b"".join([get(t, b"") for t in tokens])

    def __call__(self, tokens: Iterable[int | None] | None) -> str | None:
        """Text of tokens: unknown ids are skipped, a character cut off at the end is dropped, other invalid bytes become U+FFFD."""
        if tokens is None:
            return None
        spec = self.spec
        if spec.end_of_word:
            return self._with_words(tokens)
        raw = self.raw(tokens)
        return raw[: len(raw) - open_bytes(raw)].decode("utf-8", "replace")

    def _with_words(self, tokens: Iterable[int | None]) -> str:
        """The end-of-word mark becomes a space, but not after a lone apostrophe and not before punctuation; digits stand apart."""
        mark, out = self.spec.end_of_word, []
        special = {self.spec.vocab.get(s) for s in self.spec.specials}
        for t in tokens:
            piece = self.pieces.get(t, b"").decode("utf-8", "replace")
            if t in special or not piece.endswith(mark):
                out.append(piece + (" " if piece.isdigit() else ""))
                continue
            piece = piece[: -len(mark)]
            if piece in self.spec.punctuation and out and out[-1].endswith(" "):
                out[-1] = out[-1][:-1]
            out.append(piece if piece == "'" else piece + " ")
        return "".join(out)

    def ready(self, tokens: list[int]) -> int:
        """How many leading tokens end on a character's border: all of them if the sequence is ready.

        Only the bytes at the end decide, whatever stands before. Vocabularies with byte pieces are always ready.
        """
        if self.spec.byte_fallback:
            return len(tokens)
        n = len(tokens)
        while n and open_bytes(self._last_bytes(tokens, n)):
            n -= 1
        return n

    def _last_bytes(self, tokens: list[int], n: int) -> bytes:
        """The bytes of the last of the first n tokens, as many as a character can have or more."""
        tail = b""
        while n and len(tail) < 4:
            n -= 1
            tail = self.pieces.get(tokens[n], b"") + tail
        return tail

    def trim(self, tokens: list[int]) -> list[int]:
        """Without the last tokens that leave a character open."""
        return tokens[: self.ready(tokens)]


def open_bytes(raw: bytes) -> int:
    """How many bytes at the end begin a UTF-8 character without ending it."""
    for back in range(1, min(4, len(raw)) + 1):
        b = raw[-back]
        if b >= 0xC0:
            length = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return back if back < length and b < 0xF8 else 0
        if b < 0x80:
            return 0
    return 0


def continuation_debts(spec: TokenizerSpec) -> dict[int, int]:
    """Per token the bytes it leaves open (positive) or closes (negative), where that is not zero."""
    out = {}
    for t, raw in spec.pieces.items():
        debt = 0
        for b in raw:
            if b >= 0xC0:
                debt += 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            elif b >= 0x80:
                debt -= 1
        if debt:
            out[t] = debt
    return out


# ---- loading


def byte_level_vocab(merges: Iterable[tuple[str, str]], before: tuple[str, ...] = (), after: tuple[str, ...] = (), absent_bytes: Iterable[int] = (), skip_first: bool = False) -> tuple[dict[str, int], tuple[tuple[str, str], ...]]:
    """Vocabulary and merges of a byte-level tokenizer from its merges alone.

    Ids run over the pieces ``before``, the bytes (those that print first, in code point order), one
    piece per merge, and the pieces ``after``. ``skip_first`` takes away the rank, not the id, of the
    first merge, for files that are read as if they had a header.
    """
    merges = tuple(merges)
    gone = set(absent_bytes)
    letters = byte_characters()
    in_order = sorted((b for b in range(256) if b not in gone), key=lambda b: ord(letters[b]))
    pieces = [*before, *(letters[b] for b in in_order), *(a + b for a, b in merges), *after]
    vocab: dict[str, int] = {}
    for k, p in enumerate(pieces):
        vocab.setdefault(p, k)
    return vocab, merges[1:] if skip_first else merges


#: Bytes that occur in no UTF-8 text.
NEVER_IN_UTF8 = (0xC0, 0xC1, *range(0xF5, 0x100))


def gpt2(folder: str = TOKENIZERS) -> TokenizerSpec:
    """The gpt2 tokenizer from a public tokenizer file with its merges."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
    vocab, ranked = byte_level_vocab(merges, after=("<|endoftext|>", "<|padding|>"))
    return TokenizerSpec("gpt2", vocab, ranked, ("<|endoftext|>", "<|padding|>"), bos="<|endoftext|>", eos="<|endoftext|>", pad="<|padding|>")


def pile(merges_path: str) -> TokenizerSpec:
    """The pile tokenizer from its file of merges, which has no header but is read as if it had one."""
    merges = read_merges(merges_path, skip_header=False)
    vocab, ranked = byte_level_vocab(merges, before=("<|endoftext|>", "<|padding|>"), absent_bytes=NEVER_IN_UTF8, skip_first=True)
    return TokenizerSpec("pile", vocab, ranked, ("<|endoftext|>", "<|padding|>"), bos="<|endoftext|>", eos="<|endoftext|>", pad="<|padding|>")


def read_merges(path: str, skip_header: bool | None = None) -> list[tuple[str, str]]:
    """Pairs of a merges file, one per line; the first line is a header if it says so, or as told."""
    with open(path, encoding="utf-8") as f:
        rows = f.read().split("\n")
    if skip_header or (skip_header is None and rows and rows[0].startswith("#version")):
        rows = rows[1:]
    return [(a, b) for r in rows if r and (ab := r.split(" ", 1))[1:] for a, b in [ab]]


#: Behaviour of the vocabularies whose files have to be given: fixed values of their published settings.
PROFILES: dict[str, dict] = {
    "gpt2": {},
    "pile": {},
    "clip": {"byte_level": True, "normalizer": {"‘": "'", "’": "'", "“": '"', "”": '"'}, "add_bos": True, "add_eos": True, "bos": "<|startoftext|>", "eos": "<|endoftext|>", "pad": "<|endoftext|>", "prefix_space": False, "lower_case": True, "end_of_word": "</w>", "punctuation": (",", ".", "!", "?", "'"), "specials": ("<|startoftext|>", "<|endoftext|>")},
    # Vocabularies with byte pieces and no branch for contractions.
    "byte_fallback": {"byte_level": False, "pattern": PLAIN_PATTERN},
    "llama": {"byte_level": False, "specials": ("<s>", "</s>"), "bos": "<s>", "eos": "</s>"},
    "mistral": {"byte_level": False, "specials": ("<s>", "</s>"), "bos": "<s>", "eos": "</s>", "add_bos": True, "lead_space": True},
    "llama3": {"ignore_merges": True, "specials": ("<|begin_of_text|>", "<|end_of_text|>"), "bos": "<|begin_of_text|>", "eos": "<|end_of_text|>", "add_bos": True, "add_eos": True},
}


def load(name: str, vocab: dict[str, int], merges: Iterable[tuple[str, str]], **changes) -> TokenizerSpec:
    """A tokenizer of a known profile from its vocabulary and merges; ``changes`` override the profile."""
    settings = {**PROFILES.get(name, {}), **changes}
    settings["specials"] = tuple(settings.get("specials", ()))
    return TokenizerSpec(name, dict(vocab), tuple(tuple(m) for m in merges), **settings)


# ---- DataFrames


_KINDS = {"array<bigint>": pa.list_(pa.int64()), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _array_udf(make: Callable[[], Callable], returns: str):
    """An iterator-style Arrow function: ``make`` builds the worker's function once per task."""

    def run(parts):
        f = make()
        for part in parts:
            yield pa.array([f(x) for x in part.to_pylist()], _KINDS[returns])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returns)


def flat_lists(parts: Iterable[list[int] | None]) -> pa.Array:
    """Lists of tokens as an Arrow array, by way of one flat buffer."""
    flat, ends, null = array("q"), array("i", [0]), []
    for p in parts:
        null.append(p is None)
        flat.extend(p or ())
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int64)), mask=pa.array(null) if any(null) else None)


#: Specifications broadcast last; the same one is sent once, however many queries use it.
_SENT: list[tuple[object, TokenizerSpec, object]] = []
#: Encoders and decoders of a Python worker, which outlive its tasks with the words they have met.
_BUILT: dict[tuple[int, str], object] = {}


class Shared:
    """A specification on the workers, with one encoder and one decoder each per worker process."""

    def __init__(self, spec: TokenizerSpec):
        self.key, self.spec, self.held = id(spec), spec, None
        if (spark := SparkSession.getActiveSession()) is not None:
            context = spark.sparkContext
            known = [h for c, s, h in _SENT if c is context and s is spec]
            if not known:
                known = [context.broadcast(spec)]
                _SENT.append((context, spec, known[0]))
                del _SENT[:-8]
            self.held = known[0]
            self.key = self.held._jbroadcast.id() if self.held._jbroadcast is not None else self.key

    def __getstate__(self):
        return {"key": self.key, "spec": None if self.held is not None else self.spec, "held": self.held}

    def __call__(self) -> TokenizerSpec:
        return self.spec if self.held is None else self.held.value

    def _built(self, kind: str, make: Callable):
        if (out := _BUILT.get((self.key, kind))) is None:
            if len(_BUILT) >= 8:
                _BUILT.clear()
            out = _BUILT[(self.key, kind)] = make(self())
        return out

    def encoder(self) -> Encoder:
        return self._built("encoder", Encoder)

    def decoder(self) -> Decoder:
        return self._built("decoder", Decoder)


def encode(text: str | Column, spec: TokenizerSpec) -> Column:
    """Tokens of a text column, as array<bigint>."""
    held = Shared(spec)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = held.encoder()
        for part in parts:
            yield flat_lists(map(e, part.to_pylist()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<bigint>")(text)


def recode(tokens: str | Column, source: TokenizerSpec, target: TokenizerSpec) -> Column:
    """Tokens of one vocabulary as those of another, in one Python stage."""
    one, other = Shared(source), Shared(target)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        d, e = one.decoder(), other.encoder()
        for part in parts:
            yield flat_lists(e(d(t)) for t in part.to_pylist())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<bigint>")(tokens)


def decode(tokens: str | Column, spec: TokenizerSpec) -> Column:
    """Text of a token column."""
    return _array_udf(Shared(spec).decoder, "string")(tokens)


def tokens_ready(tokens: str | Column, spec: TokenizerSpec) -> Column:
    """Whether a sequence ends on a character's border; an empty one does."""
    held = Shared(spec)

    def make():
        d = held.decoder()
        return lambda t: None if t is None else d.ready(t) == len(t)

    return _array_udf(make, "boolean")(tokens)


def trim_tokens(tokens: str | Column, spec: TokenizerSpec) -> Column:
    """The sequence up to its last character's border."""
    held = Shared(spec)

    def make():
        d = held.decoder()
        return lambda t: None if t is None else d.trim(t)

    return _array_udf(make, "array<bigint>")(tokens)


def per_text(column: str | Column, spec: TokenizerSpec, function: Callable, returns: str) -> Column:
    """Any function of (encoder, decoder, value) over a column, built once per task."""
    held = Shared(spec)

    def make():
        e, d = held.encoder(), held.decoder()
        return lambda x: None if x is None else function(e, d, x)

    return _array_udf(make, returns)(column)


def encode_by_dictionary(docs: DataFrame, spec: TokenizerSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) by a dictionary of the distinct words of all texts, encoded once each and joined back.

    Worth its two shuffles where merging is dear and words repeat across the whole corpus. Cross-word
    merges need whole texts and are not applied. Keys must be unique. Texts without words give no row.
    """
    from textloom.functions.splitting import words

    each = words(docs, key, text, spec.specials, spec.pattern)
    held = Shared(replace(spec, cross_word=False))

    def make():
        e = held.encoder()
        return lambda w: list(e.tokens_of(w))

    dictionary = each.select("word").distinct().withColumn("tokens", _array_udf(make, "array<bigint>")("word"))
    joined = each.join(dictionary, "word")
    gathered = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "word_no", "tokens"))).alias("w"))
    return gathered.select(key, F.flatten(F.transform("w", lambda x: x.tokens)).alias("tokens"))


def lookup(pieces: str | Column, spec: TokenizerSpec) -> Column:
    """Ids of an array of pieces; null for unknown ones."""
    held = Shared(spec)

    def make():
        get = held().vocab.get
        return lambda ps: None if ps is None else [get(p) for p in ps]

    return _array_udf(make, "array<bigint>")(pieces)


def show_pieces(tokens: str | Column, spec: TokenizerSpec) -> Column:
    """The pieces of tokens joined by ``|``, for display."""
    held = Shared(spec)

    def make():
        back = {i: p for p, i in held().vocab.items()}
        return lambda ts: None if ts is None else "|".join(back.get(t, "") for t in ts)

    return _array_udf(make, "string")(tokens)


def debts_frame(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    """(token, debt): the bytes each token leaves open or closes, zero included."""
    debts = continuation_debts(spec)
    ids = sorted(set(spec.vocab.values()))
    return spark.createDataFrame(pa.table({"token": pa.array(ids, pa.int64()), "debt": pa.array(np.array([debts.get(i, 0) for i in ids]), pa.int32())}))
