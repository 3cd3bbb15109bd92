"""Trimming of token sequences to whole lines, whole sentences and whole characters."""

from __future__ import annotations

import unicodedata
from itertools import accumulate

import regex
from pyspark.sql import Column

from textloom.operators.tokenizer import Decoder, Encoder, TokenizerSpec, per_text

TOP, BOTTOM, NONE = "top", "bottom", "none"

_SENTENCE = regex.compile(r"""\S[^\n]*?(?:[.!?]+["'”’)\]]*(?=\s|$)|(?=\n)|$)""")
#: Where a sentence is closed: by a mark and space, by a line's end, or by a mark between two letters.
_CLOSED = regex.compile(r"""[.!?]+["'”’)\]]*(?=\s)|\n|(?<=\p{L})[.!?;](?=\p{L})""")


def lines_within(e: Encoder, d: Decoder, tokens: list[int], direction: str, limit: int) -> list[int]:
    """Whole lines from the end (``top`` trims the top) or the beginning, as long as they fit the limit together."""
    if len(tokens) <= limit:
        return tokens
    if direction not in (TOP, BOTTOM):
        return []
    lines = d(tokens).split("\n")
    kept: list[list[int]] = []
    total = 0
    for line in reversed(lines) if direction == TOP else lines:
        new = e(f"\n{line}" if direction == TOP else f"{line}\n")
        total += len(new)
        if total > limit:
            break
        kept.append(new)
    if direction == TOP:
        kept.reverse()
    return [t for part in kept for t in part]


def sentences_within(e: Encoder, d: Decoder, tokens: list[int], direction: str, limit: int) -> list[int]:
    """Whole sentences from the end or the beginning, with one space before or a newline after them, below the limit."""
    if len(tokens) <= limit:
        return tokens
    if direction not in (TOP, BOTTOM):
        return []
    text = d(tokens)
    spans = [m.span() for m in _SENTENCE.finditer(text)]
    if direction == TOP:
        spans.reverse()

    def joined(n: int) -> str:
        """The first n sentences, from the end if the top is trimmed, as they stand in the text."""
        if not n:
            return ""
        start, end = spans[n - 1]
        if direction == TOP:
            return text[start - 1 if start and text[start - 1].isspace() else start :]
        return text[: end + 1 if text[end : end + 1] == "\n" else end]

    # Sentences joined have about the tokens of each by itself; the exact number decides over the last few.
    n = total = 0
    while n < len(spans) and total < limit:
        total += len(e.plain(text[slice(*spans[n])]))
        n += 1
    while n < len(spans) and len(e(joined(n + 1))) < limit:
        n += 1
    while n and len(e(joined(n))) >= limit:
        n -= 1
    return e(joined(n))


def whole_sentences(e: Encoder, d: Decoder, tokens: list[int]) -> list[int]:
    """Without what stands behind the last sentence end, if the text does not end in punctuation; as it is if more than a fifth of its bytes would go."""
    text = d(tokens)
    shown = text.rstrip()
    if shown and not unicodedata.category(shown[-1]).startswith("P"):
        ends = [m.end() for m in _CLOSED.finditer(shown)]
        shown = shown[: ends[-1]] if ends else shown
    kept = shown.strip()
    return e(kept) if 5 * len(kept.encode()) >= 4 * len(text.encode()) else tokens


def aligned(e: Encoder, d: Decoder, tokens: list[int], size: int) -> tuple[list[int], int]:
    """At most ``size`` tokens that end on a character's border, and how many of those given they stand for.

    Where the first ``size`` tokens would break a character, the text of the tokens around is encoded afresh, and
    the cut is made at the last border where a token given and a fresh one end at the same byte. So shorter
    spellings make room for more text. Tokens whose bytes are no text end at their last border instead.
    """
    size = min(size, len(tokens))
    border = d.ready(tokens[:size])
    if border == size:
        return tokens[:size], size
    given = d.trim(tokens[: 2 * size])
    raw = d.raw(given)
    fresh = e.plain(d(given))
    if d.raw(fresh) != raw:
        return tokens[:border], border
    ends = {at: k for k, at in enumerate(accumulate(len(d.raw([t])) for t in given), 1)}
    cut = (0, 0)
    for n, at in enumerate(accumulate(len(d.raw([t])) for t in fresh[:size]), 1):
        if at in ends and (at == len(raw) or raw[at] & 0xC0 != 0x80):
            cut = (n, ends[at])
    return fresh[: cut[0]], cut[1]


def trim_newlines(tokens: str | Column, spec: TokenizerSpec, direction: str, limit: int) -> Column:
    """See lines_within; null stays null."""
    return per_text(tokens, spec, lambda e, d, t: lines_within(e, d, t, direction, limit), "array<bigint>")


def trim_sentences(tokens: str | Column, spec: TokenizerSpec, direction: str, limit: int) -> Column:
    """See sentences_within; sentences are found by rule, so other segmenters may cut elsewhere."""
    return per_text(tokens, spec, lambda e, d, t: sentences_within(e, d, t, direction, limit), "array<bigint>")


def trim_incomplete_sentence(tokens: str | Column, spec: TokenizerSpec) -> Column:
    return per_text(tokens, spec, whole_sentences, "array<bigint>")


def align_and_size(tokens: str | Column, spec: TokenizerSpec, size: int) -> Column:
    return per_text(tokens, spec, lambda e, d, t: aligned(e, d, t, size)[0], "array<bigint>")
