"""Splitting of text into lines and words as Column expressions and as DataFrames of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, ColumnLike, col

#: Fixed value: the split pattern of the byte-level vocabularies, spelt so that Java, RE2 and Python read it alike.
#: It has no look-ahead: a run of spaces is a word of its own, and the word after it has no leading space.
PATTERN = r"'(?:[st]|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\t\n\f\r \p{L}\p{N}]+|[\t\n\f\r ]+"
#: Fixed value: the same without the branch for contractions.
PLAIN_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\t\n\f\r \p{L}\p{N}]+|[\t\n\f\r ]+"
#: A line with its newline, or the rest of a text without one.
LINE = r"[^\n]*\n|[^\n]+"


def lines(text: ColumnLike) -> Column:
    """The lines of a text, each with its newline; words never span one."""
    return F.regexp_extract_all(col(text), F.lit(LINE), 0)


def pattern_with(specials: list[str] | tuple[str, ...], pattern: str = PATTERN) -> str:
    """The split pattern with special literals before it, the shortest first, which therefore wins where several begin at one place."""
    literals = [re.escape(s).replace(r"\ ", " ") for s in sorted(specials, key=lambda s: (len(s), s)) if s and "\n" not in s]
    if not literals:
        return pattern
    # Text before a special is split by itself, so no word may run into one.
    stop = "".join(f"(?!{x})" for x in literals)
    guarded = pattern.replace(r"\p{L}+", rf"(?:{stop}\p{{L}})+").replace(r"\p{N}+", rf"(?:{stop}\p{{N}})+").replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:{stop}[^{SPACE}\p{{L}}\p{{N}}])+")
    return "|".join([*literals, guarded])


def split_words(text: ColumnLike, specials: list[str] | tuple[str, ...] = (), pattern: str = PATTERN) -> Column:
    """The words of a text in order, line by line; null for null, no words for an empty text."""
    regexp = F.lit(pattern_with(specials, pattern))
    return F.flatten(F.transform(lines(text), lambda s: F.regexp_extract_all(s, regexp, 0)))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", specials: tuple[str, ...] = (), pattern: str = PATTERN) -> DataFrame:
    """(key, line_no, word_no, word), both numbers from 0, the latter within the line.

    Only the key and the text are kept, so other columns of the table can't clash. Null and empty
    texts give no row; repeated rows give theirs each time.
    """
    each = docs.select(F.col(key), F.posexplode(lines(text)).alias("line_no", "line"))
    return each.select(key, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(pattern_with(specials, pattern)), 0)).alias("word_no", "word"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts. Counts are combined before the shuffle, so a frequent word costs no task more."""
    return docs.select(F.explode(split_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def occurrences(text: ColumnLike, literal: str) -> Column:
    """Start positions, from 0, of a literal in a text, not overlapping; none for an empty literal. Takes the time of one scan."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = re.compile(re.escape(literal) if literal else "(?!)").finditer
        for part in parts:
            yield pa.array([None if t is None else [m.start() for m in found(t)] for t in part.to_pylist()], pa.list_(pa.int32()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(col(text))


def sentences(text: ColumnLike) -> Column:
    """Sentences by rule, with the space after them: they end in ``.!?`` and space, or in a newline."""
    return F.regexp_extract_all(col(text), F.lit(r"(?s).+?(?:[.!?]+[\"'”’)\]]*(?=\s|$)\s*|\n+|$)"), 0)


def punctuation_split(text: ColumnLike) -> Column:
    """Parts of a text between a letter and a letter joined by one of ``.!?;`` without a space; the three characters are dropped."""
    return F.split(col(text), r"\p{L}[.!?;]\p{L}")
