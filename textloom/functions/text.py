"""Text normalization as Column expressions, all of them evaluated in the JVM.

Every function takes a column or its name and returns null for null; the empty text stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column

#: The characters whose garbled form (their UTF-8 bytes read as cp1252) the repair knows.
REPAIRED_CHARACTERS = "€‚ƒ„…‡ˆ‰‹ŒŽ‘’“•–—˜™š›œžŸ¡¢£¤¥¦§¨©ª«®¯°±²³´µ¶·¸¹º»¼½¾¿ÀÂÃÄÅÆÇÈÉÊËÌÎÑÒÓÔÕÖ×ØÙÚÛÜÞßáâãäåæçèéêëìîïðñòóôõö÷øùúûüýþÿ"

#: White space of the split pattern; Java's own class also holds the vertical tab.
SPACE = r"\t\n\f\r "


#: All characters that count as space around a line or word.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def garbled_forms() -> dict[str, str]:
    """Garbled form to character, by the rule; cp1252 leaves five bytes open, which read as the control of that number."""
    out = {}
    for c in REPAIRED_CHARACTERS:
        out["".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in c.encode())] = c
    return out


def clean_controls(text: ColumnLike) -> Column:
    """First stage of the sanitizer: no carriage returns, written-out newlines made real, runs of newlines
    made one, tabs made spaces, no space before a colon."""
    t = F.replace(col(text), F.lit("\r"), F.lit(""))
    t = F.replace(t, F.lit("\\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"\n+", "\n")
    t = F.translate(t, "\t", " ")
    return F.replace(t, F.lit(" :"), F.lit(":"))


def squeeze_lines(text: ColumnLike) -> Column:
    """Second stage: each line with single spaces inside and none around."""
    lines = F.split(col(text), "\n")
    return F.array_join(F.transform(lines, lambda s: F.btrim(F.regexp_replace(s, r"[\t-\r ]+", " "), F.lit(SPACES))), "\n")


def sanitize(text: ColumnLike) -> Column:
    """Both stages. They work on whole texts, so no block edges show."""
    return squeeze_lines(clean_controls(text))


def repair_garbled(text: ColumnLike) -> Column:
    """Replaces the garbled forms of the known characters in one pass: at each place the longest form counts, and what a replacement makes is not looked at again.

    Texts without any character a form can begin with skip the pass.
    """
    forms = garbled_forms()
    leads = "".join(sorted({f[0] for f in forms}))
    longest_first = "|".join(sorted(forms, key=lambda f: (-len(f), f)))
    parts = F.regexp_extract_all(col(text), F.lit(f"(?s){longest_first}|[^{leads}]+|."), 0)
    known = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    most = max(map(len, forms))
    mended = F.transform(parts, lambda p: F.when(F.char_length(p) <= most, F.coalesce(F.element_at(known, p), p)).otherwise(p))
    return F.when(col(text).rlike(f"[{leads}]"), F.array_join(mended, "")).otherwise(col(text))


def replace_all(text: ColumnLike, replacements: dict[str, str]) -> Column:
    """A vocabulary's normalizer: keys of one character to one character in one translate, others longest first."""
    t = col(text)
    single = {k: v for k, v in replacements.items() if len(k) == 1 and len(v) == 1}
    for k, v in sorted(replacements.items(), key=lambda x: (-len(x[0]), x[0])):
        if k and k not in single:
            t = F.replace(t, F.lit(k), F.lit(v))
    return F.translate(t, "".join(single), "".join(single.values())) if single else t


def newline_as_separator(text: ColumnLike) -> Column:
    """The newline mode in which a line ends in ``</s>``; apply it after lines are split."""
    return F.replace(col(text), F.lit("\n"), F.lit("</s>"))


def lower_case(text: ColumnLike) -> Column:
    return F.lower(col(text))


def trim_words(words: ColumnLike) -> Column:
    """Words without the space around them, empty ones dropped: vocabularies without a leading space."""
    trimmed = F.transform(col(words), lambda w: F.btrim(w, F.lit(SPACES)))
    return F.filter(trimmed, lambda w: w != "")


def leading_space(text: ColumnLike) -> Column:
    return F.concat(F.lit(" "), col(text))


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(moved)) for b in range(256)]


def byte_alphabet(text: ColumnLike) -> Column:
    """A text as the printable characters of its UTF-8 bytes."""
    table = F.array(*[F.lit(c) for c in byte_characters()])
    raw = F.hex(F.encode(col(text), "UTF-8"))
    at = F.sequence(F.lit(1), F.octet_length(col(text)))
    chars = F.transform(at, lambda i: F.element_at(table, F.conv(F.substr(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(F.octet_length(col(text)) > 0, F.array_join(chars, "")).otherwise(col(text))


def escape_json(text: ColumnLike) -> Column:
    """A text as a JSON string, without the quotes."""
    return F.expr("substring(to_json(array({0})), 3, length(to_json(array({0}))) - 4)".format(text if isinstance(text, str) else "text"))


def unescape_json(text: ColumnLike) -> Column:
    """The text that a JSON string's inside stands for; null if it is none."""
    return F.element_at(F.from_json(F.concat(F.lit('["'), col(text), F.lit('"]')), "array<string>"), 1)


def expand_newline(argument: ColumnLike) -> Column:
    """The two characters ``\\n`` in an argument as a newline."""
    return F.replace(col(argument), F.lit("\\n"), F.lit("\n"))


def character_class(c: ColumnLike) -> Column:
    """What a single character is: newline, space (that stays in a line), letter, number or symbol."""
    x = col(c)
    return (
        F.when(x == "\n", "newline").when(x.rlike(r"^[\t\x0b\f\r \x{85}\x{A0}\p{Z}]$"), "space").when(x.rlike(r"^\p{L}$"), "letter").when(x.rlike(r"^\p{N}$"), "number").otherwise("symbol")
    )


def split_location(uri: ColumnLike) -> Column:
    """struct(is_s3, bucket, key) of an ``s3://bucket/key`` address; other addresses have an empty bucket and are their own key."""
    u = col(uri)
    s3 = u.startswith("s3://")
    return F.struct(
        s3.alias("is_s3"),
        F.when(s3, F.regexp_extract(u, r"(?s)^s3://([^/]*)/?(.*)$", 1)).otherwise("").alias("bucket"),
        F.when(s3, F.regexp_extract(u, r"(?s)^s3://([^/]*)/?(.*)$", 2)).otherwise(u).alias("key"),
    )
