"""Queries on normalization, splitting and sources, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import splitting, text
from textloom.functions.splitting import PATTERN
from textloom.operators.ordering import newest, sort_files
from textloom.sources.texts import TEXT_JOIN, json_texts, list_texts, object_texts, read_texts, text_objects, write_lines
from textloom.util import drop_path, scratch_path, table


def quoted(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def _roughened(c: str) -> Column:
    """A text with all the flaws that the sanitizer mends."""
    t = F.replace(F.col(c), F.lit(". "), F.lit(" :\t"))
    t = F.replace(t, F.lit(", "), F.lit(",  \r\n\n "))
    return F.concat(F.lit("  "), t, F.lit("\\n end "))


def sanitize_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.sanitize(_roughened("text")).alias("clean"))


def repair_garbled_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "encode_lines").where("text is not null").select("line_id", "text").distinct()
    return lines.select("line_id", text.repair_garbled("text").alias("repaired"))


def normalize_quotes(spark: SparkSession, d: str) -> DataFrame:
    quotes = {"‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.lower_case(text.replace_all("text", quotes)).alias("plain"))


def newline_mode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.leading_space(text.newline_as_separator("text")).alias("joined"))


def byte_alphabet_words(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select(F.explode(splitting.split_words("text")).alias("word")).distinct()
    return each.select("word", text.byte_alphabet("word").alias("shown"))


def json_escapes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    escaped = docs.select("doc_id", "text", text.escape_json("text").alias("escaped"))
    return escaped.select("doc_id", text.unescape_json("escaped").alias("back"), (F.char_length("escaped") >= F.char_length("text")).alias("no_shorter"))


def boundary_arguments(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "pack_jobs").where("job_id is not null")
    return jobs.select("job_id", "context_size", F.hex(text.expand_newline("boundary")).alias("boundary_hex")).distinct()


def split_locations(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "path_infos")
    return files.select("listing_id", text.split_location("path").alias("s")).select("listing_id", "s.is_s3", "s.bucket", "s.key").distinct()


def word_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.words(table(spark, d, "documents"))


def word_freq(spark: SparkSession, d: str) -> DataFrame:
    return splitting.word_counts(table(spark, d, "documents"))


def word_cache_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many words are met again: what a cache of all words would answer."""
    counts = splitting.word_counts(table(spark, d, "documents"))
    return counts.agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct")).withColumn("hit_rate", 1 - F.col("n_distinct") / F.col("n_words"))


def word_split_specials(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit(". "), F.lit(".<|endoftext|> ")).alias("text"))
    return splitting.words(docs, specials=("<|endoftext|>", "<|padding|>"))


def trimmed_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(text.trim_words(splitting.split_words("text")), "|").alias("words"))


def literal_positions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(splitting.occurrences("text", "the").cast("array<bigint>")).alias("at"))


def character_classes(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), 0)).alias("c"))
    return chars.groupBy("c").agg(F.count("*").alias("n")).groupBy(text.character_class("c").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("n_different"))


def json_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Every text of nested JSON, made here from title and text."""
    docs = table(spark, d, "documents").where("text is not null")
    line = F.to_json(F.struct(F.col("text"), F.struct(F.array(F.struct(F.coalesce("title", F.lit("")).alias("text"))).alias("parts")).alias("meta"), F.col("doc_id").alias("id")))
    return docs.select("doc_id", F.array_join(json_texts(line), TEXT_JOIN).alias("joined"))


#: Files that lie in the shared folder at once, about. Each takes a block of the disk, however short it is.
PART_FILES = 100_000


def _corpus(spark: SparkSession, d: str, read: Callable[[str], DataFrame], schema: str) -> DataFrame:
    """What ``read`` makes of a folder with the lines of the table as JSON-lines files of their paths.

    All paths are written and read, in parts of about PART_FILES of them; the files of a part are deleted when what
    was read of them is kept.
    """
    lines = table(spark, d, "encode_lines").where("text is not null").select("path", "line_no", F.to_json(F.struct("text")).alias("line"))
    n_paths = lines.agg(F.approx_count_distinct("path")).first()[0]
    n_parts, parts = -(-n_paths // PART_FILES), [lines.distinct()]
    if n_parts > 1:
        # By path, so that a task holds lines of one part and equal lines meet there.
        each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_parts)
        dealt = lines.repartition(n_parts * each, "path").distinct().withColumn("part", F.pmod(F.hash("path"), F.lit(n_parts)))
        dealt.write.partitionBy("part").parquet(kept := scratch_path(spark, "lines"))
        held = spark.read.parquet(kept)
        parts = [held.where(F.col("part") == r.part) for r in held.select("part").distinct().collect()]
    out = scratch_path(spark, "read")
    for part in parts if n_paths else []:
        # Of lines with one number the lesser text is the first; spelt as JSON they may be in another order.
        folder = write_lines(part, scratch_path(spark, "corpus"), (F.col("line_no").asc_nulls_last(), F.get_json_object("line", "$.text")))
        read(folder).write.mode("append").parquet(out)
        drop_path(spark, folder)
    return spark.read.schema(schema).parquet(out) if n_paths else spark.createDataFrame([], schema)


def json_join(spark: SparkSession, d: str) -> DataFrame:
    """The objects of a store under a key prefix, one text each: written as files, read back."""
    read = lambda folder: object_texts(spark, folder).select(_inside(folder).alias("path"), F.col("text").alias("joined"))
    return _corpus(spark, d, read, "path string, joined string")


def read_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a folder of JSON-lines files, each line one."""
    read = lambda folder: read_texts(spark, folder).select("path", "line_no", "text")
    return _corpus(spark, d, read, "path string, line_no long, text string")


def list_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The text files under a folder with their sizes, the largest first."""
    read = lambda folder: list_texts(spark, folder).select(_inside(folder).alias("path"), "size")
    return sort_files(_corpus(spark, d, read, "path string, size long"), "size_descending")


def _inside(folder: str) -> Column:
    return F.regexp_extract("path", folder.rsplit("/", 1)[1] + "/(.*)$", 1)


def list_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects under a key prefix with the suffixes that are read."""
    files = table(spark, d, "path_infos").where("not dir")
    return text_objects(files.select("bucket", F.regexp_replace(text.split_location("path")["key"], r"^(\./)+", "").alias("key")), "feeds/").distinct()


def newest_text(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "path_infos"), (".txt", ".md", ".jsonl")).select("path")


def newest_directory(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "path_infos"), directories=True).select("path")


def files_by_size(spark: SparkSession, d: str) -> DataFrame:
    """The whole listing, the largest first, paths without a size last."""
    return sort_files(table(spark, d, "path_infos").select("path", "size").distinct(), "size_descending")


def files_by_path(spark: SparkSession, d: str) -> DataFrame:
    """The whole listing by path."""
    return sort_files(table(spark, d, "path_infos").select("path").distinct(), "name_ascending")


def files_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return sort_files(table(spark, d, "path_infos").select("listing_id", "path").distinct(), "shuffle", seed=7)


def size_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.grouping_id().cast("bigint").alias("level"))


QUERIES = {f.__name__: f for f in (sanitize_documents, repair_garbled_lines, normalize_quotes, newline_mode, byte_alphabet_words, json_escapes, boundary_arguments, split_locations, word_split, word_freq, word_cache_rate, word_split_specials, trimmed_words, literal_positions, character_classes, json_harvest, json_join, read_corpus, list_corpus, list_objects, newest_text, newest_directory, files_by_size, files_by_path, files_shuffled, size_rollup)}


# Independent of the operator: bytes 0x80 to 0x9f read as these characters, others as that of their number; at each place a
# stretch that is the reading of a known character's bytes gives that character, two bytes and three alike.
_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_REPAIR = f"""
    with known as (select unnest(string_split({quoted(text.REPAIRED_CHARACTERS)}, '')) as c),
    raw as (select c, list_transform(range(0, octet_length(encode(c))), lambda i: ('0x' || substr(hex(encode(c)), 2 * i + 1, 2))::int) as b from known),
    form as (select c, array_to_string(list_transform(b, lambda x: case when x between 128 and 159 then substr({quoted(_HIGH)}, x - 127, 1) else chr(x) end), '') as bad from raw),
    forms as (select map_from_entries(list((bad, c))) as m, list(distinct bad) as all_bad, string_agg(distinct bad, '|' order by bad desc) filter (length(bad) = 3) || '|' || string_agg(distinct bad, '|' order by bad desc) filter (length(bad) = 2) as pattern from form),
    line as (select distinct line_id, text from encode_lines where text is not null)
    select line_id, case when regexp_matches(text, '[ÂÃÅÆËâ]') then array_to_string(list_transform(regexp_extract_all(text, pattern || '|(?s:.)'), lambda p: coalesce(m[p], p)), '') else text end as repaired from line, forms
"""
_BYTES = "[" + ", ".join(quoted(c) for c in text.byte_characters()) + "]"
#: Words of a text, line by line, in SQL.
SQL_WORDS = f"flatten(list_transform(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), lambda s: regexp_extract_all(s, {quoted(PATTERN)})))"


def sql_bytes(word: str) -> str:
    """SQL for the byte alphabet of a word, as a list."""
    return f"list_transform(range(0, octet_length(encode({word}))), lambda i: ({_BYTES})[('0x' || substr(hex(encode({word})), 2 * i + 1, 2))::int + 1])"


_KEY = "regexp_replace(case when starts_with(path, 's3://') then regexp_extract(path, '^s3://([^/]*)/?(.*)$', 2) else path end, '^(\\./)+', '')"

SQL = {
    "sanitize_documents": r"""
        with r as (select doc_id, '  ' || replace(replace(text, '. ', ' :' || chr(9)), ', ', ',  ' || chr(13) || chr(10) || chr(10) || ' ') || '\n end ' as t from documents where text is not null),
        a as (select doc_id, replace(translate(regexp_replace(replace(replace(t, chr(13), ''), '\n', chr(10)), '\n+', chr(10), 'g'), chr(9), ' '), ' :', ':') as t from r)
        select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda s: trim(regexp_replace(s, '[\t-\r ]+', ' ', 'g'), ' ' || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(133))), chr(10)) as clean from a
    """,
    "repair_garbled_lines": _REPAIR,
    "normalize_quotes": """select doc_id, lower(translate(replace(text, '…', '...'), '‘’“”', '''''""')) as plain from documents where text is not null""",
    "newline_mode": "select doc_id, ' ' || replace(text, chr(10), '</s>') as joined from documents where text is not null",
    "byte_alphabet_words": f"select word, array_to_string({sql_bytes('word')}, '') as shown from (select distinct unnest({SQL_WORDS}) as word from documents)",
    "json_escapes": "select doc_id, text as back, true as no_shorter from documents where text is not null",
    "boundary_arguments": r"select distinct job_id, context_size, hex(encode(replace(boundary, '\n', chr(10)))) as boundary_hex from pack_jobs where job_id is not null",
    "split_locations": "select distinct listing_id, starts_with(path, 's3://') as is_s3, case when starts_with(path, 's3://') then regexp_extract(path, '^s3://([^/]*)/?(.*)$', 1) else '' end as bucket, case when starts_with(path, 's3://') then regexp_extract(path, '^s3://([^/]*)/?(.*)$', 2) else path end as key from path_infos",
    "word_split": f"""
        with l as (select doc_id, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) as line, generate_subscripts(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), 1) - 1 as line_no from documents where text is not null)
        select doc_id, line_no::int as line_no, unnest(regexp_extract_all(line, {quoted(PATTERN)})) as word, (generate_subscripts(regexp_extract_all(line, {quoted(PATTERN)}), 1) - 1)::int as word_no from l
    """,
    "word_freq": f"select word, count(*) as n from (select unnest({SQL_WORDS}) as word from documents) group by word",
    "word_cache_rate": f"select sum(n)::bigint as n_words, count(*) as n_distinct, 1 - count(*) / sum(n) as hit_rate from (select word, count(*) as n from (select unnest({SQL_WORDS}) as word from documents) group by word)",
    "word_split_specials": f"""
        with l as (select doc_id, unnest(regexp_extract_all(replace(text, '. ', '.<|endoftext|> '), '[^\\n]*\\n|[^\\n]+')) as line, generate_subscripts(regexp_extract_all(replace(text, '. ', '.<|endoftext|> '), '[^\\n]*\\n|[^\\n]+'), 1) - 1 as line_no from documents where text is not null),
        p as (select doc_id, line_no, string_split(line, '<|endoftext|>') as parts from l),
        w as (select doc_id, line_no, flatten(list_transform(range(1, len(parts) + 1), lambda i: list_concat(regexp_extract_all(parts[i], {quoted(PATTERN)}), case when i < len(parts) then ['<|endoftext|>'] else [] end))) as words from p)
        select doc_id, line_no::int as line_no, unnest(words) as word, (generate_subscripts(words, 1) - 1)::int as word_no from w
    """,
    "character_classes": r"""
        with c as (select unnest(regexp_extract_all(text, '(?s).')) as c from documents),
        k as (select c, case when c = chr(10) then 'newline' when regexp_full_match(c, '[\t\x0b\f\r \x{85}\x{A0}\p{Z}]') then 'space' when regexp_full_match(c, '\p{L}') then 'letter' when regexp_full_match(c, '\p{N}') then 'number' else 'symbol' end as class from c)
        select class, count(*) as n, count(distinct c) as n_different from k group by class
    """,
    "trimmed_words": f"select doc_id, array_to_string(list_filter(list_transform({SQL_WORDS}, lambda w: trim(w, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(133))), lambda w: w <> ''), '|') as words from documents where text is not null",
    "literal_positions": """
        with p as (select doc_id, string_split(text, 'the') as parts from documents where text is not null)
        select doc_id, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x)))::bigint + (i - 1) * 3)) as at from p where len(parts) > 1
    """,
    "json_harvest": "select doc_id, text || '***' || chr(10) || coalesce(title, '') as joined from documents where text is not null",
    "json_join": "select path, string_agg(text, ' ' order by line_no, text) as joined from (select distinct path, line_no, text from encode_lines where text is not null) group by path",
    "read_corpus": """
        select path || '[' || n || ']' as path, n as line_no, text from (
            select path, text, row_number() over (partition by path order by line_no, text) - 1 as n from (select distinct path, line_no, text from encode_lines where text is not null))
    """,
    "list_corpus": r"select path, sum(octet_length(encode(to_json({'text': text}))) + 1)::bigint as size from (select distinct path, line_no, text from encode_lines where text is not null) group by path",
    "list_objects": f"select distinct bucket, {_KEY} as key from path_infos where not dir and starts_with({_KEY}, 'feeds/') and (ends_with({_KEY}, '.txt') or ends_with({_KEY}, '.jsonl'))",
    "newest_text": "select path from path_infos where not dir and mod_time is not null and (ends_with(path, '.txt') or ends_with(path, '.md') or ends_with(path, '.jsonl')) order by mod_time desc, path desc limit 1",
    "newest_directory": "select path from path_infos where dir and mod_time is not null order by mod_time desc, path desc limit 1",
    "files_by_size": "select distinct path, size from path_infos order by size desc nulls last, path",
    "files_by_path": "select distinct path from path_infos order by path",
    "files_shuffled": "select distinct listing_id, path from path_infos",
    "size_rollup": "select lang, source, count(*) as n_docs, sum(n_chars)::bigint as n_chars, grouping_id(lang, source) as level from documents where text is not null group by rollup (lang, source)",
}
