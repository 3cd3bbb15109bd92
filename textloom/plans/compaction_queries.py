"""Queries on the listing of corpus files and their consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.compaction import plan_containers, small_files, store_small_files, stored_lines
from textloom.util import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The small files, as they stand in the consolidated containers."""
    stored, _ = store_small_files(table(spark, d, "path_infos"), table(spark, d, "encode_lines"))
    return stored.select("path")


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the small files, as they stand in the consolidated containers, each once."""
    stored, _ = store_small_files(table(spark, d, "path_infos"), table(spark, d, "encode_lines"))
    return stored_lines(stored).select("line_id", "path", "line_no", "text", "hex")


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    """The containers planned: their bucket, number of files and bytes."""
    planned = plan_containers(small_files(table(spark, d, "path_infos")))
    return planned.groupBy("bucket", "container").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


QUERIES = {"p4_found": p4_found, "p4_lines": p4_lines, "p4_plan": p4_plan}

_FILES = r"""
    select bucket, p as path, size from (
        select bucket, size, listed_at, array_to_string(list_filter(string_split(regexp_replace(path, '^s3://[^/]*/?', ''), '/'), lambda x: x <> '' and x <> '.'), '/') as p
        from path_infos where not dir and size is not null and path is not null)
    where p <> '' qualify row_number() over (partition by bucket, p order by listed_at desc, size desc) = 1
"""
_SMALL = rf"select * from ({_FILES}) where size between 1 and 65535 and regexp_matches(path, '\.(txt|md|jsonl)$')"

SQL = {
    "p4_found": f"select path from ({_SMALL})",
    "p4_lines": f"""
        with l as (select line_id, bucket, path, line_no, text, hex from encode_lines where line_id is not null
            qualify row_number() over (partition by line_id order by read_at desc, bucket desc, path desc, line_no desc, text desc nulls last, hex desc nulls last) = 1)
        select l.line_id, l.path, l.line_no, l.text, l.hex from l join ({_SMALL}) f on f.bucket = l.bucket and f.path = l.path
    """,
}
