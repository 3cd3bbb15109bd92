"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.garbled import repair_lines
from textloom.llm.languages import language_stretches, wrong_labels
from textloom.llm.leakage import find_leaks
from textloom.llm.lookalikes import canonical_form, lookalike_classes, lookalike_pairs
from textloom.llm.packing import pack_documents
from textloom.llm.splitting import oversized_kinds, split_oversized
from textloom.util import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_kinds(table(spark, d, "token_docs"), table(spark, d, "pack_jobs"), table(spark, d, "vocab"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces, their tokens joined to a string so that rows compare as plain values."""
    pieces = split_oversized(table(spark, d, "token_docs"), table(spark, d, "pack_jobs"), table(spark, d, "vocab"))
    return pieces.withColumn("tokens", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " "))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, value): the texts of the lines and the normalizers of the configs."""
    lines = table(spark, d, "encode_lines").select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), F.col("text").alias("value"))
    configs = table(spark, d, "special_configs").select(F.lit("config").alias("kind"), F.col("config_id").alias("id"), F.col("normalizer").alias("value"))
    return lines.unionByName(configs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(p2_values(spark, d), table(spark, d, "vocab"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each value that has look-alikes, with the number of its links."""
    return lookalike_classes(p2_values(spark, d), table(spark, d, "vocab"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every line and every normalizer with its canonical form, once per different value."""
    values = p2_values(spark, d).where("value is not null").distinct()
    return canonical_form(values, "value", table(spark, d, "vocab")).select("kind", "id", "canonical")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_lines(table(spark, d, "encode_lines"), table(spark, d, "lang_samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_repaired(spark, d).select("line_id").distinct()


def p5_contexts(capacity: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: pack_documents(table(spark, d, "documents"), capacity)


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("share", F.round("share", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_shares(spark, d).select("doc_id", "eval_id")


def p7_stretches(spark: SparkSession, d: str) -> DataFrame:
    found = language_stretches(table(spark, d, "documents"), table(spark, d, "lang_samples"))
    return found.select("doc_id", "stretch_no", "start", "end", "lang", F.round("confidence", 6).alias("confidence"), "n_words")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_canonical": p2_canonical,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p5_contexts_1024": p5_contexts(1024),
    "p5_contexts_512": p5_contexts(512),
    "p5_contexts_2048": p5_contexts(2048),
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_stretches": p7_stretches,
}

# The boundary test needs only the largest gap between cuts, which SQL can say; the pieces themselves,
# look-alikes, encodings, packing, passages and languages are tested against brute force instead.
_JOBS = r"""
    newest as (
        select job_id, context_size, coalesce(boundary_begin, false) as boundary_begin, greatest(coalesce(boundary_overlap, 0), 0) as overlap, nullif(replace(boundary, '\n', chr(10)), '') as b
        from pack_jobs where job_id is not null
        qualify row_number() over (partition by job_id order by updated_at desc nulls last, context_size desc) = 1
    ), jobs as (
        select n.job_id, n.context_size, n.boundary_begin, n.overlap, min(v.token) as token
        from newest n left join vocab v on v.piece = n.b group by all
    )
"""

SQL: dict[str, str] = {
    "p1_found": r"""
        with newest as (
            select job_id, context_size, boundary_begin, nullif(replace(boundary, '\n', chr(10)), '') as b
            from pack_jobs where job_id is not null
            qualify row_number() over (partition by job_id order by updated_at desc nulls last, context_size desc) = 1
        ), jobs as (
            select n.job_id, n.context_size, n.boundary_begin, min(v.token) as token
            from newest n left join vocab v on v.piece = n.b group by all
        ), cut as (
            select distinct t.text_id, j.context_size,
                list_concat([0::bigint], list_filter(list_transform(list_filter(range(1, len(t.tokens) + 1), lambda i: t.tokens[i] = j.token),
                    lambda i: case when j.boundary_begin then i - 1 else i end), lambda c: c > 0 and c < len(t.tokens)), [len(t.tokens)]) as cuts
            from token_docs t join jobs j using (job_id)
            where t.tokens is not null and len(t.tokens) > j.context_size
        )
        select text_id, case when list_max(list_transform(range(2, len(cuts) + 1), lambda k: cuts[k] - cuts[k - 1])) <= context_size
            then 'at_boundary' else 'forced' end as kind
        from cut
    """,
    "p1_pieces": f"""
        with recursive {_JOBS}, base as (
            select distinct t.text_id, t.tokens, len(t.tokens) as n, j.context_size as size, least(j.overlap, j.context_size - 1) as overlap, greatest(j.context_size - j.overlap, 1) as step,
                list_filter(list_transform(list_filter(range(1, len(t.tokens) + 1), lambda i: t.tokens[i] = j.token), lambda i: case when j.boundary_begin then i - 1 else i end), lambda c: c > 0 and c < len(t.tokens)) as cuts
            from token_docs t join jobs j using (job_id) where len(t.tokens) > 0
        ), r(text_id, piece_no, pos, kind) as (
            select text_id, 0, 0::bigint, 'start' from base
            union all
            select text_id, piece_no + 1, coalesce(c, pos + reach), case when c is null then 'forced' else 'at_boundary' end
            from (select r.text_id, piece_no, pos, n, case when piece_no = 0 then size else step end as reach, list_max(list_filter(cuts, lambda x: x > pos and x <= pos + case when piece_no = 0 then size else step end)) as c from r join base using (text_id))
            where pos + reach < n
        ), piece as (
            select text_id, piece_no, kind, tokens, case when piece_no = 0 then 0 else least(overlap, pos) end as n_overlap, pos, coalesce(lead(pos) over (partition by text_id order by piece_no), n) as "end" from r join base using (text_id)
        )
        select text_id, piece_no::int as piece_no, pos - n_overlap as "start", "end", ("end" - pos + n_overlap)::int as n_tokens, n_overlap::int as n_overlap, kind, array_to_string(list_slice(tokens, pos - n_overlap + 1, "end"), ' ') as tokens
        from piece
    """,
}
