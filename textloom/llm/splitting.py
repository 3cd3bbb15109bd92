"""Problem 1: cut token sequences longer than their limit into pieces, at boundary tokens where possible.

Every boundary is joined to its farthest legal successor (overlap included) by one sorted search over
all texts of an Arrow batch; the successor tables are then squared again and again (pointer doubling),
and each squaring doubles the stretch of the greedy path known from each text's start. All texts of a
batch advance together, so a batch takes log2(longest path) vector steps and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.util import clashless, small_side, spread

#: Tokens handled at once in a Python worker; longer single texts make a batch of their own.
BATCH_TOKENS = 1_000_000

PIECES = "text_id bigint, piece_no int, start bigint, end bigint, n_tokens int, n_overlap int, kind string, tokens array<bigint>"


def greedy_cuts(lengths: np.ndarray, cut_at: np.ndarray, cut_text: np.ndarray, size: np.ndarray, overlap: np.ndarray):
    """All greedy cuts of many texts at once.

    lengths, size, overlap: per text, its tokens, limit and wanted overlap. cut_at: sorted positions in
    the joined texts where a cut is allowed, strictly inside their text; cut_text: the text of each.
    Returns (text, position, at_boundary) of the piece starts, in order; positions count in the joined
    texts. Where no boundary is in reach a piece is filled to the limit and the cut is forced.
    """
    n = len(lengths)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    step = np.maximum(size - np.clip(overlap, 0, size - 1), 1)
    pos = np.concatenate([begins, cut_at])
    text = np.concatenate([np.arange(n), cut_text])
    first = np.concatenate([np.ones(n, bool), np.zeros(len(cut_at), bool)])
    order = np.lexsort((~first, pos))
    pos, text, first = pos[order], text[order], first[order]
    m = len(pos)
    here = np.arange(m)
    reach = pos + np.where(first, size[text], step[text])
    end = ends[text]
    far = np.searchsorted(pos, np.minimum(reach, end - 1), side="right") - 1
    done = reach >= end
    # Nodes without a boundary in reach: forced cuts at reach, reach + step, ... until the next one is.
    stuck = ~done & (far <= here)
    following = np.minimum(here + 1, m - 1)
    nearest = np.where((following > here) & (text[following] == text), pos[following], end)
    s = step[text]
    forced = np.where(stuck, np.maximum(1, 1 + -(-(nearest - reach - s) // s)), 0)
    last = reach + (forced - 1) * s
    after = last + s
    far_after = np.searchsorted(pos, np.minimum(after, end - 1), side="right") - 1
    successor = np.where(done | (stuck & (after >= end)), m, np.where(stuck, far_after, far))
    marked = np.zeros(m + 1, bool)
    marked[here[first]] = True
    table = np.append(successor, m)
    while True:
        before = np.count_nonzero(marked)
        marked[table[marked]] = True
        if np.count_nonzero(marked) == before:
            break
        table = table[table]
    on = here[marked[:m]]
    reps = forced[on]
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    forced_at = np.repeat(reach[on], reps) + inner * np.repeat(s[on], reps)
    all_text = np.concatenate([text[on], np.repeat(text[on], reps)])
    all_pos = np.concatenate([pos[on], forced_at])
    natural = np.concatenate([np.ones(len(on), bool), np.zeros(len(forced_at), bool)])
    order = np.argsort(all_pos, kind="stable")
    return all_text[order], all_pos[order], natural[order]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most BATCH_TOKENS tokens, but at least one row."""
    column = batch.column("tokens")
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    total = np.cumsum(size)
    while at < len(size):
        base = total[at] - size[at]
        to = max(at + 1, int(np.searchsorted(total, base + BATCH_TOKENS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _cut(batch: pa.RecordBatch, overlapping: bool):
    column = batch.column("tokens")
    flat = column.flatten()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    number = lambda name, null: batch.column(name).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.maximum(number("context_size", 1), 1)
    overlap = number("overlap", 0) if overlapping else np.zeros(len(size), np.int64)
    boundary = number("boundary_token", -1)
    opens = batch.column("boundary_begin").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.cumsum(lengths)
    tokens = flat.fill_null(-2).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lengths)), lengths)
    hit = np.flatnonzero(tokens == boundary[of])
    text = of[hit]
    at = np.where(opens[text], hit, hit + 1)
    inside = (at > ends[text] - lengths[text]) & (at < ends[text])
    return flat, lengths, ends, size, overlap, *greedy_cuts(lengths, at[inside], text[inside], size, overlap)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            *_, text, _pos, natural = _cut(part, overlapping=False)
            forced = np.zeros(part.num_rows, bool)
            forced[text[~natural]] = True
            yield pa.RecordBatch.from_arrays([part.column("text_id"), pa.array(np.where(forced, "forced", "at_boundary"))], ["text_id", "kind"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            flat, lengths, ends, size, overlap, text, pos, natural = _cut(part, overlapping=True)
            begins = ends - lengths
            last = np.append(text[1:] != text[:-1], True)
            opening = np.insert(last[:-1], 0, True)
            number = np.arange(len(text)) - np.maximum.accumulate(np.where(opening, np.arange(len(text)), 0))
            stop = np.where(last, ends[text], np.append(pos[1:], 0))
            repeated = np.where(opening, 0, np.minimum(np.clip(overlap, 0, size - 1)[text], pos - begins[text]))
            start = pos - repeated
            count = stop - start
            index = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), flat.take(pa.array(index)))
            kind = np.where(opening, "start", np.where(natural, "at_boundary", "forced"))
            columns = [part.column("text_id").take(pa.array(text)), pa.array(number, pa.int32()), pa.array(start - begins[text], pa.int64()), pa.array(stop - begins[text], pa.int64()), pa.array(count, pa.int32()), pa.array(repeated, pa.int32()), pa.array(kind), tokens]
            yield pa.RecordBatch.from_arrays(columns, ["text_id", "piece_no", "start", "end", "n_tokens", "n_overlap", "kind", "tokens"])


def current_jobs(jobs: DataFrame, vocab: DataFrame) -> DataFrame:
    """The newest version of each job, with its boundary as a token id (null: no boundary).

    A boundary of the two characters ``\\n`` means a newline; empty means none. One that is no piece of
    the vocabulary, itself or as a single-byte piece, counts as none. Ties in ``updated_at`` go to the
    largest settings, so the choice does not depend on row order. Rows without a job id are dropped.
    """
    names = ["context_size", "boundary", "boundary_begin", "boundary_overlap"]
    newest = jobs.where("job_id is not null").groupBy("job_id").agg(F.max(F.struct("updated_at", *names)).alias("v"))
    newest = newest.select("job_id", *[f"v.{c}" for c in names]).where("context_size > 0")
    text = F.replace(F.col("boundary"), F.lit("\\n"), F.lit("\n"))
    byte = F.when(F.octet_length(text) == 1, F.concat(F.lit("0x"), F.lower(F.hex(text))))
    newest = newest.withColumn("piece", F.when(text != "", text)).withColumn("byte_piece", byte)
    ids = vocab.where("piece is not null").groupBy("piece").agg(F.min("token").alias("token"))
    newest = newest.join(ids.select("piece", F.col("token").alias("t1")), "piece", "left")
    newest = newest.join(ids.select(F.col("piece").alias("byte_piece"), F.col("token").alias("t2")), "byte_piece", "left")
    return newest.select("job_id", "context_size", F.coalesce("t1", "t2").alias("boundary_token"), "boundary_begin", F.greatest(F.coalesce("boundary_overlap", F.lit(0)), F.lit(0)).alias("overlap"))


def with_settings(docs: DataFrame, jobs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Texts joined to their job's settings; rows with null tokens, or a job that is null or unknown, are dropped."""
    held = clashless(docs, ["text_id", "job_id", "tokens"]).where("tokens is not null and job_id is not null")
    return spread(held).join(small_side(current_jobs(jobs, vocab)), "job_id")


def oversized_kinds(docs: DataFrame, jobs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(text_id, kind) of each text above its job's limit: can it be cut at boundaries alone, overlap aside?

    Repeated rows come out once (texts of one id are taken to be equal; if they are not, an id may get
    both kinds). Texts of equal length to the limit, empty ones and empty tables give no row.
    """
    over = with_settings(docs, jobs, vocab).where(F.size("tokens") > F.col("context_size"))
    needed = over.select("text_id", "tokens", "context_size", "boundary_token", "boundary_begin", "overlap")
    return needed.mapInArrow(_kinds, "text_id bigint, kind string").distinct()


def split_oversized(docs: DataFrame, jobs: DataFrame, vocab: DataFrame) -> DataFrame:
    """The pieces of every text with tokens and a known job; a text within its limit is one piece.

    Pieces hold at most ``context_size`` tokens, overlap included; an overlap of the limit or more is
    cut to one token less. ``start`` and ``end`` are token positions, ``kind`` says how the piece
    begins (start, at_boundary, forced). Repeated texts come out once, of different ones with one id the
    longest, then the largest; a text without tokens gives no piece; null tokens inside a text stay and
    are no boundary.
    """
    names = ["tokens", "context_size", "boundary_token", "boundary_begin", "overlap"]
    held = with_settings(docs, jobs, vocab).where(F.size("tokens") > 0)
    once = held.groupBy("text_id").agg(F.max(F.struct(F.size("tokens").alias("n"), *names)).alias("v"))
    needed = once.select("text_id", *[f"v.{c}" for c in names])
    return needed.mapInArrow(_pieces, PIECES)
