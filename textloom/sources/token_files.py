"""Token files, flat little-endian arrays of 16 or 32 bits, as a data source that reads, writes and streams nothing else.

    spark.dataSource.register(TokenFiles)
    df.write.format("token_files").option("wide", "false").mode("append").save(folder)
    spark.read.format("token_files").option("context_size", 2048).load(folder)

Written rows need a column ``tokens``. If they have a column ``shard``, too, each task begins a file with every new
shard; files are named by shard and task, so in the order of their names they hold the rows in the order of the
partitions written. Beside each file lies an index of its rows, with the columns ``shard`` and ``context_no`` as
far as there are any; token_index() reads it. A reader gives (path, context_no, tokens) in that order; large files
are cut into ranges of whole contexts, which are read by different tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads at most, about.
RANGE_BYTES = 64 << 20
#: Names of the list of a job's files and of the folder of their indexes.
COMMITTED, INDEX = "_TOKENS", "index"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    tokens: int


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "path string, context_no bigint, tokens array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options, [f.name for f in schema.fields], overwrite)


class TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kind = "<u4" if options.get("wide", "false").lower() == "true" else "<u2"
        self.size = int(options.get("context_size", 2048))
        self.width = int(self.kind[2])

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, inside = _system(self.path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.File:
            files = [info]
        elif system.get_file_info(f"{inside}/{COMMITTED}").type == fs.FileType.File:
            # What a lost task may have left beside is not read.
            with system.open_input_stream(f"{inside}/{COMMITTED}") as f:
                names = [n for n in f.read().decode().split("\n") if n]
            files = system.get_file_info([f"{inside}/{n}" for n in names])
        else:
            files = [f for f in system.get_file_info(fs.FileSelector(inside, recursive=True)) if f.path.endswith((".tokens", ".bin", ".chunk"))]
        step = max(1, RANGE_BYTES // (self.size * self.width)) * self.size * self.width
        files = [f for f in files if f.type == fs.FileType.File]
        return [Range(f.path, at, min(f.size, at + step)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        with system.open_input_file(part.path) as f:
            f.seek(part.start)
            raw = f.read(part.end - part.start)
        values = np.frombuffer(raw[: len(raw) - len(raw) % self.width], self.kind).astype(np.int64)
        ends = [*range(self.size, len(values), self.size), len(values)] if len(values) else []
        tokens = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values))
        first = part.start // (self.size * self.width)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(ends), pa.string()), pa.array(range(first, first + len(ends)), pa.int64()), tokens], ["path", "context_no", "tokens"])


class TokenWriter(DataSourceArrowWriter):
    """One file per task and shard, of a name of its own; files of failed tasks are removed, those of the job are listed in ``_TOKENS``."""

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.columns = options["path"].rstrip("/"), columns
        if "tokens" not in columns:
            raise ValueError("there is no column tokens")
        self.wide, self.overwrite = options.get("wide", "false").lower() == "true", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inside = _system(self.path)
        system.create_dir(f"{inside}/{INDEX}")
        most, kind = (0xFFFFFFFF, "<u4") if self.wide else (0xFFFF, "<u2")
        task, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        sink, name, shard, at, n, names, index = None, "", None, 0, 0, [], []

        def finish() -> None:
            sink.close()
            table = pa.concat_tables(index).combine_chunks()
            with system.open_output_stream(f"{inside}/{INDEX}/{name}.parquet") as f:
                pq.write_table(table, f)
            index.clear()

        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False) if "shard" in self.columns else np.zeros(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                if sink is None or shards[a] != shard:
                    if sink:
                        finish()
                    shard, at = shards[a], 0
                    name = f"{f'shard-{shard:05d}' if 'shard' in self.columns else 'part'}-{task:05d}-{mark}.tokens"
                    names.append(name)
                    sink = system.open_output_stream(f"{inside}/{name}")
                part = batch.slice(a, b - a)
                lists = part.column("tokens")
                values = lists.flatten().to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() > most):
                    raise ValueError(f"a token does not fit into {8 * int(kind[2])} bits")
                sink.write(values.astype(kind).tobytes())
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                begins = at + (np.cumsum(count) - count) * int(kind[2])
                kept = {c: part.column(c).cast(pa.int64()) for c in ("shard", "context_no") if c in self.columns}
                index.append(pa.table({"file": [name] * len(count), "offset": pa.array(begins), "tokens": pa.array(count), **kept}))
                at += len(values) * int(kind[2])
                n += len(values)
        if sink:
            finish()
        return Written(names, n)

    def commit(self, messages) -> None:
        system, inside = _system(self.path)
        system.create_dir(inside)
        kept = {n for m in messages if m for n in m.names}
        old = system.get_file_info(f"{inside}/{COMMITTED}").is_file
        if old and not self.overwrite:
            with system.open_input_stream(f"{inside}/{COMMITTED}") as f:
                kept |= {n for n in f.read().decode().split("\n") if n}
        if self.overwrite:
            from pyarrow import fs

            for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=True)):
                if f.is_file and f.path.rsplit("/", 1)[1].removesuffix(".parquet") not in kept:
                    system.delete_file(f.path)
        with system.open_output_stream(f"{inside}/{COMMITTED}") as f:
            f.write("\n".join(sorted(kept)).encode())

    def abort(self, messages) -> None:
        system, inside = _system(self.path)
        for m in messages:
            for n in m.names if m else ():
                system.delete_file(f"{inside}/{n}")
                system.delete_file(f"{inside}/{INDEX}/{n}.parquet")


def token_index(spark, folder: str):
    """(file, offset, tokens) of the rows of written token files, in bytes and tokens, with the shard and context_no they were written with, if any."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{INDEX}")


def decode_files(spark, folder: str, out: str, spec, wide: bool = False, size: int = 2048) -> int:
    """Writes the text of each token file to a text file of its name; returns the number of files.

    A file is decoded from its beginning to its end, so characters whose bytes lie in several reads stay whole,
    and nothing is put in between. A file is written under a name of its own and then renamed, so a task that
    is lost and run again leaves one whole file.
    """
    from textloom.operators.tokenizer import Shared, open_bytes

    held = Shared(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = held.decoder()
        system, inside = _system(out)
        system.create_dir(inside)
        path, sink, at, left, done = None, None, None, b"", []

        def finish() -> None:
            if left:
                sink.write(left.decode("utf-8", "replace").encode())
            sink.close()
            to = f"{inside}/{path.rsplit('/', 1)[1].rsplit('.', 1)[0]}.txt"
            system.move(at, to)
            done.append(to)

        for batch in batches:
            for p, tokens in zip(batch.column("path").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if p != path:
                    if sink:
                        finish()
                    path, left, at = p, b"", f"{inside}/.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(at)
                if spec_words:
                    sink.write(decoder(tokens).encode())
                    continue
                raw = left + decoder.raw(tokens)
                cut = len(raw) - open_bytes(raw)
                sink.write(raw[:cut].decode("utf-8", "replace").encode())
                left = raw[cut:]
        if sink:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    spec_words = bool(spec.end_of_word)
    rows = spark.read.format("token_files").option("wide", str(wide).lower()).option("context_size", size).load(folder)
    return rows.repartition("path").sortWithinPartitions("path", "context_no").select("path", "tokens").mapInArrow(run, "path string").count()
