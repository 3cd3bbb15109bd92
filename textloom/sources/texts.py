"""Reading corpora of text, Markdown and JSON-lines files as documents."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from textloom.functions.text import sanitize, split_location
from textloom.operators.ordering import sort_columns
from textloom.util import materialize

SUFFIXES = (".txt", ".md", ".jsonl")
#: What stands between several texts of one JSON line.
TEXT_JOIN = "***\n"
#: Bytes of a file of lines that are read at once; several tasks share a larger one.
PIECE = 16 << 20
#: Files and bytes that a task reads, about.
TASK_FILES, TASK_BYTES = 10_000, 128 << 20
#: Bytes that fill an Arrow batch.
BATCH_BYTES = 4 << 20


def _system(uri: str):
    """The file system of a URI, and the path in it; names stand in the URI as they are, not encoded."""
    from pyarrow import fs

    scheme, host, path = re.fullmatch(r"(?s)([A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)?", uri).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), path or "/"
    system, top = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host or ''}/")
    return system, (top.rstrip("/") + (path or "")).rstrip("/") or "/"


def _walk(suffixes: tuple[str, ...], down: bool):
    """For mapInArrow: what lies in the folders of each batch, or the files named there; ``down``: below them, too.

    Files without content are left out, and so is what is hidden, as Spark's readers do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(todo: list[str], named: bool) -> Iterator[tuple]:
            while todo:
                uri = todo.pop()
                system, path = _system(uri)
                top = system.get_file_info(path) if named else None
                for f in [top] if top and top.is_file else system.get_file_info(fs.FileSelector(path)):
                    name, at = f.base_name, uri if f is top else f"{uri.rstrip('/')}/{f.base_name}"
                    if f is not top and (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)):
                        continue
                    if f.type == fs.FileType.Directory:
                        if down:
                            todo.append(at)
                        else:
                            yield at, None, None, True
                    elif f.size and name.endswith(suffixes):
                        yield at, f.size, f.mtime_ns and f.mtime_ns // 1000, False

        def packed(held: list[tuple]) -> pa.RecordBatch:
            path, size, mod_time, is_dir = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(mod_time, pa.timestamp("us", "UTC")), pa.array(is_dir, pa.bool_())], ["path", "size", "mod_time", "dir"])

        held: list[tuple] = []
        for batch in batches:
            for uri, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in rows([uri], named):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield packed(held)
                        held = []
        if held:
            yield packed(held)

    return run


def _list_files(spark: SparkSession, where: str | list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """(path, size, mod_time, dir) of the files with these suffixes under folders, or named themselves.

    Tasks list the folders, level by level until there are enough for all cores to walk down from, and write what
    they find to the shared folder; the driver holds no file, however many there are.
    """
    paths, jvm = [], spark.sparkContext._jvm.org.apache.hadoop.fs
    for w in [where] if isinstance(where, str) else where:
        asked = jvm.Path(w)
        system = asked.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = system.globStatus(system.makeQualified(asked))
        if not found:
            raise ValueError(f"no file or folder {w}")
        paths += [f.getPath().toString() for f in found]
    cores, levels = spark.sparkContext.defaultParallelism, []
    folders, n, named = spark.createDataFrame([(p,) for p in paths], "path string"), len(paths), True
    while n:
        down = n >= 4 * cores
        dealt = folders.select("path", F.lit(named).alias("named")).repartition(min(n, 2 * cores))
        levels.append(materialize(dealt.mapInArrow(_walk(suffixes, down), "path string, size long, mod_time timestamp, dir boolean"), "listing"))
        folders, named = levels[-1].where("dir"), False
        n = 0 if down else folders.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("not dir")


def list_texts(spark: SparkSession, where: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, size, mod_time, dir) of the text files under folders, or of a file named itself; contents are not read.

    ValueError if there is none.
    """
    found = _list_files(spark, where, suffixes)
    if found.isEmpty():
        raise ValueError(f"no text files under {where}")
    return found


def _of_suffix(files: DataFrame, *suffixes: str) -> DataFrame:
    return files.where(" or ".join(f"endswith(path, '{s}')" for s in suffixes))


def harvest(value) -> list[str]:
    """All strings under a key ``text``, at any depth of objects and lists of objects, in the order they stand; ValueError for a ``text`` that is no string."""
    out: list[str] = []
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "text":
                if not isinstance(v, str):
                    raise ValueError("a text that is no string")
                out.append(v)
            elif isinstance(v, dict | list):
                out += harvest(v)
    elif isinstance(value, list):
        for v in value:
            if isinstance(v, dict | list):
                out += harvest(v)
    return out


def json_texts(line: str | Column) -> Column:
    """The texts of a JSON line, as an array; null for a line that is no JSON object or whose text is no string."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for line in part.to_pylist():
                try:
                    value = json.loads(line)
                    out.append(harvest(value) if isinstance(value, dict) else None)
                except (TypeError, ValueError, RecursionError):
                    out.append(None)
            yield pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<string>")(line)


def _record_bytes(f, start: int, end: int, size: int) -> bytes:
    """The records, each ended by a line feed, that begin from start to end."""
    f.seek(max(start - 1, 0))
    data = f.read(end - max(start - 1, 0))
    if start:
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    if not data or data.endswith(b"\n") or end >= size:
        return data
    parts = [data]
    while more := f.read(1 << 16):
        parts.append(more[: more.find(b"\n") + 1] or more)
        if parts[-1].endswith(b"\n"):
            break
    return b"".join(parts)


def _read(pieces: DataFrame, whole: bool, skip: bool, n_tasks: int) -> DataFrame:
    """(path, start, shift, lines) of pieces (path, size, start, end, shift) of files, read in tasks; ``whole``: the text as one line.

    skip: files that can't be read are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["path", "start", "shift", "lines"])

        held, n_bytes = [], 0
        for batch in batches:
            for path, size, start, end, shift in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inside = _system(path)
                try:
                    with system.open_input_file(inside) as f:
                        data = f.read() if whole else _record_bytes(f, start, end, size)
                except OSError:
                    if skip:
                        continue
                    raise
                # Lines end as in Spark's text reader, and its byte order mark is none of the text.
                lines = [data] if whole else (data if start else data.removeprefix(b"\xef\xbb\xbf")).splitlines()
                held.append((path, start, shift, lines))
                n_bytes += len(data) + len(path) + 16
                if n_bytes > BATCH_BYTES:
                    yield packed()
                    held, n_bytes = [], 0
        if held:
            yield packed()

    dealt = pieces.select("path", "size", "start", "end", "shift").repartition(n_tasks)
    return dealt.mapInArrow(run, "path string, start long, shift long, lines array<binary>").withColumn("lines", F.col("lines").cast("array<string>"))


def _pieces(files: DataFrame, whole: bool = False, skip: bool = False) -> tuple[DataFrame, bool]:
    """(path, start, shift, lines) of listed files, shift being the lines before a piece; and whether each file is a single piece.

    ``whole``: each file's text is one line.
    """
    n, n_bytes, most = files.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    n_tasks = max(min(n, files.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-(n_bytes or 0) // TASK_BYTES), 1)
    first = F.lit(0).cast("long")
    if whole or not n or most <= PIECE:
        return _read(files.withColumns({"start": first, "end": F.col("size"), "shift": first}), whole, skip, n_tasks), True
    starts = files.select("path", "size", F.explode(F.sequence(first, F.col("size") - 1, F.lit(PIECE).cast("long"))).alias("start"))
    cut = starts.withColumns({"end": F.least(F.col("start") + PIECE, "size"), "shift": first})
    # Of large files the lines are counted first: only the counts meet, lines stay in the tasks that read them.
    counts = materialize(_read(cut.where(f"size > {PIECE}"), False, skip, n_tasks).select("path", "start", F.size("lines").alias("n")), "lines")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    shifted = cut.drop("shift").join(counts.select("path", "start", before.alias("before")), ["path", "start"], "left").withColumn("shift", F.coalesce("before", first))
    return _read(shifted, False, skip, n_tasks), False


def _numbered(files: DataFrame) -> DataFrame:
    return _pieces(files)[0].select("path", "shift", F.posexplode("lines").alias("k", "line")).select("path", (F.col("shift") + F.col("k")).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, where: str | list[str], suffix: str = ".jsonl") -> DataFrame:
    """(path, line_no, line) of the lines of files, numbered from 0; the last line counts with or without its newline.

    A large file is read in pieces; lines are numbered within their piece, and pieces are shifted by the lines
    before them, so one file of any size is numbered by many tasks. A task reads many small files.
    """
    return _numbered(_list_files(spark, where, (suffix,)))


def read_texts(spark: SparkSession, where: str, clean: bool = False, sort_spec: str | None = "none", seed: int = 0) -> DataFrame:
    """(path, text, rank) of the documents under a folder: a text or Markdown file is one, and every JSON line is one.

    ``path`` is relative to the folder; lines are named ``path[number]``. Lines that are no JSON, or hold
    no text, are skipped but count. ``rank`` orders the documents by the sort specification over files.
    """
    files = list_texts(spark, where)
    whole = _pieces(_of_suffix(files, ".txt", ".md"), whole=True)[0]
    texts = _numbered(_of_suffix(files, ".jsonl")).withColumn("texts", json_texts("line")).where("size(texts) > 0")
    parsed = texts.select("path", "line_no", F.array_join("texts", TEXT_JOIN).alias("text"))
    plain = whole.select("path", F.lit(None).cast("bigint").alias("line_no"), F.col("lines")[0].alias("text")).unionByName(parsed)
    if clean:
        plain = plain.withColumn("text", sanitize("text"))
    order = sort_columns(sort_spec, seed)
    ranked = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("p"), F.struct(*[c for c in _rank_values(sort_spec, seed)]).alias("rank")) if order else None
    named = plain.withColumn("p", F.regexp_replace("path", r"^file:/+", "/"))
    out = named.join(ranked, "p") if ranked is not None else named.withColumn("rank", F.struct(F.col("path").alias("by")))
    root = re.sub(r"^file:/+", "/", where).rstrip("/")
    prefix = root if not root.endswith(SUFFIXES) else root.rsplit("/", 1)[0]
    short = F.when(F.startswith(F.col("p"), F.lit(prefix + "/")), F.substring(F.col("p"), len(prefix) + 2, 1 << 30)).otherwise(F.col("p"))
    name = F.when(F.col("line_no").isNull(), short).otherwise(F.concat(short, F.lit("["), F.col("line_no").cast("string"), F.lit("]")))
    return out.select(name.alias("path"), "text", "rank", "line_no")


def _rank_values(spec: str | None, seed: int) -> list[Column]:
    """Values that ascend in the order of a sort specification."""
    spec = (spec or "none").lower()
    if spec in ("shuffle", "random"):
        return [F.xxhash64(F.lit(seed), F.col("path")).alias("by"), F.col("path").alias("then")]
    name, _, way = spec.partition("_")
    if name == "size":
        return [(F.col("size") if way.startswith("asc") else -F.col("size")).alias("by"), F.col("path").alias("then")]
    return [F.col("path").alias("by"), F.col("path").alias("then")]


def text_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """The rows of an object listing (a column ``key``) under a key prefix that are read as texts: .txt and .jsonl; Markdown is not."""
    return objects.where(F.col("key").startswith(prefix) & (F.col("key").endswith(".txt") | F.col("key").endswith(".jsonl")))


def write_lines(lines: DataFrame, folder: str, order: tuple[str | Column, ...] = ("line_no", "line")) -> str:
    """Writes the lines (path, line_no, line) of each path to a file of that path under a folder, in their order; returns the folder.

    A file is written under a name of its own and then renamed, so a task that runs again leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        path, sink, at, done, made = None, None, None, [], set()

        def begin() -> None:
            nonlocal sink, at
            # In the folder of the file: tasks that make and move all their files in one folder wait for each other.
            within = f"{inside}/{path}".rpartition("/")[0]
            if within not in made:
                system.create_dir(within)
                made.add(within)
            at = f"{within}/.{uuid.uuid4().hex}"
            sink = system.open_output_stream(at)

        def finish() -> None:
            sink.close()
            system.move(at, f"{inside}/{path}")
            done.append(path)

        system.create_dir(inside)
        for batch in batches:
            for p, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    if sink:
                        finish()
                    path = p
                    begin()
                sink.write(f"{line}\n".encode())
        if sink:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    # In an order of the paths' hashes, so that tasks don't go through the same folders side by side and wait for each other.
    lines.repartition("path").sortWithinPartitions(F.xxhash64("path"), "path", *order).select("path", "line").mapInArrow(run, "path string").count()
    return folder


def object_texts(spark: SparkSession, where: str, prefix: str = "", clean: bool = False) -> DataFrame:
    """(path, text) of an object store's .txt and .jsonl objects under a key prefix; Markdown is not read.

    A .jsonl object is one document: the top-level texts of its lines, joined by a space. Objects that
    can't be read are skipped.
    """
    files = _list_files(spark, where, (".txt", ".jsonl"))
    plain = _pieces(_of_suffix(files, ".txt"), whole=True, skip=True)[0].select("path", F.col("lines")[0].alias("text"))
    pieces, single = _pieces(_of_suffix(files, ".jsonl"), skip=True)
    texts = F.filter(F.transform("lines", lambda x: F.get_json_object(x, "$.text")), lambda x: x.isNotNull())
    joined = pieces.select("path", "shift", texts.alias("texts")).where("size(texts) > 0").select("path", "shift", F.array_join("texts", " ").alias("text"))
    if single:
        joined = joined.select("path", "text")
    else:
        joined = joined.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shift", "text"))), lambda x: x.text), " ").alias("text"))
    out = plain.unionByName(joined)
    if prefix:
        out = out.where(split_location("path")["key"].startswith(prefix))
    return out.withColumn("text", sanitize("text")) if clean else out
