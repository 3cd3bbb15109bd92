"""Far too many small files: plan containers for a listing, and consolidate Parquet files by their encoded blocks.

Consolidation copies the column chunks of whole row groups byte for byte into larger files and rewrites
only the footers; no value is decoded. Schemas, block counts and row totals are checked per container
and again over all of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources.parquet_blocks import BlockFile, read_footer
from textloom.util import clashless, materialize, scratch_path, small_side

#: Files of fewer bytes than this are small.
SMALL_BYTES = 65_536
#: Size aimed at for a container.
TARGET_BYTES = 128 << 20
#: Containers' worth of bytes that one planning group holds on average.
GROUP_CONTAINERS = 8


def relative_path(bucket: str | Column, path: str | Column) -> Column:
    """The shortest spelling of a path within its bucket: no ``s3://`` and bucket, no empty and ``.`` steps."""
    inner = F.regexp_replace(path, r"^s3://[^/]*/?", "")
    return F.array_join(F.filter(F.split(inner, "/"), lambda s: (s != "") & (s != ".")), "/")


def current_files(listing: DataFrame) -> DataFrame:
    """(bucket, path, size) of each file of a listing, by its newest row with a size.

    Rows that are directories, or have no path or size, say nothing of a file. Several spellings of one
    path in a bucket are one file. Rows listed at the same time: the largest size holds. A null bucket
    counts as one with an empty name.
    """
    held = clashless(listing, ["bucket", "path", "size", "dir", "listed_at"]).withColumn("bucket", F.coalesce("bucket", F.lit("")))
    held = held.where("not dir and size is not null and path is not null").withColumn("path", relative_path("bucket", "path"))
    newest = held.groupBy("bucket", "path").agg(F.max(F.struct("listed_at", "size")).alias("v"))
    return newest.select("bucket", "path", F.col("v.size").alias("size")).where("path <> ''")


def small_files(listing: DataFrame, suffixes: tuple[str, ...] = (".txt", ".md", ".jsonl"), below: int = SMALL_BYTES) -> DataFrame:
    """The files of a listing that end in one of the suffixes and have from 1 to ``below`` - 1 bytes."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return current_files(listing).where(ends & F.col("size").between(1, below - 1))


def plan_containers(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """Adds ``container``: files of a bucket whose sizes fill about ``target`` bytes share one. Its name can be that of a file.

    Each bucket is cut into hashed groups of some containers' worth of bytes, and a running sum within
    the group assigns its files; so a bucket that holds a third of all files is planned by many tasks,
    and no window ever spans it. A container exceeds the target by less than its last file, and at most
    one container of a group stays underfilled.
    """
    total = files.groupBy(F.col("bucket").alias("of_bucket")).agg(F.sum("size").alias("bucket_bytes"))
    total = small_side(total.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("bucket_bytes") / (target * GROUP_CONTAINERS)))))
    joined = files.join(total, F.col("bucket") == F.col("of_bucket")).drop("of_bucket")
    grouped = joined.withColumn("group", F.pmod(F.xxhash64("path"), "groups"))
    before = F.sum("size").over(Window.partitionBy("bucket", "group").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    safe = F.concat(F.regexp_replace("bucket", r"[^A-Za-z0-9_.-]", "_"), F.lit("."), F.lower(F.hex(F.xxhash64("bucket"))))
    bucket = F.when(F.col("bucket").rlike(r"^[A-Za-z0-9_.-]*$"), F.col("bucket")).otherwise(safe)
    name = F.format_string("%s-%05d-%05d", bucket, F.col("group"), F.floor(before / target))
    return grouped.withColumn("container", name).select("bucket", "path", "size", "container")


#: Fragments in which the files of a container are written at once, before their blocks are copied into it.
FRAGMENTS = 4

COPIED = "container string, target string, source string, rows bigint, blocks bigint, bytes bigint, fingerprint string"


def _open(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, inside


def _copy(batches: Iterator[pa.RecordBatch], out_dir: str, target: int) -> Iterator[pa.RecordBatch]:
    """Copies the files of one partition, sorted by container, into one file per container and schema, or into as few as hold those without a container."""
    open_files: dict[str, list] = {}
    done = []
    current = None

    def finish(print_: str) -> None:
        sink, built, path, sources = open_files.pop(print_)
        expected, blocks = built.rows, len(built.groups)
        size = built.close()
        sink.close()
        system, inside = _open(path)
        with system.open_input_file(inside) as f:
            again = read_footer(f, size)
        if again.rows != expected or len(again.blocks) != blocks or again.fingerprint != print_:
            raise ValueError(f"{path} does not hold what was copied into it")
        if sum(s[1] for s in sources) != again.rows or sum(s[2] for s in sources) != blocks:
            raise ValueError(f"{path} and its sources differ in rows or blocks")
        done.extend((current, path, *s, print_) for s in sources)

    for batch in batches:
        for container, path, size in zip(*(batch.column(c).to_pylist() for c in ("container", "path", "size")), strict=True):
            if container != current:
                for key in list(open_files):
                    finish(key)
                current = container
            system, inside = _open(path)
            with system.open_input_file(inside) as f:
                footer = read_footer(f, size)
                key = footer.fingerprint
                if key not in open_files:
                    # A name of its own for every attempt: what a lost task left is never committed.
                    label = re.sub(r"[^A-Za-z0-9_.-]", "_", container) if container is not None else "block"
                    to = f"{out_dir}/{label}-{uuid.uuid4().hex}.parquet"
                    to_system, to_inside = _open(to)
                    sink = to_system.open_output_stream(to_inside)
                    open_files[key] = [sink, BlockFile(sink), to, []]
                _sink, built, _to, sources = open_files[key]
                copied = built.append(f, footer)
                sources.append((path, footer.rows, len(footer.blocks), copied))
            if container is None and built.at >= target:
                finish(key)
    for key in list(open_files):
        finish(key)
    columns = list(zip(*done, strict=True)) or [[]] * 7
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["container", "target", "source", "rows", "blocks", "bytes", "fingerprint"])


def _moved(batches: Iterator[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    """Moves copied containers into the folder of committed ones; one that a former attempt has moved stays there."""
    from pyarrow import fs

    for batch in batches:
        targets = []
        for path in batch.column("target").to_pylist():
            to = f"{out_dir}/{path.rsplit('/', 1)[1]}"
            system, inside = _open(path)
            _, to_inside = _open(to)
            if system.get_file_info(inside).type == fs.FileType.File:
                system.move(inside, to_inside)
            elif system.get_file_info(to_inside).type != fs.FileType.File:
                raise ValueError(f"{path} is gone and was not committed")
            targets.append(to)
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string())], ["target"])


def list_parquet(spark: SparkSession, directory: str) -> DataFrame:
    """(path, size) of the Parquet files under a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(directory)
    return found.select("path", F.col("length").alias("size"))


def compact_parquet(spark: SparkSession, directory: str, out_dir: str, target: int = TARGET_BYTES, files: DataFrame | None = None) -> DataFrame:
    """Consolidates the Parquet files under a folder into files of about ``target`` bytes under another.

    files: (container, path, size) if it is planned which files share a container; each then is one file, or one
    per schema. Returns the manifest: one row per source, with the container that holds its blocks. Containers are
    copied beside ``out_dir`` and checked; only those of the manifest are moved into it, so it holds nothing of
    lost attempts, and no record is lost or doubled. Files of different schemas never share a file. An empty
    folder gives an empty manifest.
    """
    attempts = f"{out_dir.rstrip('/')}-attempts"
    for folder in (out_dir, attempts):
        system, inside = _open(folder)
        system.create_dir(inside)
    if files is None:
        files = list_parquet(spark, directory).select(F.lit(None).cast("string").alias("container"), "path", "size")
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.count_distinct("container").alias("containers")).first()
    tasks = max(1, min(total["n"], max(total["containers"], -(-total["bytes"] // target))))
    dealt = files.repartition(int(tasks), F.coalesce(F.xxhash64("container"), F.lit(0)), F.when(F.col("container").isNull(), F.xxhash64("path"))).sortWithinPartitions("container", "path")
    copied = materialize(dealt.select("container", "path", "size").mapInArrow(lambda it: _copy(it, attempts, target), COPIED), "copied")
    held = copied.agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).first()
    if held["sources"] != total["n"] or held["n"] != total["n"]:
        raise ValueError(f"{total['n']} files were listed, {held['sources']} were consolidated, in {held['n']} rows")
    moved = materialize(copied.select("target").distinct().mapInArrow(lambda it: _moved(it, out_dir.rstrip("/")), "target string"), "committed")
    name = lambda c: F.substring_index(c, "/", -1)
    return copied.withColumn("name", name("target")).drop("target").join(moved.withColumn("name", name("target")), "name").drop("name")


def store_small_files(listing: DataFrame, lines: DataFrame, target: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Puts the small files of a listing, with their lines, into few large Parquet files.

    Returns the stored files (container, bucket, path, size, lines), read back from the consolidated
    files, and the manifest of the consolidation. Each container is written in several fragments at once, whose
    blocks are then copied into one file. Lines are those delivered for small files; each is stored exactly once,
    with its file: of several deliveries of a ``line_id`` the newest holds, ties by content. A file holds less than
    SMALL_BYTES bytes, so its lines fit in a row. Lines of paths that are not small files, and those without an
    id, are not stored; files without lines hold none.
    """
    spark = listing.sparkSession
    planned = materialize(plan_containers(small_files(listing), target), "plan")
    content = ["line_no", "text", "hex"]
    given = clashless(lines, ["line_id", "bucket", "path", *content, "read_at"]).where("line_id is not null and path is not null")
    given = given.withColumn("bucket", F.coalesce("bucket", F.lit(""))).withColumn("path", relative_path("bucket", "path"))
    # A path of very many lines that is no small file would end in one task only to be dropped; it is dropped before.
    many = given.groupBy("bucket", "path").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_BYTES).join(planned, ["bucket", "path"], "left_anti")
    given = given.join(small_side(many.select("bucket", "path")), ["bucket", "path"], "left_anti")
    # One shuffle on bucket and path serves the join and both aggregations, whose keys begin with them.
    joined = planned.join(given, ["bucket", "path"], "left")
    once = joined.groupBy("bucket", "path", "container", "size", "line_id").agg(F.max(F.struct("read_at", *content)).alias("v"))
    line = F.when(F.col("line_id").isNotNull(), F.struct("v.line_no", "line_id", "v.text", "v.hex"))
    held = once.groupBy("bucket", "path", "container", "size").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    held = held.select("container", "bucket", "path", "size", "lines")
    fragments = scratch_path(spark, "fragments")
    # The planned name is a column of the files and the name of their folder.
    dealt = held.withColumn("of", F.col("container")).withColumn("fragment", F.pmod(F.xxhash64("path"), F.lit(FRAGMENTS)))
    dealt.repartition("container", "fragment").sortWithinPartitions("container", "path").drop("fragment").write.partitionBy("of").parquet(fragments)
    manifest = compact_parquet(spark, fragments, where := scratch_path(spark, "containers"), target, _fragments(spark, fragments))
    stored = spark.read.schema(held.schema).parquet(where)
    rows, n = manifest.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], planned.count()
    if rows != n:
        raise ValueError(f"{n} files were planned, {rows} are stored")
    return stored, manifest


def _fragments(spark: SparkSession, directory: str) -> DataFrame:
    """(container, path, size) of fragments written in a folder per container."""
    found = list_parquet(spark, directory)
    folder = F.regexp_extract("path", r"/of=([^/]*)/[^/]*$", 1)
    return found.select(folder.alias("container"), "path", "size")


def stored_lines(stored: DataFrame) -> DataFrame:
    """(line_id, container, bucket, path, line_no, text, hex) of the stored files, each line once."""
    each = stored.select("container", "bucket", "path", F.explode("lines").alias("l"))
    return each.select("l.line_id", "container", "bucket", "path", "l.line_no", "l.text", "l.hex")
