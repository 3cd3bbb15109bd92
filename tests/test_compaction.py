import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.operators import compaction
from textloom.sources.parquet_blocks import BlockFile, read_footer

T0 = datetime(2024, 1, 1)


def write(folder, n, rows=7, **extra):
    os.makedirs(folder, exist_ok=True)
    for k in range(n):
        t = pa.table({"k": [k * rows + j for j in range(rows)], "s": [None if j % 3 == 0 else f"x{j}" for j in range(rows)], "l": [[j, None] for j in range(rows)], "b": [j % 2 == 0 for j in range(rows)], **{c: [v] * rows for c, v in extra.items()}})
        pq.write_table(t, f"{folder}/f{k}.parquet", row_group_size=3, compression=["snappy", "zstd", "none"][k % 3], use_dictionary=k % 2 == 0)


def test_blocks_read_back(tmp_path):
    write(f"{tmp_path}/in", 5)
    out = f"{tmp_path}/out.parquet"
    with open(out, "wb") as sink:
        built = BlockFile(sink)
        for k in range(5):
            path = f"{tmp_path}/in/f{k}.parquet"
            with open(path, "rb") as f:
                built.append(f, read_footer(f, os.path.getsize(path)))
        size = built.close()
    assert size == os.path.getsize(out)
    got = pq.read_table(out)
    wanted = pa.concat_tables([pq.read_table(f"{tmp_path}/in/f{k}.parquet") for k in range(5)])
    assert got.equals(wanted)
    assert pq.ParquetFile(out).metadata.num_row_groups == 15
    # Statistics survive, so row groups can still be skipped.
    assert pq.read_table(out, filters=[("k", "=", 30)]).num_rows == 1


def test_refuses_other_files(tmp_path):
    for name, content in (("a", b""), ("b", b"PAR1" + b"x" * 20)):
        (tmp_path / name).write_bytes(content)
        with open(tmp_path / name, "rb") as f, pytest.raises(ValueError):
            read_footer(f, len(content))
    write(f"{tmp_path}/one", 1)
    write(f"{tmp_path}/two", 1, other=1)
    with open(tmp_path / "o", "wb") as sink:
        built = BlockFile(sink)
        for folder in ("one", "two"):
            path = f"{tmp_path}/{folder}/f0.parquet"
            with open(path, "rb") as f:
                footer = read_footer(f, os.path.getsize(path))
                if folder == "two":
                    with pytest.raises(ValueError):
                        built.append(f, footer)
                else:
                    built.append(f, footer)


def test_compact_folder(spark, tmp_path):
    write(f"{tmp_path}/in/a", 40)
    write(f"{tmp_path}/in/b", 3, other=1)
    manifest = compaction.compact_parquet(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", target=30_000).cache()
    assert manifest.count() == 43 and manifest.select("source").distinct().count() == 43
    per = manifest.groupBy("target").agg(F.count_distinct("fingerprint").alias("n"), F.sum("rows").alias("rows"))
    assert per.where("n > 1").count() == 0
    assert 1 < per.count() < 12
    kept = [r[0] for r in manifest.where("source like '%/a/%'").select("target").distinct().collect()]
    assert sorted(r[0] for r in spark.read.parquet(*kept).select("k").collect()) == list(range(280))
    assert manifest.agg(F.sum("rows")).first()[0] == 43 * 7


def test_committed_folder_holds_the_manifest_and_nothing_else(spark, tmp_path):
    """Containers of lost attempts stay outside, and moving again changes nothing."""
    write(f"{tmp_path}/in", 9)
    files = compaction.list_parquet(spark, f"{tmp_path}/in").withColumn("container", F.concat(F.lit("c/"), F.col("size") % 3))
    (tmp_path / "out-attempts").mkdir()
    pq.write_table(pa.table({"k": [1]}), tmp_path / "out-attempts" / "lost.parquet")
    manifest = compaction.compact_parquet(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", files=files).cache()
    targets = {r.target for r in manifest.collect()}
    assert {f"file://{tmp_path}/out/{n}" for n in os.listdir(tmp_path / "out")} == targets and len(targets) == manifest.select("container").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 63
    batch = pa.RecordBatch.from_arrays([pa.array([t.replace("/out/", "/out-attempts/") for t in targets])], ["target"])
    assert set(next(iter(compaction._moved(iter([batch]), f"file://{tmp_path}/out"))).column(0).to_pylist()) == targets


def test_files_are_the_planned_containers(spark, monkeypatch):
    rows = [(f"b {k % 3}", f"x/{k}.txt", 1000 + k, False, T0) for k in range(60)]
    files = listing(spark, rows)
    lines = spark.createDataFrame([], "line_id long, bucket string, path string, line_no int, text string, hex string, read_at timestamp")
    planned = compaction.plan_containers(compaction.small_files(files), 5000)
    stored, manifest = compaction.store_small_files(files, lines, 5000)
    assert manifest.select("target").distinct().count() == manifest.select("container").distinct().count() == planned.select("container").distinct().count() > 3
    per = stored.groupBy("container").agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"))
    assert per.where("files > 1").count() == 0 and manifest.count() >= manifest.select("target").distinct().count()
    assert sorted(map(tuple, stored.select("container", "path").collect())) == sorted(map(tuple, planned.select("container", "path").collect()))


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert compaction.compact_parquet(spark, f"{tmp_path}/in", f"file://{tmp_path}/out").count() == 0


def listing(spark, rows):
    return spark.createDataFrame([(k, *r, "extra") for k, r in enumerate(rows)], "listing_id long, bucket string, path string, size long, dir boolean, listed_at timestamp, container string")


def test_small_files(spark):
    t = lambda h: T0 + timedelta(hours=h)
    rows = [
        ("b", "x//a.txt", 10, False, t(0)), ("b", "s3://b/x/./a.txt", 20, False, t(1)), ("b", "x/a.txt", None, False, t(2)),
        ("b", "big.txt", 10, False, t(0)), ("b", "./big.txt", 65_536, False, t(3)),
        ("c", "x/a.txt", 65_535, False, t(0)), ("b", "zero.md", 0, False, t(0)), ("b", "dir.txt", 5, True, t(0)), ("b", "n.parquet", 5, False, t(0)),
        ("b", None, 5, False, t(0)), (None, "n.jsonl", 5, False, t(0)), ("b", "late.md", 7, False, None), ("b", "x/a.txt", 10, False, t(0)),
    ]
    got = {(r.bucket, r.path): r.size for r in compaction.small_files(listing(spark, rows)).collect()}
    assert got == {("b", "x/a.txt"): 20, ("c", "x/a.txt"): 65_535, ("", "n.jsonl"): 5, ("b", "late.md"): 7}
    assert compaction.small_files(listing(spark, rows).where("false")).count() == 0


def test_plan_splits_hot_buckets(spark):
    files = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("bucket"), F.concat(F.lit("p"), "id").alias("path"), (F.col("id") % 1000 + 1).alias("size"))
    planned = compaction.plan_containers(files, target=20_000).cache()
    assert planned.count() == 5000
    per = planned.groupBy("bucket", "container").agg(F.sum("size").alias("bytes"))
    assert per.agg(F.max("bytes")).first()[0] < 21_000
    assert per.where("bucket = 'hot'").count() < 834_000 / 20_000 * 1.5


def test_store_keeps_every_line_once(spark):
    files = listing(spark, [("b", "x/a.jsonl", 10, False, T0), ("b", "x/b.txt", 10, False, T0), ("b", "big.jsonl", 1 << 20, False, T0)])
    lines = spark.createDataFrame(
        [(1, "b", "x/a.jsonl", 1, "one", None, T0), (1, "b", "x/a.jsonl", 1, "one", None, T0), (2, "b", "x/a.jsonl", 2, "old", None, T0), (2, "b", "x/a.jsonl", 2, "new", None, T0 + timedelta(1)), (3, "b", "big.jsonl", 1, "big", None, T0), (4, "b", "x/a.jsonl", 3, None, "ff", None), (None, "b", "x/a.jsonl", 4, "", None, T0)],
        "line_id long, bucket string, path string, line_no int, text string, hex string, read_at timestamp",
    )
    stored, _ = compaction.store_small_files(files, lines)
    assert {r.path for r in stored.collect()} == {"x/a.jsonl", "x/b.txt"}
    assert sorted((r.line_id, r.text, r.hex) for r in compaction.stored_lines(stored).collect()) == [(1, "one", None), (2, "new", None), (4, None, "ff")]
    hot = spark.range(150_000).selectExpr("id + 100 as line_id", "'b' as bucket", "'big.jsonl' as path", "int(id) as line_no", "'x' as text", "cast(null as string) as hex", "timestamp'2024-01-01' as read_at")
    again, _ = compaction.store_small_files(files, lines.unionByName(hot))
    assert compaction.stored_lines(again).count() == 3
    empty, _ = compaction.store_small_files(files.where("false"), lines.where("false"))
    assert empty.count() == 0
