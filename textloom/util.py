"""Helpers shared by the operators: reading tables, shared storage, bounded broadcasts."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []

#: Rows up to which a side of known small width may be broadcast.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where the session names none and all of it runs in this process (tests, a single machine) is one
    made, and then it is also set as the checkpoint folder of the context; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        # With its scheme, so that workers reach the same file system as Spark does.
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    kept = getattr(spark.sparkContext, "_textloom_shared", None)
    if kept is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        kept = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.sparkContext.setCheckpointDir(kept)
        spark.sparkContext._textloom_shared = kept
    return kept


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. What is written there stays until drop_scratch, as results read it lazily."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage with files all executors share, so a lost executor costs no recomputation
    of what lies before, and Python stages that feed several consumers run once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it proves to hold at most ``max_rows`` rows; else leaves it to a shuffled join.

    The rows that prove it are kept, so that ``df`` is not computed again.
    """
    held = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)) if held.num_rows <= max_rows else df


def clashless(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keeps exactly ``columns``, so further columns of a caller's table can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan to all cores if it has fewer partitions than half of them.

    Python stages are bound by the CPU, and a small compressed file is one partition. A large input has
    many splits and is left alone, so this shuffle never grows with the data. Meant for scans with
    filters and projections, whose number of partitions is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the operators of this session wrote to the shared folder; results not yet consumed can't be read afterwards."""
    for path in _WRITTEN:
        drop_path(spark, path)
    _WRITTEN.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once; needed where it is not installed on them.

    The archive is written to the shared folder and distributed by Spark.
    """
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    from pyarrow import fs

    path = scratch_path(spark, "package") + ".zip"
    _WRITTEN.append(path)
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    system.create_dir(inside.rpartition("/")[0])
    with system.open_output_stream(inside) as f:
        f.write(packed.getvalue())
    context.addPyFile(path)
    context._textloom_shipped = True
