"""Tables written in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
back: lost executors then lose nothing, the plan that follows knows the table's real size
(so the planner broadcasts it only when it is below the session's threshold), and both
sides of a following join are plain exchanges, which adaptive execution can split.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` without columns that begin with two underscores: these names are the operators' own."""
    return docs.drop(*[c for c in docs.columns if c.startswith("__")])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a new temporary one only where all runs in one local process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/radiolake/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def stage_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. ``codec``: the session's unless given."""
    folder = new_dir(df.sparkSession, name)
    df.write.parquet(f"{folder}/table", compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    out.staged_in = folder
    return out


def staged_bytes(table: DataFrame) -> int:
    """Bytes of a staged table's files."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_in)
    return path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def broadcast_if_small(table: DataFrame, most: int = 4 << 20) -> DataFrame:
    """A staged table marked for broadcast if its files have at most ``most`` bytes; else the planner's choice."""
    return F.broadcast(table) if staged_bytes(table) <= most else table


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_in)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go when its write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of no bytes for null."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def text_hash(text: Column) -> Column:
    """64-bit hash of a text that tells null from empty."""
    return F.xxhash64(F.lit(7), text, text.isNull())
