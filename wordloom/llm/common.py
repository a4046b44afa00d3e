"""Shared plumbing: table access, sizing from the data, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows, so that many long documents do not meet in one batch.

    Plans read these settings of the session when they run, so they stay; smaller ones of the caller are left alone.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 * MB)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster without one is an error, since its
    executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back; later steps depend on the files alone.

    ``group_bytes`` is the size of Parquet's row groups: a task that writes or reads wide rows holds a whole one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later step, nor any result, reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._table)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(bytes of text, rows): one narrow aggregate that sets how many chunks and buckets there are."""
    row = docs.agg(F.sum(F.octet_length(column)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"] or 0), int(row["n"] or 0)


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable: it is evaluated once however often (or deep) body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(column: str, m: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def array_words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", -1), lambda w: w != F.lit(""))
