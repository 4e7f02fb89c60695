"""Shared helpers: reading tables, the shared folder, written tables."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may take, by the sizes of its rows.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of whole texts.  Spark's 10,000 are a whole task's texts,
#: held by the JVM, by Arrow and by Python at a time.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is ``spark.checkpoint.dir``.  Only where that is unset and the master is
    local, as in tests, a temporary folder of this process takes its place; on a
    cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + _local_dir()
    return found.rstrip("/")


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="pairlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage is cut
    and a lost executor costs no more than the read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairlens_path = path
    return out


def in_parts(df: DataFrame, rows: int, per_part: int) -> DataFrame:
    """``df``, of which some ``rows`` rows are to be expected, in no more parts
    than ``per_part`` rows each make: a small table that a shuffle left in very
    many parts costs mostly the opening of files.  Nothing is shuffled."""
    return df.coalesce(max(1, -(-rows // per_part)))


def discard(spark: SparkSession, df_or_path) -> None:
    """Deletes a written table that no later plan reads, and has Spark drop the
    shuffle files of finished plans: a table's own are of about its size."""
    path = getattr(df_or_path, "_pairlens_path", df_or_path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle
    files of finished plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _row_bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes ``c`` takes in a row."""
    if isinstance(kind, T.StructType):
        return sum((_row_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        one = 8 if not isinstance(kind.elementType, T.StructType) else 8 * (1 + len(kind.elementType.fields))
        if isinstance(kind.elementType, T.StringType):
            return F.lit(24) + F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        return F.lit(24) + F.coalesce(F.size(c), F.lit(0)) * one
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a sum over its rows proves that they take
    at most about ``max_bytes``, else as it is, for a shuffled join."""
    size = sum((_row_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= max_bytes else df


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows, for actions on wide rows within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held(c: Column) -> Column:
    """``c``, not to be inlined into what stands above: the optimizer moves
    predicates below deterministic projections by copying their expressions,
    which here would double them at every level."""
    return F.when(F.spark_partition_id() >= 0, c)


def row_key(id_col: str, text_col: str):
    """A key of a row by its id and text, so that rows that repeat an id with
    another text stay apart.  Exact repeats of a row share it and its result."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col)))
