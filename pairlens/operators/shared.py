"""Tables between the jobs of one operator, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may take, by the sizes of its rows.
BROADCAST_BYTES = 32 << 20


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="pairlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and the
    master is local, as in tests; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return "file://" + _local_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage is cut, and what
    later jobs read doesn't change if a task runs twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are proven to take at most about
    ``max_bytes``, else as it is."""
    def width(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(F.size(f.name), F.lit(0)) * 16 + 24
        return F.lit(8)

    size = df.agg(F.sum(sum(map(width, df.schema.fields), F.lit(16)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df
