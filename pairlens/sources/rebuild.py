"""A derived table with a partition per source file, of which only those are
made again whose files have changed.

A table beside it records what each source file was: its size, and on demand
its content's SHA-256.  The record is written after the partitions, so a run
that breaks off is done again by the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialized

SOURCES = "path string, bytes long, sha256 string"


class Stale(Exception):
    """The derived table was made from other files than there are now."""


def source_files(spark: SparkSession, path: str, pattern: str = "*.parquet", hashes: bool = False) -> DataFrame:
    """(path, bytes, sha256) of the source files; contents are read for hashes only."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.col("length").alias("bytes"), (F.sha2("content", 256) if hashes else F.lit(None).cast("string")).alias("sha256"))


def part_name(path) -> F.Column:
    """The partition of a source file: its path, as a name that a folder can have."""
    return F.sha2(path, 256)


def differences(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): ``new``, ``gone`` or ``changed`` files, by size, and by
    hash where both sides have one."""
    r, c = (d.select("path", F.col("bytes").alias(f"{n}_bytes"), F.col("sha256").alias(f"{n}_sha256")) for d, n in ((recorded, "r"), (current, "c")))
    other = ~F.col("r_bytes").eqNullSafe(F.col("c_bytes")) | F.coalesce(F.col("r_sha256") != F.col("c_sha256"), F.lit(False))
    change = F.when(F.col("r_bytes").isNull(), "new").when(F.col("c_bytes").isNull(), "gone").when(other, "changed")
    return r.join(c, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def rebuild(
    spark: SparkSession, sources: str, target: str, make: Callable[[DataFrame], DataFrame], mode: str = "changed", forced: Iterable[str] = (),
    adopt: Callable[[DataFrame], bool] | None = None, pattern: str = "*.parquet", hashes: bool = False,
) -> DataFrame:
    """Brings the table at ``target/data`` in line with the files under
    ``sources`` and gives (path, change) of what it did.

    ``make`` turns rows of source files into rows of the table; it gets the
    column ``_source`` and keeps it.  ``mode``: ``changed`` makes the partitions
    of new and changed files again and drops those of files that are gone;
    ``check`` refuses where anything differs; ``all`` makes every partition.
    ``forced`` paths are made again in any case.  A table without a record is
    ``adopted``, unchanged, if ``adopt`` says of the table that it is the one
    these files give, and refused else.  No source file at all is an error."""
    current = materialized(source_files(spark, sources, pattern, hashes), "sources")
    if not current.limit(1).count():
        raise FileNotFoundError(f"no source files in {sources}")
    data, record = f"{target}/data", f"{target}/sources"
    known, made = _exists(spark, record), _exists(spark, data)
    if made and not known and mode != "all":
        if adopt is None or not adopt(spark.read.parquet(data)):
            raise Stale(f"{target} has no record of its sources, so nothing says which files it was made from")
        _publish(spark, current, record)
        return current.select("path", F.lit("adopted").alias("change"))
    recorded = spark.read.schema(SOURCES).parquet(_latest(spark, record)) if known and mode != "all" else spark.createDataFrame([], SOURCES)
    change = differences(recorded, current)
    again = [p for p in forced]
    if again:
        wanted = spark.createDataFrame([(p,) for p in again], "path string")
        change = change.union(current.join(wanted, "path", "left_semi").join(change, "path", "left_anti").select("path", F.lit("forced").alias("change")))
    change = materialized(change, "changes")
    if mode == "check":
        some = [f"{r.path} is {r.change}" for r in change.orderBy("path").limit(10).collect()]
        if some:
            raise Stale(f"{target} was made from other files: {'; '.join(some)}")
        return change
    # Spark lists source files on the driver anyway; of these, those that changed.
    paths = [r.path for r in change.where("change <> 'gone'").select("path").collect()]
    if paths:
        rows = spark.read.parquet(*paths).withColumn("_source", F.col("_metadata.file_path"))
        out = make(rows).withColumn("part", part_name(F.col("_source"))).drop("_source")
        if mode == "all" and made:
            _filesystem(spark, data)[0].delete(_filesystem(spark, data)[1], True)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(data)
    # A file without rows, now or any more, leaves no partition; dynamic overwrite doesn't see it.
    empty = change.where("change <> 'new'").select("path", part_name(F.col("path")).alias("part"))
    if paths and _exists(spark, data):
        filled = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path")).distinct()
        empty = empty.join(filled, "path", "left_anti")
    for r in empty.select("part").collect():
        fs, p = _filesystem(spark, f"{data}/part={r.part}")
        fs.delete(p, True)
    _publish(spark, current, record)
    return change


def _latest(spark: SparkSession, record: str) -> str:
    fs, p = _filesystem(spark, record)
    return max((s.getPath().toString() for s in fs.listStatus(p)), key=lambda x: int(x.rsplit("=", 1)[1]))


def _publish(spark: SparkSession, current: DataFrame, record: str) -> None:
    """Writes the next version of the record, then drops the others; a version
    counts only once its writer is done."""
    fs, p = _filesystem(spark, record)
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    number = max((int(x.toString().rsplit("=", 1)[1]) for x in found), default=0) + 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    current.coalesce(1).write.mode("overwrite").parquet(f"{record}-new")
    fs.mkdirs(p)
    if not fs.rename(path(f"{record}-new"), path(f"{record}/v={number}")):
        raise OSError(f"{record}/v={number} can't be published")
    for x in found:
        fs.delete(x, True)
