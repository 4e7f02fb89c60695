"""Writers: never over what exists, never a NaN.  Spark's committer publishes
a job's files all at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bad(c: Column, kind: T.DataType) -> Column | None:
    """Whether a value, or any within it, is a NaN or an infinity; None if its
    type can't hold one."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields if (x := _bad(c[f.name], f.dataType)) is not None]
        return reduce(Column.__or__, parts) if parts else None
    if isinstance(kind, T.ArrayType) and _bad(F.lit(None), kind.elementType) is not None:
        return F.coalesce(F.exists(c, lambda x: _bad(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType) and _bad(F.lit(None), kind.valueType) is not None:
        return F.coalesce(F.exists(F.map_values(c), lambda x: _bad(x, kind.valueType)), F.lit(False))
    return None


def finite(df: DataFrame) -> DataFrame:
    """``df``; a NaN or an infinity in a column, at any depth, is an error."""
    def checked(f: T.StructField) -> Column:
        c, bad = F.col(f"`{f.name}`"), _bad(F.col(f"`{f.name}`"), f.dataType)
        if bad is None:
            return c
        return F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(c).alias(f.name)

    return df.select(*map(checked, df.schema.fields))


def write_new(df: DataFrame, path: str, kind: str = "json", *by: str) -> None:
    """Writes where nothing is yet."""
    w = finite(df).write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def rewrite_texts(df: DataFrame, column: str, rewrite) -> DataFrame:
    """``df`` with the texts rewritten and whether each changed."""
    d = df.withColumn("_new", rewrite(F.col(column)))
    return d.withColumn("changed", ~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def rewrite_set(spark: SparkSession, path: str, to: str, rewrite) -> DataFrame:
    """Writes a set file with its texts rewritten, and says (rows, changed)."""
    from .readers import read_set

    d = rewrite_texts(read_set(spark, path).drop("seconds"), "text", rewrite)
    u = F.struct("id", "speaker", "text", "store", "offset", "length")
    one = d.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("pos", u.alias("u")))).alias("rows"))  # a set is one file, hence one row
    write_new(one.select("language", F.col("rows.u").alias("utterances")).coalesce(1), to)
    return d.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))
