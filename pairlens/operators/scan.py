"""Running sums and places in two levels, so that no task has a whole group.

Rows are put in order by ranges, each range is summed, and a table of one row
per group and range says what comes before.  A range then needs its own rows
alone, however large the group is.  The order is to be total: rows of equal
order are numbered as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialized, small

#: Rows of a range, about.
RANGE_ROWS = 500_000


def running_sum(df: DataFrame, value: Column, by: list[str], order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one
    in its group's order, 0 for the first; null values count as 0.

    Null groups are one group; an empty table gives an empty result.  ``order``
    sorts ascending, nulls first."""
    spark = df.sparkSession
    d = df.withColumn("_v", F.coalesce(value, F.lit(0)))
    rows = d.count()
    if rows <= range_rows:  # one range, so nothing stands before it
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn("_sum", F.coalesce(F.sum("_v").over(whole), F.lit(0))).select(*df.columns, F.col("_sum").alias(name))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // range_rows))
    keys = [*by, *order] or ["_v"]
    rows = materialized(d.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*by, "_part").agg(F.sum("_v").alias("_own"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = small(materialized(sums.select("*", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_base")).drop("_own"), "bases"))
    bases = bases.withColumnsRenamed({c: f"_b{k}" for k, c in enumerate([*by, "_part"])})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)], F.col("_part") == F.col(f"_b{len(by)}"))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_sum", F.coalesce(F.sum("_v").over(own), F.lit(0))).join(bases, same)
    return out.select(*df.columns, (F.col("_base") + F.col("_sum")).alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in its group's order."""
    return running_sum(df, F.lit(1).cast("long"), by, order, name, range_rows)
