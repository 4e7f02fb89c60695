"""Checks of inventories, sets and their definitions.  A check returns its
findings as rows; no rows means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_diff(recorded: DataFrame, found: DataFrame, key: str = "path", size: str = "bytes", digest: str | None = "sha256") -> DataFrame:
    """(key, problem): what a manifest and the files disagree on.  Of several
    problems the first of: not in the manifest, missing, size, hash."""
    cols = [size] + ([digest] if digest else [])
    r = recorded.select(key, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    f = found.select(key, F.lit(True).alias("_f"), *[F.col(c).alias(f"_f_{c}") for c in cols])
    differs = lambda c: ~F.col(f"_r_{c}").eqNullSafe(F.col(f"_f_{c}"))
    problem = F.when(F.col("_r").isNull(), "not in the manifest").when(F.col("_f").isNull(), "missing").when(differs(size), "size")
    if digest:
        problem = problem.when(differs(digest), "hash")
    return r.join(f, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def changed_keys(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two records, absent ones included."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = x.join(y, key, "full_outer")
    return j.where(F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def not_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks."""
    return part.select(key).distinct().join(whole.select(key), key, "left_anti")


def same_ids(sets: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(key, sets): ids that some sets have and others lack; no row means that
    all have the same ids."""
    long = [d.select(key, F.lit(name).alias("_s")) for name, d in sets.items()]
    n = reduce(DataFrame.unionAll, long).groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("sets"))
    return n.where(F.size("sets") < len(sets))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def cardinality_check(counts: DataFrame, expected: dict[str, int], name: str = "set", count: str = "rows") -> DataFrame:
    """(set, rows, expected) where a set's count isn't what is recorded."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return counts.select(name, count, want[F.col(name)].cast("long").alias("expected")).where(~F.col(count).eqNullSafe(F.col("expected")))


def same_but(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose rows differ in anything else than ``column``."""
    rest = [c for c in a.columns if c not in (key, column)]
    digest = lambda d, n: d.select(key, F.struct(*rest).alias(n))
    return digest(a, "_a").join(digest(b, "_b"), key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)
