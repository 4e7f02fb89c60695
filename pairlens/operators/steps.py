"""Step logs and memory samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with a key the one that was written last.  A maximum per key,
    combined before the shuffle, rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return top.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def not_finite(column: str):
    c = F.col(column).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def step_summary(steps: DataFrame, grace: int = 0) -> DataFrame:
    """steps, skipped and non-finite steps in order, the median seconds of
    steps after ``grace`` that aren't the longest, the peak memory."""
    timed = (F.col("step") > grace) & ~F.col("longest")
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("step"))))
    return steps.agg(
        F.count("*").alias("steps"), listed(F.col("skipped") & (F.col("step") > grace)).alias("skipped"), listed(not_finite("loss")).alias("nonfinite"),
        F.percentile(F.when(timed, F.col("seconds")), F.lit(0.5)).alias("median_seconds"),
        F.max(F.coalesce("peak_allocated_mb", F.lit(0))).alias("peak_allocated_mb"))


def smoke_checks(steps: DataFrame, memory: DataFrame, expected: int = 50, grace: int = 20, max_skips: int = 5, shared_mb: float = 512,
                 gpu_mb: float = 10_752, allocated_mb: float = 7_168, hours: float = 8.0, full: int = 1500, fewer: int = 1000) -> DataFrame:
    """One row: each check, whether all passed, and the steps that fit ``hours``."""
    s = step_summary(steps, grace)
    m = memory.agg(F.max("shared_mb").alias("shared"), F.max("smi_used_mb").alias("used"))
    n = steps.agg(F.count_if(F.col("longest")).alias("_longest"))
    j = s.join(F.broadcast(m)).join(F.broadcast(n))
    checks = {
        "all_steps": F.col("steps") == expected, "few_skips": F.size("skipped") <= max_skips, "finite": F.size("nonfinite") == 0,
        "longest_seen": F.col("_longest") > 0, "shared_ok": F.col("shared") <= shared_mb, "gpu_ok": F.col("used") < gpu_mb,
        "allocated_ok": F.col("peak_allocated_mb") <= allocated_mb,
    }
    d = j.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    projected = F.col("median_seconds") * full / 3600
    return d.select(*checks, passed.alias("passed"), projected.alias("hours"), F.when(projected <= hours, full).otherwise(fewer).alias("max_steps"))


def monitor(df: DataFrame, value: str, before: float | None = None) -> DataFrame:
    """Highest value, its rise over ``before``, mean to one place; null for no rows."""
    rise = F.max(value) - before if before is not None else F.lit(None).cast("double")
    return df.agg(F.max(value).alias("highest"), rise.alias("rise"), F.bround(F.avg(value), 1).alias("mean"))
