"""Corpus rates and the summaries around them: ratios of sums, never means of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .quantiles import wide_quantiles


def rate(edits: str = "edits", length: str = "length") -> Column:
    """Sum of edits over sum of lengths; null if the latter is 0."""
    return F.try_divide(F.sum(edits), F.sum(length))


def error_rate(df: DataFrame, *by: str, edits: str = "edits", length: str = "length") -> DataFrame:
    """rows, edits, length and rate of each group of ``by``, or of all rows."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(edits).alias("edits"), F.sum(length).alias("length"), rate(edits, length).alias("rate"))


def relative(delta: Column, base: Column) -> Column:
    """A change as a share of its base; NaN where that is 0."""
    return F.when(base != 0, delta / base).otherwise(F.lit(float("nan")))


def decoding_counts(df: DataFrame, with_retries: bool = True) -> DataFrame:
    """Counts of re-decoded, exhausted, empty and looping rows; the first two
    are null where the run had no retries."""
    retry = lambda c: F.count_if(c) if with_retries else F.lit(None).cast("long")
    return df.agg(
        retry(F.col("temperature") > 0).alias("redecoded"), retry(F.col("fallback_exhausted")).alias("exhausted"),
        F.count_if(strip("hypothesis") == "").alias("empty"), F.count_if(F.col("edits") > F.col("length")).alias("loops"))


def latency_summary(df: DataFrame, value: str, *by: str, digits: int = 3) -> DataFrame:
    """Median and 90th percentile, exact and linear between neighbours, rounded
    half to even; of no rows at all one row of nulls without ``by``, else none.
    No task holds a group's values."""
    q = wide_quantiles(df, value, list(by), {"median": 0.5, "p90": 0.9})
    return q.select(*by, *[F.bround(c, digits).alias(c) for c in ("median", "p90")])


def hours(length: str = "length", rate_hz: int = 16_000) -> Column:
    """Hours of audio of a sum of samples, to two places, half to even."""
    return F.bround(F.sum(length) / rate_hz / 3600, 2)


def distinct_nonempty(column: str) -> Column:
    """Distinct values other than the empty string."""
    return F.count_distinct(F.when(F.col(column) != "", F.col(column)))


def two_rounds(df: DataFrame, value: str, *by: str, spread: float = 0.10) -> DataFrame:
    """Mean of repeated measurements, and whether they lie apart by more than
    ``spread`` of it (a mean of 0: no)."""
    mean = F.avg(value)
    apart = F.when(mean != 0, (F.max(value) - F.min(value)) / mean > spread).otherwise(F.lit(False))
    return df.groupBy(*by).agg(mean.alias("mean"), apart.alias("apart"))
