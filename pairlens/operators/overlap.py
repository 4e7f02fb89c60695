"""Overlap of sentences and groups between data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rates import distinct_nonempty


def read_counts(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """``rows`` with how often each key stands in ``train`` (0 if never)."""
    counts = train.groupBy(key).agg(F.count("*").alias("train_reads"))
    return rows.join(counts, key, "left").fillna(0, ["train_reads"])


def in_train(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return rows.join(train.select(key).distinct(), key, "left_semi")


def not_in_train(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return rows.join(train.select(key).distinct(), key, "left_anti")


def within(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys, keys met more than once, the rows of those, most reads."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return n.agg(
        F.count("*").alias("sentences"), F.count_if(more).alias("repeated_sentences"),
        F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).alias("repeated_rows"), F.max("n").alias("most_reads"))


def group_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Groups of both; the empty name is none."""
    some = lambda d: d.select(column).where(F.col(column) != "")
    return some(a).intersect(some(b))


def overlap_summary(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys in train, and the reads of those."""
    r = read_counts(rows, train, key)
    seen = F.col("train_reads") > 0
    return r.agg(
        F.count("*").alias("rows"), F.count_if(seen).alias("rows_in_train"),
        F.count_distinct(F.when(seen, F.col(key))).alias("keys_in_train"), F.max("train_reads").alias("most_reads"))


def leakage_gate(train: DataFrame, held: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per key the held rows that train has, and the shared groups: all must be 0."""
    parts = [in_train(held, train, k).agg(F.lit(k).alias("gate"), F.count("*").alias("n")) for k in keys]
    parts.append(group_overlap(train, held, group).agg(F.lit(group).alias("gate"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def set_summary(df: DataFrame, set_column: str, group: str, length: str) -> DataFrame:
    """Rows, groups and hours of each set."""
    from .rates import hours

    return df.groupBy(set_column).agg(F.count("*").alias("rows"), distinct_nonempty(group).alias("groups"), hours(length).alias("hours"))
