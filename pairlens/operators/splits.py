"""Deterministic splits: by hash order, by rank within a group, by length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered, running_sum
from .shared import materialized


def hash_pick(df: DataFrame, column: str, count: int) -> DataFrame:
    """The ``count`` distinct values that come first by SHA-256, then value."""
    return df.select(column).distinct().orderBy(F.sha2(F.col(column), 256), column).limit(count)


def hash_rank(df: DataFrame, digest: Column, then: str, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in the order of a hex
    digest, then of ``then``.  Counts per prefix of the digest give where each
    prefix begins, so ranking is done within one prefix: no task sorts all."""
    d = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 3))
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_p")  # 4096 rows at most
    bounds = sizes.select("_p", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", then)) - 1
    return d.join(F.broadcast(bounds), "_p").withColumn(name, place).drop("_h", "_p", "_before")


def _last_held(keys: DataFrame, percent: int) -> str:
    """The greatest digest among the first ``percent`` of distinct ones (``_h``);
    an empty string, before all, if that is none."""
    held = (keys.count() * percent + 50) // 100
    last = hash_rank(keys.withColumnRenamed("_h", "_k"), F.col("_k"), "_k", "_rank").where(F.col("_rank") == max(held, 1) - 1).first()
    return last["_k"] if held else ""


def hash_share_digests(df: DataFrame, key: str, percent: int = 15) -> DataFrame:
    """The SHA-256 of the keys of ``hash_share``, in a column of the key's name.
    Keys are read once, and no key goes further than its digest."""
    keys = materialized(df.select(F.sha2(F.col(key), 256).alias("_h")).where("_h is not null").distinct(), "digests")
    return keys.where(F.col("_h") <= _last_held(keys, percent)).withColumnRenamed("_h", key)


def hash_share(df: DataFrame, key: str, percent: int = 15) -> DataFrame:
    """The first ``percent`` of the distinct keys by hash, rounded half up."""
    keys = materialized(df.select(F.sha2(F.col(key), 256).alias("_h")).where("_h is not null").distinct(), "digests")
    return df.select(key).where(F.sha2(F.col(key), 256) <= _last_held(keys, percent)).distinct()


def route_share(df: DataFrame, key: str, percent: int, unseen: bool) -> DataFrame:
    """``df`` without its key: rows whose key is in ``hash_share`` (``unseen``),
    or is not.  Keys are read once, and their digests alone decide."""
    rows = materialized(df.select(*[c for c in df.columns if c != key], F.sha2(F.col(key), 256).alias("_h")), "digests")
    held = F.coalesce(F.col("_h") <= _last_held(rows.select("_h").where("_h is not null").distinct(), percent), F.lit(False))
    return rows.where(held if unseen else ~held).drop("_h")


def route(df: DataFrame, held: DataFrame, key: str, unseen: bool) -> DataFrame:
    """Rows whose key is held out (``unseen``), or is not."""
    return df.join(held.select(key).distinct(), key, "left_semi" if unseen else "left_anti")


def first_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def longest(df: DataFrame, length: str, text: str, position: str, n: int) -> DataFrame:
    """The ``n`` longest rows, by length, text length, then later position."""
    return df.orderBy(F.desc(length), F.desc(F.length(text)), F.desc(position)).limit(n)


def running_offset(df: DataFrame, length: str, group: str, order: str, name: str = "offset") -> DataFrame:
    """The sum of the lengths before each row in its group's order; in two
    levels, so a group that holds most rows is not one task's."""
    return running_sum(df, F.col(length), [group], [order], name)


def number_duplicates(df: DataFrame, column: str, order: str, name: str | None = None) -> DataFrame:
    """The n-th row of an id (n > 1) becomes ``id#n``; in two levels, too."""
    n, c = F.col("_place") + 1, F.col(column).cast("string")
    placed = numbered(df, [column], [order], "_place")
    return placed.withColumn(name or column, F.when(n > 1, F.concat(c, F.lit("#"), n.cast("string"))).otherwise(c)).drop("_place")


def best_of(df: DataFrame, value: str, position: str, label: str) -> DataFrame:
    """The label of least value; of equal ones the earliest."""
    return df.agg(F.min_by(label, F.struct(value, position)).alias(label))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """A hash permutation of an epoch in batches of equal size; the remainder goes."""
    digest = F.md5(F.concat_ws(":", F.lit(seed + epoch), F.col(key).cast("string")))
    d = hash_rank(df, digest, key, "position").withColumn("batch", F.floor(F.col("position") / batch))
    n = df.agg(F.count("*").alias("_n"))
    return d.join(F.broadcast(n)).where(F.col("batch") < F.floor(F.col("_n") / batch)).drop("_n")


def step_batch(step: Column, accumulate: int, per_epoch: int, override: tuple[int, int] | None = None) -> Column:
    """The micro-batches of a training step, counted from 0 over all epochs, as
    an array of (epoch, batch): ``accumulate`` in a row from (step - 1) *
    accumulate.  ``override``: a step, and the batch that it takes instead."""
    first = (step - 1) * accumulate
    usual = F.transform(F.sequence(first, first + accumulate - 1), lambda m: F.struct(
        F.floor(m / per_epoch).alias("epoch"), (m % per_epoch).cast("long").alias("batch")))
    if override is None:
        return usual
    other = F.array_repeat(F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(override[1]).cast("long").alias("batch")), accumulate)
    return F.when(step == override[0], other).otherwise(usual)


def last_complete(df: DataFrame, step: str, path: str, complete: str) -> DataFrame:
    """The path of the last checkpoint that is complete; null if none is."""
    return df.agg(F.max_by(F.when(F.col(complete), F.col(path)), F.when(F.col(complete), F.col(step))).alias(path))


def head(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first ``n`` rows in the set's order."""
    return df.orderBy(position).limit(n)


def all_keys(sets: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of all sets."""
    return reduce(DataFrame.unionAll, [s.select(key) for s in sets]).distinct()


def route_by_original(rewritten: DataFrame, original: DataFrame, held: DataFrame, id_col: str, key: Column, unseen: bool) -> DataFrame:
    """Rows of a rewritten set by the key of their original's text: those whose
    key is held out, or is not.  ``key`` is over ``original``; its name in
    ``held`` is ``key``."""
    keyed = original.select(id_col, key.alias("key"))
    return route(rewritten.join(keyed, id_col), held, "key", unseen).drop("key")
