"""Bootstrap intervals of ratios of sums.

Draws come from hashes (``md5(seed:rep:slot)``): rep and slot alone decide them,
so any engine and any partitioning gets the same.  ``parity`` draws instead from
numpy's generator in one stream, for results that must equal recorded ones; that
is one sequential task by nature and is for small inputs.

Rows are summed to units first, so a unit is a row, or a block where rows of a
block are drawn together.  The draws are units x samples numbers; they are made
by ranges, go two bytes each to the part of the units that they fall into, and
are summed there, so no task, broadcast or group grows with the units.  With
``poisson`` each row weighs itself per sample by a generator that counts on from
its unit, and a task adds up one vector as long as the samples, so rows are read
once and nothing but those vectors is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialized
from .splits import hash_rank

SAMPLES, SEED = 1000, 0
#: Fixed values of a published 32-bit mix (shifts and factors), and what a sample and a seed step by.
MIX_SHIFTS, MIX_FACTORS = (16, 15, 16), (0x7FEB352D, 0x846CA68B)
REP_STEP, SEED_STEP = 0x9E3779B9, 0x85EBCA6B
#: Weights that a task makes at once.
DRAWN = 1 << 21
#: Units of a part, which two bytes tell apart, samples of a share, draws of a task and those it deals at once.
PART_UNITS, SHARE_SAMPLES, TASK_DRAWS, DEALT = 1 << 14, 1 << 10, 1 << 23, 1 << 20


def _draw(seed: int, rep: Column, slot: Column) -> Column:
    """60 bits, so that the rest by any number of units is as good as even."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), rep, slot)), 1, 15), 16, 10).cast("long")


def poisson_bounds(most: int = 12) -> list[int]:
    """The least 32-bit draw of each weight from 1 on, of a Poisson of 1."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.ceil(total * (1 << 32)))
    return [x for x in out if x < 1 << 32]


def mix32(x: np.ndarray) -> np.ndarray:
    """A mix of 32-bit values, in place."""
    for k, shift in enumerate(MIX_SHIFTS):
        x ^= x >> np.uint32(shift)
        if k < len(MIX_FACTORS):
            x *= np.uint32(MIX_FACTORS[k])
    return x


def poisson_weights(low: np.ndarray, high: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Units x samples weights.  A unit is two 32-bit values; equal units weigh
    the same wherever they lie, so rows of a block are drawn together."""
    with np.errstate(over="ignore"):
        step = np.arange(samples, dtype=np.uint32) * np.uint32(REP_STEP) + np.uint32(seed * SEED_STEP & 0xFFFFFFFF)
        x = mix32(low.astype(np.uint32)[:, None] + step[None, :])
        x = mix32(x ^ high.astype(np.uint32)[:, None])
    return np.searchsorted(np.array(poisson_bounds(), np.uint32), x.ravel(), "right").reshape(x.shape)


def _poisson_sums(df: DataFrame, values: list[str], unit: str, samples: int, seed: int) -> DataFrame:
    digest = F.md5(F.col(unit).cast("string"))
    part = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("long")
    d = df.select(part(1).alias("low"), part(9).alias("high"), *values).where("low is not null")
    kinds = ["double" if d.schema[v].dataType.simpleString() in ("float", "double") else "long" for v in values]

    def run(batches):
        total = [np.zeros(samples, float if k == "double" else np.int64) for k in kinds]
        for b in batches:
            low, high, *own = (b.column(k).to_numpy(zero_copy_only=False) for k in range(len(values) + 2))
            own = [np.nan_to_num(x.astype(float)) for x in own]
            step = max(1, DRAWN // samples)
            for i in range(0, len(low), step):
                w = poisson_weights(low[i : i + step], high[i : i + step], samples, seed).astype(float)
                for k, x in enumerate(own):
                    part_sum = x[i : i + step] @ w
                    total[k] += part_sum if kinds[k] == "double" else np.rint(part_sum).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), *map(pa.array, total)], names=["rep", *values])

    made = d.mapInArrow(run, ", ".join(["rep long", *[f"{v} {k}" for v, k in zip(values, kinds, strict=True)]]))
    return made.groupBy("rep").agg(*[F.sum(v).alias(v) for v in values])


def _deal(batches, parts: int):
    """Draws (rep, pos) as rows of a sample and a part: the places within the
    part, two bytes each, as often as they are drawn."""
    def rows(held):
        rep, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        key = (rep - rep.min()) * parts + pos // PART_UNITS
        order = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        first, ends = order[starts], np.append(starts, len(order)).astype(np.int32) * 2
        data = pa.py_buffer((pos[order] % PART_UNITS).astype("<u2"))
        places = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), data])
        part, share = pos[first] // PART_UNITS, rep[first] // SHARE_SAMPLES
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(share), pa.array(rep[first]), places], names=["part", "share", "rep", "places"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append([b.column(k).to_numpy() for k in range(2)])
            size += b.num_rows
        if size >= DEALT:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def _add(units: pa.Table, picks: pa.Table, values: list[str], kinds: list[str]) -> pa.Table:
    """What the draws of a part add to their samples; nulls count as in sums."""
    at = units["pos"].to_numpy() % PART_UNITS
    places = [np.frombuffer(x.as_py(), "<u2") for x in picks["places"]]
    made = [picks["rep"].combine_chunks()]
    for v, kind in zip(values, kinds, strict=True):
        there = np.zeros(PART_UNITS, bool)
        there[at] = units[v].is_valid().to_numpy()
        own = np.zeros(PART_UNITS, np.int64 if kind == "long" else float)
        own[at] = units[v].fill_null(0).to_numpy()
        none = None if not units[v].null_count else np.array([not there[x].any() for x in places], bool)
        made.append(pa.array(np.array([own[x].sum() for x in places], own.dtype), mask=none))
    return pa.Table.from_arrays(made, names=["rep", *values])


def _hash_sums(df: DataFrame, values: list[str], unit: str, samples: int, seed: int) -> DataFrame:
    """Each unit's place is that in the order of the units' MD5."""
    spark = df.sparkSession
    sums = df.groupBy(F.col(unit).cast("string").alias("unit")).agg(*[F.sum(v).alias(v) for v in values])
    kinds = ["long" if sums.schema[v].dataType.simpleString() == "bigint" else "double" for v in values]
    sums = materialized(sums.select("unit", *[F.col(v).cast(k).alias(v) for v, k in zip(values, kinds, strict=True)]), "units")
    n = sums.count()
    if not n:
        return sums.select(F.lit(0).cast("long").alias("rep"), *values)
    parts, shares = -(-n // PART_UNITS), -(-samples // SHARE_SAMPLES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * samples // TASK_DRAWS))
    draws = spark.range(0, n * samples, 1, tasks).select(F.expr(f"id div {n}L").alias("rep"), F.expr(f"id % {n}L").alias("slot"))
    draws = draws.select("rep", (_draw(seed, F.col("rep"), F.col("slot")) % n).alias("pos"))
    picks = draws.mapInArrow(lambda batches: _deal(batches, parts), "part long, share long, rep long, places binary")
    units = hash_rank(sums, F.md5("unit"), "unit", "pos").select(
        F.expr(f"pos div {PART_UNITS}L").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.col("pos").cast("long").alias("pos"), *values)
    schema = ", ".join(["rep long", *[f"{v} {k}" for v, k in zip(values, kinds, strict=True)]])
    made = units.groupBy("part", "share").cogroup(picks.groupBy("part", "share")).applyInArrow(lambda u, p: _add(u, p, values, kinds), schema)
    return made.groupBy("rep").agg(*[F.sum(v).alias(v) for v in values])


def resampled_sums(df: DataFrame, values: list[str], unit: str, samples: int = SAMPLES, seed: int = SEED, mode: str = "hash") -> DataFrame:
    """(rep, each value's sum over a draw of as many units as there are)."""
    if samples < 1:
        raise ValueError(f"at least one sample is needed, not {samples}")
    if mode == "poisson":
        return _poisson_sums(df, values, unit, samples, seed)
    if mode == "parity":
        return _parity([df], values, unit, samples, seed)
    return _hash_sums(df, values, unit, samples, seed)


def _parity(sets: list[DataFrame], values: list[str], unit: str, samples: int, seed: int) -> DataFrame:
    """The sums of numpy's draws; of several sets, each one's draws follow the
    other's from one generator, and a value of set k is named ``value_k``."""
    import pandas as pd

    count = len(sets)  # the function below must not carry the sets along
    names = [f"{v}_{k}" if count > 1 else v for k in range(count) for v in values]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Code points' order, which UTF-8 keeps.
        pdf = pdf.sort_values(["_set", "unit"])
        generator, made = np.random.default_rng(seed), []
        for k in range(count):
            own = [pdf.loc[pdf["_set"] == k, v].to_numpy() for v in values]
            n = len(own[0])
            most, parts = max(1, (1 << 22) // max(n, 1)), []
            for start in range(0, samples, most):
                picks = generator.integers(0, n, size=(min(most, samples - start), n))
                parts.append(np.stack([v[picks].sum(axis=1) for v in own], 1))
            made.append(np.concatenate(parts))
        out = pd.DataFrame(np.concatenate(made, axis=1), columns=names)
        out.insert(0, "rep", range(samples))
        return out

    units = reduce(DataFrame.unionAll, [
        d.groupBy(F.col(unit).cast("string").alias("unit")).agg(*[F.sum(v).alias(v) for v in values]).withColumn("_set", F.lit(k)) for k, d in enumerate(sets)])
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = ", ".join(["rep long", *[f"{n} {kinds[v]}" for n, v in zip(names, values * count, strict=True)]])
    return units.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(run, schema)


def _ends(df: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return df.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def interval(df: DataFrame, unit: str, edits: str = "edits", length: str = "length", **how) -> DataFrame:
    """(low, high): the 95 % interval of the corpus rate."""
    return _ends(resampled_sums(df, [edits, length], unit, **how), F.col(edits) / F.col(length))


def difference_interval(df: DataFrame, unit: str, a: str = "edits_a", b: str = "edits_b", length: str = "length", **how) -> DataFrame:
    """(low, high) of rate(a) - rate(b) over the same draws.  With a block as
    ``unit``, blocks are drawn whole."""
    return _ends(resampled_sums(df, [a, b, length], unit, **how), F.col(a) / F.col(length) - F.col(b) / F.col(length))


def leave_one_out(df: DataFrame, block: str, a: str = "edits_a", b: str = "edits_b", length: str = "length") -> DataFrame:
    """(block, delta): rate(a) - rate(b) of all other blocks.  The totals come
    from the blocks' own sums, one narrow row each, so rows are read once."""
    sums = materialized(df.groupBy(block).agg(*[F.sum(v).alias(v) for v in (a, b, length)]), "blocks")
    total = sums.agg(*[F.sum(v).alias(f"_all_{v}") for v in (a, b, length)])
    rest = lambda v: F.col(f"_all_{v}") - F.col(v)
    return sums.join(F.broadcast(total)).select(block, F.try_divide(rest(a) - rest(b), rest(length)).alias("delta"))


def share_interval(
    first: DataFrame, second: DataFrame, unit: str, a: str = "edits_a", b: str = "edits_b", length: str = "length", samples: int = SAMPLES,
    seed: int = SEED, mode: str = "hash",
) -> DataFrame:
    """(low, high) of the difference of two sets' paired differences, the b-th
    draw of one with the b-th of the other.  In ``parity`` both sets' draws come
    from one generator, the first's before the second's."""
    if samples < 1:
        raise ValueError(f"at least one sample is needed, not {samples}")
    values = [a, b, length]
    if mode == "parity":
        d = _parity([first, second], values, unit, samples, seed)
    else:
        sides = [resampled_sums(x, values, unit, samples, seed + k, mode) for k, x in enumerate((first, second))]
        d = reduce(lambda x, y: x.join(y, "rep"), [x.withColumnsRenamed({v: f"{v}_{k}" for v in values}) for k, x in enumerate(sides)])
    delta = lambda k: F.col(f"{a}_{k}") / F.col(f"{length}_{k}") - F.col(f"{b}_{k}") / F.col(f"{length}_{k}")
    return _ends(d, delta(0) - delta(1))
