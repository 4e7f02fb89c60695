"""Exact quantiles of groups of any size.

A quantile's value is that of one rank, or of two.  A sketch of bounded size
gives a range of values that surely holds them; what lies below and within is
counted.  Ranges are narrowed until few rows lie within, and only those are
sorted, so no task holds a group's values, however many of them are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialized, small

#: Rows within a range that are sorted in one task, at most: narrow ones, that spill.
MOST_ROWS = 500_000
#: A sketch gives the values at so many equal shares, each off by less than half a share.
SHARES, ACCURACY = 200, 2_000


def quantiles(df: DataFrame, value: str, by: list[str], at: list[float], most_rows: int = MOST_ROWS) -> DataFrame:
    """(by, quantile, result): each group's quantiles at the shares ``at``, exact
    and linear between neighbours.

    Nulls and NaN don't count, and a group without any value has no row; a null
    group is a group; equal values, however many, narrow a range to themselves.
    An empty table gives no rows."""
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError(f"shares of 0 to 1, not {at}")
    keys = [f"_g{k}" for k in range(len(by))]
    d = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")

    def matched(rows: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
        """Rows with the ranges of their group, and of their quantile where ``own`` has it."""
        r = small(ranges.withColumnsRenamed({c: f"{c}_r" for c in own}))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in own], F.lit(True))
        return rows.join(r, same).drop(*[f"{c}_r" for c in own])

    one = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0")
    place = (F.col("n") - 1) * F.col("q")
    state = materialized(one.select("*", F.explode(F.array(*map(F.lit, map(float, at)))).alias("q")).select(
        *keys, "q", F.floor(place).cast("long").alias("rank"), (place - F.floor(place)).alias("part"),
        F.least(F.floor(place) + 1, F.col("n") - 1).cast("long").alias("next"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("within")), "ranges")
    rows, own, closed = d, keys, []
    tag = [*keys, "q"]
    while True:
        wide = (F.col("within") > most_rows) & (F.col("lo") < F.col("hi"))
        closed.append((rows, own, state.where(~wide)))
        left = state.where(wide)
        if not left.limit(1).count():
            break
        inside = matched(rows, left, own).where("_v between lo and hi")
        points = inside.groupBy(*tag, "rank", "part", "next", "lo", "hi", "below", "within").agg(
            F.percentile_approx("_v", [k / SHARES for k in range(SHARES + 1)], ACCURACY).alias("points"))
        share = lambda rank: (F.col(rank) - F.col("below")) / F.col("within") * SHARES
        low, high = F.floor(share("rank")).cast("int") - 1, F.ceil(share("next")).cast("int") + 2
        cuts = materialized(points.select(
            *tag, "rank", "part", "next", "below", F.when(low < 0, F.col("lo")).otherwise(F.get("points", low)).alias("lo"),
            F.when(high > SHARES, F.col("hi")).otherwise(F.get("points", high)).alias("hi"), F.col("lo").alias("_lo")), "cuts")
        before = matched(rows, cuts, own).where("_v between _lo and hi")
        counts = before.groupBy(*tag).agg(F.count_if(F.col("_v") < F.col("lo")).alias("_b"), F.count_if(F.col("_v") >= F.col("lo")).alias("within"))
        state = materialized(matched(cuts, counts, tag).select(*tag, "rank", "part", "next", "lo", "hi", (F.col("below") + F.col("_b")).alias("below"), "within"), "ranges")
        rows, own = materialized(before.where("_v >= lo").select(*tag, "_v"), "within"), tag
    out = []
    for source, by_own, ranges in closed:
        same = ranges.where("lo = hi").select(*tag, F.col("lo").alias("result"))
        some = matched(source, ranges.where("lo < hi"), by_own).where("_v between lo and hi")
        ranked = some.withColumn("_r", F.col("below") + F.row_number().over(Window.partitionBy(*tag).orderBy("_v")) - 1)
        pick = lambda c: F.max(F.when(F.col("_r") == F.col(c), F.col("_v")))
        out += [same, ranked.groupBy(*tag).agg((pick("rank") + (pick("next") - pick("rank")) * F.max("part")).alias("result"))]
    return reduce(DataFrame.unionAll, out).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("q").alias("quantile"), "result")


def wide_quantiles(df: DataFrame, value: str, by: list[str], named: dict[str, float], most_rows: int = MOST_ROWS) -> DataFrame:
    """(by, a column for each name): the quantiles of a group in one row."""
    q = quantiles(df, value, by, list(named.values()), most_rows)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("quantile") == float(x), F.col("result"))).alias(n) for n, x in named.items()])
