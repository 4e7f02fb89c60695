"""Nested definitions (JSON documents): canonical forms and what differs.

A document is parsed once to a variant and taken apart level by level, so the
work is Spark's at any nesting; leaves are rows of (path, value).  Order of
keys and forms of numbers make no difference: 1, 1.0 and 1e0 are one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialized

#: Levels that are taken apart before it is looked whether any are left.
LEVELS = 4


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _leaf(v: Column) -> Column:
    """A leaf's canonical text: a JSON string, number, boolean or null."""
    kind, number = _kind(v), F.try_variant_get(v, "$", "double")
    whole = F.try_variant_get(v, "$", "long")
    plain = F.when(whole.isNotNull() & (whole.cast("double") == number), whole.cast("string")).otherwise(number.cast("string"))
    return F.when(kind == "STRING", F.to_json(v)).when(kind == "BOOLEAN", F.to_json(v)).when(kind == "VOID", "null").when(kind == "OBJECT", "{}").when(kind == "ARRAY", "[]").otherwise(plain)


def leaves(df: DataFrame, json: str, keys: list[str], sets: list[str] = ()) -> DataFrame:
    """(keys, path, value) of each document: one row per leaf, and per empty
    object or array.

    Members are ``.name`` and elements ``[n]`` from 0.  Arrays at the paths
    ``sets`` (numbers of elements left out, as in ``.sets[].ids``) are sets:
    their order counts for nothing, equal elements count once, and elements,
    which may be nested, are named by their own canonical text.  A null
    document has no leaves; one that isn't JSON has one, ``invalid``."""
    d = df.select(*keys, F.lit("").alias("path"), F.lit("").alias("shape"), F.col(json).alias("_json"), F.try_parse_json(F.col(json)).alias("v")).where(F.col("_json").isNotNull())
    done = [d.where("v is null").select(*keys, "path", F.lit("invalid").alias("value"))]
    rows = d.where("v is not null").select(*keys, "path", "shape", "v")
    while True:
        for _ in range(LEVELS):
            nested = _kind(F.col("v")).isin("OBJECT", "ARRAY") & ~F.to_json("v").isin("{}", "[]")
            in_set = F.col("shape").isin(list(sets)) & (_kind(F.col("v")) == "ARRAY")
            done.append(rows.where(~nested).select(*keys, "path", _leaf(F.col("v")).alias("value")))
            deep = rows.where(nested).withColumn("_set", in_set)
            rows = deep.lateralJoin(deep.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("_v"))).select(
                *keys,
                F.when(F.col("_set"), F.concat("path", F.lit("{"), _sorted_text(F.col("_v")), F.lit("}"))).when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"),
                F.when(F.col("key").isNull(), F.concat("shape", F.lit("[]"))).otherwise(F.concat("shape", F.lit("."), "key")).alias("shape"), F.col("_v").alias("v"))
        rows = materialized(rows, "nested")
        if not rows.limit(1).count():
            break
    return reduce(DataFrame.unionAll, done).distinct()


def _sorted_text(v: Column) -> Column:
    """The text that names an element of a set.  A variant's members are in order
    of their names already; whole numbers lose what stands behind the point."""
    nested = F.regexp_replace(F.to_json(v), r"(?<=[:\[,])(-?[0-9]+)\.0+(?=[,\]}])", "$1")
    return F.when(_kind(v).isin("OBJECT", "ARRAY"), nested).otherwise(_leaf(v))


def diff(before: DataFrame, after: DataFrame, json: str, keys: list[str], sets: list[str] = ()) -> DataFrame:
    """(keys, path, before, after): where the documents of equal keys differ, null
    for what one side lacks.  No rows: the definitions are equal."""
    a = leaves(before, json, keys, sets).withColumnsRenamed({k: f"_a{n}" for n, k in enumerate(keys)} | {"path": "_ap", "value": "before"})
    b = leaves(after, json, keys, sets).withColumnsRenamed({k: f"_b{n}" for n, k in enumerate(keys)} | {"path": "_bp", "value": "after"})
    same = reduce(lambda x, y: x & y, [F.col(f"_a{n}").eqNullSafe(F.col(f"_b{n}")) for n in range(len(keys))], F.col("_ap") == F.col("_bp"))
    joined = a.join(b, same, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    left = F.col("_ap").isNotNull()
    return joined.select(*[F.when(left, F.col(f"_a{n}")).otherwise(F.col(f"_b{n}")).alias(k) for n, k in enumerate(keys)], F.coalesce("_ap", "_bp").alias("path"), "before", "after")


def canonical(df: DataFrame, json: str, keys: list[str], sets: list[str] = ()) -> DataFrame:
    """(keys, digest): the SHA-256 of a document's leaves in order; equal for
    documents that differ in key order, number forms or order of sets alone."""
    text = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("\t", "path", "value"))))
    return leaves(df, json, keys, sets).groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))


def require_equal(before: DataFrame, after: DataFrame, json: str, keys: list[str], sets: list[str] = ()) -> None:
    """An error that names the members of the first level that differ, if any do."""
    top = F.regexp_extract("path", r"^\.?([^.\[{]*)", 1)
    found = [r.name for r in diff(before, after, json, keys, sets).select(top.alias("name")).distinct().orderBy("name").limit(20).collect()]
    if found:
        raise ValueError(f"the definitions differ ({', '.join(found)})")
