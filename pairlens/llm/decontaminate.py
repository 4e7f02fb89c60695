"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words.  Of each window the least hash of its
k-grams is its fingerprint; equal windows have equal fingerprints, so joining
the fingerprints of documents and items misses no shared span of ``window``
words or more.  Only windows whose fingerprint met an item's are then compared
word by word, and the runs of hit windows are extended over each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, held, row_key, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """A-Z lowered, then maximal runs without ASCII other than letters and digits."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
    return held(F.filter(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda x: x != ""))


def _fingerprints(window: int, k: int) -> tuple[Column, Column]:
    """From ``w``: k-gram hashes ``g``; from ``g``: a fingerprint per window."""
    empty = F.array().cast("array<bigint>")
    grams = F.when(
        F.size("w") >= window,
        F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])),
    ).otherwise(empty)
    per = window - k + 1
    mins = F.when(
        F.size("w") >= window,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - window),
            lambda i: F.least(*[F.get("g", i + j) for j in range(per)]) if per > 1 else F.get("g", i),
        ),
    ).otherwise(empty)
    return held(grams), held(mins)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(f, words, items): each distinct window of the items of that length."""
    grams, mins = _fingerprints(window, min(5, window))
    rows = (
        items.select("item_id", "w", grams.alias("g"))
        .select("item_id", "w", mins.alias("f"))
        .select("item_id", "w", F.posexplode("f").alias("i", "f"))
        .select("f", F.slice("w", F.col("i") + 1, window).alias("words"), "item_id")
    )
    return rows.groupBy("f", "words").agg(F.collect_set("item_id").alias("items"))


def _hits(docs: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(k, s, items): hit windows of the rows ``docs`` (k, w) and where they
    start.  The items' windows are written once, as they are read several times."""
    index = written(index, "windows")
    grams, mins = _fingerprints(window, min(5, window))
    prints = docs.select("k", "w", grams.alias("g")).select("k", mins.alias("f"), "w")
    keys = bounded_broadcast(index.select("f").distinct())
    met = (
        prints.select("k", F.explode(F.array_distinct("f")).alias("f"))
        .join(keys, "f", "left_semi")
        .groupBy("k").agg(F.collect_set("f").alias("met"))
    )
    found = (
        prints.join(met, "k")
        .select("k", "w", F.filter(
            F.transform("f", lambda x, i: F.struct(x.alias("f"), i.alias("s"))),
            lambda x: F.array_contains("met", x["f"]),
        ).alias("c"))
        .select("k", F.explode(F.transform("c", lambda x: F.struct(
            x["f"].alias("f"), x["s"].alias("s"), F.slice("w", x["s"] + 1, window).alias("words")))).alias("c"))
        .select("k", "c.*")
    )
    return found.join(bounded_broadcast(index), ["f", "words"]).select("k", "s", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items
    (sorted as strings), spans (hit runs as structs of start and length, in
    words), contaminated.

    An item with fewer words than ``window`` is one window of all its words; an
    item without words has none.  Items with a null id count in n_hit, spans and
    contaminated; having no id, they are not in items and n_items.  Null and empty texts have no words and no
    hits.  Rows that repeat id and text get the same result each; items that
    repeat an id count once.  Empty tables give empty results or no hits; other
    columns are ignored.
    """
    spark = docs.sparkSession
    item = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col)).alias("w"))
    item = item.where(F.size("w") > 0)
    lengths = [r[0] for r in item.select(F.least(F.size("w"), F.lit(window)).alias("n")).distinct().collect()]
    d = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    hits = None
    for n in sorted(lengths):  # at most ``window`` of them
        own = item.where(F.size("w") >= window if n == window else F.size("w") == n)
        got = _hits(d.select("k", "w"), _windows(own, n), n).withColumn("n", F.lit(n))
        hits = got if hits is None else hits.unionByName(got)
    counted = d.select("k", "doc_id", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if hits is None:
        hits = spark.createDataFrame([], "k long, s int, items array<string>, n int")
    # Hit windows of a row in order; one that begins beyond all ends before it
    # begins another run.  Sorted rows spill, so a row may have very many hits.
    order = Window.partitionBy("k").orderBy("s", "n")
    reach = F.max(F.col("s") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    runs = hits.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = (
        runs.groupBy("k", "run").agg(
            F.min("s").alias("start"), (F.max(F.col("s") + F.col("n")) - F.min("s")).alias("length"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .groupBy("k").agg(
            F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    out = counted.join(per, "k", "left").select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)
