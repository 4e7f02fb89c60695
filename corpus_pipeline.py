"""A corpus pipeline of five stages, each an operator of ``pairlens.llm``.

Each stage gets what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of ``documents``, whatever further ones
there are, with names that clash with the operators' own, too.  An empty table
gives an empty one at each stage; ids may be null or repeat, as rows are told
apart by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import language
from pairlens.llm.common import bounded_broadcast, row_key, table, written
from pairlens.llm.decontaminate import decontaminate
from pairlens.llm.line_dedup import line_dedup
from pairlens.llm.ngram_join import ngram_join
from pairlens.llm.packing import pack

#: A document whose best language has less of the likelihood is rejected.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or of no clear language.

    Null and empty texts go.  Rows are judged each by itself, so repeated ones
    have the same lot; of tied languages the first in order counts, and its
    score is then that of no clear language.  Very long texts are read whole."""
    out = language.predict(docs, language.fit(docs), keep_row=True)
    return out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; a document that has nothing else goes.

    A document without a repeated line stays as it is, a null or blank one as
    well.  Of equal lines the one of least id and line number stays, null ids
    first.  Rows equal in id and text stand at one place and keep the same
    lines.  ``n_chars`` follows the text where it changes."""
    out = line_dedup(docs).where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[
        F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else F.col(f"row.{c}").alias(c)
        for c in docs.columns
    ])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that link by five-word shingles at 0.8, one stays: that of least
    id, a row without an id only if none has one.

    A row is told by a hash of all its columns and its id, so ids may be null or
    repeat, and of rows that repeat in all one stays.  Null, empty and blank
    texts have no shingles, link with nothing and stay, repeated ones as well."""
    rows = docs.withColumn("_row", F.xxhash64(*[F.col(c).isNull() for c in docs.columns], *docs.columns))
    some = F.col("text").rlike("[^ \\t-\\r]")
    keys = written(rows.where(some).groupBy("_row", "doc_id").agg(F.count("*").alias("n")), "keys")
    out = ngram_join(rows, k=5, num=80, den=100, id_col="_row").where("doc_id <> component_id")
    linked = written(out.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")).distinct(), "linked")
    members = linked.union(linked.select(F.col("group").alias("_row"), "group").distinct())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = keys.join(members, "_row").groupBy("group").agg(F.min_by("_row", order).alias("_row"))
    gone = written(members.join(first, "_row", "left_anti").select("_row").distinct(), "gone")
    left = rows.join(bounded_broadcast(gone), "_row", "left_anti")
    again = written(keys.where("n > 1").select("_row", F.col("doc_id").alias("_id")), "again")
    if again.limit(1).count():  # only rows that repeat meet
        same = (left["_row"] == again["_row"]) & left["doc_id"].eqNullSafe(again["_id"])
        found = bounded_broadcast(again)
        left = left.join(found, same, "left_anti").union(left.join(found, same, "left_semi").dropDuplicates(["_row", "doc_id"]))
    return left.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that share a window with a benchmark item.

    Rows equal in id and text have one key and one verdict; ids may be null or
    repeat.  Null and empty texts hit nothing and stay, as all rows do where the
    benchmark is empty; items with a null id count."""
    rows = docs.withColumn("_row", row_key("doc_id", "text"))
    out = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    gone = written(out.where("contaminated").select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return rows.join(bounded_broadcast(gone), "_row", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences.

    A null or empty text is its end id alone; rows that repeat are packed each;
    a very long text takes many sequences."""
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Language identification is no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
