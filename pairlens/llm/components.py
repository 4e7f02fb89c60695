"""Connected components of a table of links, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_parts, written

#: Rows of the rounds' narrow tables that a part has.
ROWS = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b: long): the least node
    that links reach.

    Each round takes the least label among neighbours (a sum-like aggregate,
    combined before the shuffle) and then the label's own label, so paths halve.
    Rounds end when no label changes.
    """
    n = 2 * links.count()
    both = written(in_parts(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), n, ROWS), "links")
    labels = written(in_parts(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), n, ROWS), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = step.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "far"), "label").alias("label"))
        new = written(in_parts(new, n, ROWS), "labels")
        changed = new.where("old <> label").limit(1).count()
        discard(both.sparkSession, labels)
        labels = new
        if not changed:
            discard(both.sparkSession, both)
            return labels.select("node", "label")
