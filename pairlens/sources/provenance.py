"""What a table was made from and by, as columns and as one record."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import inventory


def folder_digests(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(name, bytes, sha256) of a folder's files whose names match, without what
    stands before the folder."""
    d = inventory(spark, path)
    name = F.regexp_replace("path", "^.*" + re.escape("/" + path.rstrip("/").rsplit("/", 1)[-1] + "/"), "")
    return d.select(name.alias("name"), "bytes", "sha256").where(F.col("name").rlike(f"^(?:{pattern})$"))


def folder_digest(spark: SparkSession, path: str, pattern: str = ".*") -> str | None:
    """One digest of all names and contents, null for no file; the order in which
    files are listed doesn't count.  Sums of digests meet, not the files' rows."""
    d = folder_digests(spark, path, pattern).select(F.sha2(F.concat_ws("\t", "name", "sha256"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("long")).alias(f"w{k}") for k in range(1, 65, 8)]
    r = d.agg(F.count("*").alias("n"), *words).first()
    return None if not r.n else "".join(f"{v % (1 << 32):08x}" for k, v in r.asDict().items() if k != "n")


def commit_of(root: str) -> str | None:
    """The commit that a git checkout's head names, null where there is none."""
    git = os.path.join(root, ".git")
    try:
        with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head
        ref = head[5:]
        if os.path.exists(os.path.join(git, ref)):
            with open(os.path.join(git, ref), encoding="utf-8") as f:
                return f.read().strip()
        with open(os.path.join(git, "packed-refs"), encoding="utf-8") as f:
            return next((line.split()[0] for line in f if line.rstrip().endswith(" " + ref)), None)
    except OSError:
        return None


def stamped(df: DataFrame, facts: dict[str, str | None], name: str = "provenance") -> DataFrame:
    """``df`` with a column of facts, a map that is the same in every row."""
    pairs = [x for k, v in sorted(facts.items()) for x in (F.lit(k), F.lit(v).cast("string"))]
    return df.withColumn(name, F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))
