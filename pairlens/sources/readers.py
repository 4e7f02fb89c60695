"""Readers of sets, reports, logs and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCE = "struct<id:string,speaker:string,text:string,store:string,offset:bigint,length:bigint>"
REPORT_ROW = (
    "struct<id:string,speaker:string,seconds:double,reference:string,hypothesis:string,temperature:double,fallback_exhausted:boolean,"
    "edits:bigint,length:bigint,has_digit:boolean,raw:string,fixed:string,new_tokens:int,hit_token_limit:boolean,nonfinite_logits:boolean>"
)
STEP = "step long, loss double, skipped boolean, seconds double, longest boolean, peak_allocated_mb long, event string"


def file_order(path: Column) -> Column:
    """The number in a file's name, for files that are numbered."""
    return F.regexp_extract(path, r"(\d+)[^/\d]*$", 1).cast("long")


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` of Parquet files, with ``file`` (its number) and ``row`` for order."""
    d = spark.read.parquet(path)
    return d.select(*columns, file_order(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """A set's utterances with language and position."""
    d = spark.read.schema(f"language string, utterances array<{UTTERANCE}>").json(path, multiLine=True)
    return d.select("language", F.posexplode("utterances").alias("pos", "u")).select("language", "pos", "u.*").withColumn("seconds", F.col("length") / 16000)


def read_report(spark: SparkSession, path: str, keep_limited: bool = False) -> DataFrame:
    """A report's rows with a reference, in position.  A run over a part of its
    set, and ids that repeat, are errors where the rows are used."""
    d = spark.read.schema(f"summary struct<limit:bigint,precision:string>, utterances array<{REPORT_ROW}>").json(path, multiLine=True)
    whole = F.col("summary.limit").isNull() | (F.col("summary.limit") == 0) | F.lit(keep_limited)
    used = F.when(whole, F.filter("utterances", lambda u: u["length"] > 0)).otherwise(F.raise_error(F.lit("measured over a part of its set")).cast(f"array<{REPORT_ROW}>"))
    d = d.select(used.alias("rows"))
    unique = F.size(F.array_distinct(F.transform("rows", lambda u: u["id"]))) == F.size("rows")
    d = d.select(F.when(unique, F.col("rows")).otherwise(F.raise_error(F.lit("ids are not unique")).cast(f"array<{REPORT_ROW}>")).alias("rows"))
    return d.select(F.posexplode("rows").alias("pos", "u")).select("pos", "u.*")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select("summary.*")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """A step log's steps, without events, the last line of each step.  Files
    follow each other by the time of their last change, then name."""
    from ..operators.steps import last_wins

    d = spark.read.schema(STEP).json(path)
    # Rows of a split are read in order, so their numbers rise within it.
    m = F.col("_metadata")
    line = F.struct(m["file_modification_time"], m["file_path"], m["file_block_start"], F.monotonically_increasing_id())
    d = d.withColumn("_line", line).where("event is null and step is not null").drop("event")
    return last_wins(d, "step", "_line").drop("_line")


def read_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV file with a header; empty cells are null, ``numbers`` are doubles."""
    d = spark.read.csv(path, header=True)
    return d.withColumns({c: F.expr(f"try_cast(nullif(trim({c}), '') as double)") for c in numbers})


def read_map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(key, value...) of an object's field that maps names to ``value``."""
    d = spark.read.schema(f"{field} map<string,{value}>").json(path, multiLine=True)
    return d.select(F.explode(field).alias("key", "value"))


def read_listed(spark: SparkSession, folder: str, set_name: str) -> DataFrame:
    """The listed ids of a set, from the file of its base name: a list is fixed on
    clean audio, so ``set@channel`` has its set's.  A missing file is an error."""
    d = spark.read.schema("set string, count long, of long, ids array<string>").json(f"{folder}/{set_name.split('@')[0]}.json", multiLine=True)
    whole = F.when(F.size("ids") == F.coalesce("count", F.size("ids")), F.col("ids")).otherwise(F.raise_error(F.lit("the list is cut short")).cast("array<string>"))
    return d.select(F.explode(whole).alias("id"))


def read_definition(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, of, id) of a hold-out definition: the ids of its subsets, and
    the digests of its held-out sentences.  A missing file is an error."""
    subset = "struct<of:string,utterances:bigint,hours:double,speakers:bigint,never_trained:array<string>,ids:array<string>>"
    d = spark.read.schema(f"percent long, held_out long, held_out_sha256 array<string>, subsets map<string,{subset}>").json(path, multiLine=True)
    held = d.select(F.lit("held out").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("of"), F.explode("held_out_sha256").alias("id"))
    parts = d.select(F.explode("subsets").alias("name", "s"))
    listed = lambda kind, c: parts.select(F.lit(kind).alias("kind"), "name", "s.of", F.explode(f"s.{c}").alias("id"))
    return held.union(listed("subset", "ids")).union(listed("never trained", "never_trained"))


def read_speed(spark: SparkSession, path: str, preset: str, run: str) -> DataFrame:
    """The runs (of type ``run``) of a speed file.  Another preset, or a file
    that says it isn't complete, is an error; a file that says nothing is."""
    d = spark.read.schema(f"preset string, complete boolean, runs array<{run}>").json(path, multiLine=True)
    kind = f"array<{run}>"
    runs = (
        F.when(~F.col("preset").eqNullSafe(preset), F.raise_error(F.concat(F.lit("the preset is "), F.coalesce("preset", F.lit("unknown")))).cast(kind))
        .when(~F.coalesce("complete", F.lit(True)), F.raise_error(F.lit("the speed runs are not complete")).cast(kind)).otherwise(F.col("runs")))
    return d.select(F.explode(runs).alias("r")).select("r.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def first_object(text: Column, schema: str) -> Column:
    """The first JSON object that a text prints on lines of its own."""
    return F.from_json(F.regexp_extract(text, r"(?ms)^(\{.*?^\})", 1), schema)


def gpu_processes(text: Column) -> Column:
    """The lines after ``Processes:`` that begin with a digit."""
    after = F.when(F.contains(text, F.lit("Processes:")), F.substring_index(text, "Processes:", -1)).otherwise("")
    return F.filter(F.split(after, "\r?\n"), lambda line: line.rlike("^[0-9]"))


def gpu_line(text: Column) -> Column:
    """'memory, utilisation' as two integers."""
    part = F.split(text, ",")
    return F.struct(F.trim(part[0]).cast("int").alias("memory"), F.trim(part[1]).cast("int").alias("utilisation"))
