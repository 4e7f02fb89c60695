"""Reports: fixed plans of comparisons over sets of scored rows.

A scored set is a DataFrame of id, reference, hypothesis, edits and length, as
``load_report`` reads it.  Every plan gives a DataFrame; what is read more than
once is written first, so refusals are errors then or when the result is
computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, strip
from ..operators import compare, resample
from ..operators.overlap import read_counts
from ..operators.rates import distinct_nonempty, rate, relative
from ..operators.shared import materialized
from ..sources.readers import read_report
from .verdicts import Condition


def load_report(spark: SparkSession, path: str, language: str, scoring: str | None = None) -> DataFrame:
    """A report's rows with a reference, scored anew on demand; rows whose
    reference the scoring empties go, too.  A scoring of another language, a
    run over a part of its set and repeated ids are errors."""
    rows = read_report(spark, path)
    return rows if scoring is None else compare.rescored(rows, scoring, language).where("length > 0")


def _wide(reports: dict[str, DataFrame], id_col: str) -> tuple[DataFrame, list[str]]:
    """Rows of all reports: edits ``e0``, ``e1``, ... in order, and length."""
    sides = [d.select(id_col, F.col("edits").alias(f"e{k}"), F.col("length").alias(f"l{k}")) for k, d in enumerate(reports.values())]
    wide = reduce(lambda a, b: a.join(b, id_col), sides)
    same = reduce(Column.__and__, [F.col("l0") == F.col(f"l{k}") for k in range(len(sides))])
    length = F.when(same, F.col("l0")).otherwise(F.raise_error(F.lit("the reports give different reference lengths")).cast("long"))
    edits = [f"e{k}" for k in range(len(sides))]
    return wide.select(id_col, *edits, length.alias("length")), edits


def comparison_table(
    reports: dict[str, DataFrame], baseline: str | None = None, listed: DataFrame | None = None, id_col: str = "id", **how,
) -> DataFrame:
    """subset, report, utterances, rate, low, high and, against ``baseline``,
    delta, delta_low, delta_high, relative (null for itself).

    Only rows of all reports count.  With ``listed`` ids there is a second
    subset without them, ``no digits``.  All reports share one set of draws
    (``how``: as of ``resample``), so a subset costs one pass of resampling.
    """
    if baseline is not None and baseline not in reports:
        raise ValueError(f"no report {baseline}")
    wide, edits = _wide(reports, id_col)
    wide = materialized(wide, "wide")
    subsets = {"all": wide}
    if listed is not None:
        subsets["no digits"] = wide.join(listed.select(id_col).distinct(), id_col, "left_anti")
    base = None if baseline is None else f"e{list(reports).index(baseline)}"
    out = []
    for label, rows in subsets.items():
        sums = resample.resampled_sums(rows, [*edits, "length"], id_col, **how)
        both = lambda value: F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
        share = lambda e: F.col(e) / F.col("length")
        ends = sums.agg(*[both(share(e)).alias(f"c{e}") for e in edits], *[both(share(e) - share(base)).alias(f"d{e}") for e in edits if base and e != base])
        points = rows.agg(F.count("*").alias("utterances"), *[rate(e).alias(f"r{e}") for e in edits])
        one = points.join(F.broadcast(ends))
        none = F.lit(None).cast("double")
        lines = []
        for name, e in zip(reports, edits, strict=True):
            against = base is not None and e != base
            delta = F.col(f"r{e}") - F.col(f"r{base}") if against else none
            lines.append(F.struct(
                F.lit(name).alias("report"), F.col(f"r{e}").alias("rate"), F.col(f"c{e}")[0].alias("low"), F.col(f"c{e}")[1].alias("high"),
                delta.alias("delta"), (F.col(f"d{e}")[0] if against else none).alias("delta_low"), (F.col(f"d{e}")[1] if against else none).alias("delta_high"),
                (relative(delta, F.col(f"r{base}")) if against else none).alias("relative")))
        out.append(one.select(F.lit(label).alias("subset"), "utterances", F.explode(F.array(*lines)).alias("x")).select("subset", "utterances", "x.*"))
    return reduce(DataFrame.unionByName, out)


def marked_ids(reports: dict[str, DataFrame], flag: str = "has_digit", id_col: str = "id") -> DataFrame:
    """(id, reports): the union of the ids that any report marks, and which do."""
    marked = [d.where(F.col(flag)).select(id_col, F.lit(name).alias("_r")) for name, d in reports.items()]
    return reduce(DataFrame.unionAll, marked).groupBy(id_col).agg(F.array_sort(F.collect_set("_r")).alias("reports"))


def marked_counts(reports: dict[str, DataFrame], flag: str = "has_digit", id_col: str = "id") -> DataFrame:
    """One row: how many ids each report marks (a map), how many any does, and
    of how many."""
    ids = marked_ids(reports, flag, id_col)
    per = F.map_from_arrays(F.array(*map(F.lit, reports)), F.array(*[F.count_if(F.array_contains("reports", name)) for name in reports]))
    total = next(iter(reports.values())).agg(F.count("*").alias("of"))
    return ids.agg(per.alias("per_report"), F.count("*").alias("count")).join(F.broadcast(total))


def block_report(pairs: DataFrame, id_col: str, block: str, *, samples: int = resample.SAMPLES, **how) -> DataFrame:
    """One row: delta, its interval by row and by block, blocks, and the least
    and the greatest delta without one block, with that block (of equal ones
    the first by name).  ``pairs`` is computed once."""
    pairs = materialized(pairs.select(*dict.fromkeys([id_col, block, "edits_a", "edits_b", "length"])), "pairs")
    point = compare.compare(pairs).select("utterances", "baseline", "candidate", "delta", "relative")
    by_row = resample.difference_interval(pairs, id_col, samples=samples, **how)
    by_block = resample.difference_interval(pairs, block, **how).withColumnsRenamed({"low": "block_low", "high": "block_high"})
    b = F.col(block).cast("string")
    left = resample.leave_one_out(pairs, block).agg(
        F.count("*").alias("blocks"), F.min("delta").alias("least"), F.min_by(b, F.struct("delta", b)).alias("least_without"),
        F.max("delta").alias("greatest"), F.min_by(b, F.struct(-F.col("delta"), b)).alias("greatest_without"))
    return point.join(F.broadcast(by_row)).join(F.broadcast(by_block)).join(F.broadcast(left))


@dataclass(frozen=True)
class EndsRule:
    """What the ends of an interval must meet: every bound, or any of them."""

    bounds: tuple[Condition, ...]
    every: bool = True

    def holds(self, prefix: str = "") -> Column:
        terms = [replace(c, column=prefix + c.column).holds() for c in self.bounds]
        return reduce(Column.__and__ if self.every else Column.__or__, terms)


def _upper(op: str, bound: float) -> EndsRule:
    return EndsRule((Condition("upper", "high", op, bound),))


#: Rules that registered comparisons rested on, by the names that records give them; bounds are shares.
INTERVAL_RULES = {
    "upper < 0": _upper("<", 0.0),
    "upper <= +0.1%p": _upper("<=", 0.001),
    "upper < +0.10%p": _upper("<", 0.001),
    "upper <= +1.0%p": _upper("<=", 0.01),
    "contains 0": EndsRule((Condition("lower", "low", "<=", 0.0), Condition("upper", "high", ">=", 0.0))),
    "excludes 0": EndsRule((Condition("lower", "low", ">", 0.0), Condition("upper", "high", "<", 0.0)), every=False),
}


@dataclass(frozen=True)
class Registered:
    """A comparison that a decision rested on, and what it then gave."""

    number: int
    stage: str
    pairs: DataFrame
    condition: str
    recorded: bool


def robust(registry: Sequence[Registered], id_col: str, block: str, **how) -> DataFrame:
    """Each registered comparison by rows and again by blocks: number, stage,
    the columns of ``block_report``, by_rows, by_blocks, mark.  If by rows it no
    longer gives what is recorded, that is an error."""
    out = []
    for x in registry:
        rule = INTERVAL_RULES[x.condition]
        d = block_report(x.pairs, id_col, block, **how)
        rows, blocks = rule.holds(), rule.holds("block_")
        message = f"{x.number}: the interval by rows no longer gives the recorded result"
        checked = F.when(rows == F.lit(x.recorded), rows).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
        mark = F.when(blocks == F.lit(x.recorded), "same").otherwise("undecided by blocks" if x.recorded else "differs by blocks")
        out.append(d.select(
            F.lit(x.number).alias("number"), F.lit(x.stage).alias("stage"), "*", F.lit(x.condition).alias("condition"),
            checked.alias("by_rows"), blocks.alias("by_blocks"), mark.alias("mark")))
    return reduce(DataFrame.unionByName, out)


def arm_conditions(flags: DataFrame, differences: DataFrame, arm: str = "arm", most: float = 0.001) -> DataFrame:
    """Per retry arm: recorded loops, those that no arm decoded again, loops
    left, the highest upper end, and tested, stops, harmless.

    ``flags``: rows of ``compare.change_flags`` with their arm; ``differences``:
    (arm, high) of each comparison."""
    a = flags.groupBy(arm).agg(
        F.count_if("loop_before").alias("recorded"), F.count_if(F.col("loop_before") & ~F.col("redecoded")).alias("untested"),
        F.count_if("loop_after").alias("left"))
    d = a.join(differences.groupBy(arm).agg(F.max("high").alias("highest")), arm)
    tested = (F.col("recorded") > 0) & (F.col("untested") == 0)
    return d.select("*", tested.alias("tested"), (tested & (F.col("left") == 0)).alias("stops"), (F.col("highest") <= most).alias("harmless"))


def pick_arm(conditions: DataFrame, order: Sequence[str], arm: str = "arm") -> DataFrame:
    """(picked): the first arm in ``order`` that stops the loops and does no
    harm, null if none.  An arm that was not tested is an error."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(arm))
    good = F.col("stops") & F.col("harmless")
    d = conditions.agg(F.min(F.col("tested")).alias("_all"), F.min_by(F.when(good, F.col(arm)), F.when(good, place)).alias("picked"))
    return d.select(F.when(F.col("_all"), F.col("picked")).otherwise(F.raise_error(F.lit("a recorded loop was not decoded again")).cast("string")).alias("picked"))


def overlap_record(train: DataFrame, rows: DataFrame, language: str, set_col: str = "set", group: str = "speaker", text: str = "text") -> DataFrame:
    """Per set and kind of key (raw, normalized): utterances, speakers,
    speakers_in_train, in_train (rows), sentences, sentences_in_train,
    repeated_sentences, repeated_utterances, most_reads.

    ``rows`` holds all sets.  Where both tables have a ``language``, a row of
    another one than ``language`` is an error: its keys can't be compared."""
    def checked(d: DataFrame) -> DataFrame:
        if "language" not in d.columns:
            return d
        message = f"a row's language is not {language}"
        return d.withColumn(text, F.when(F.col("language") == language, F.col(text)).otherwise(F.raise_error(F.lit(message)).cast("string")))

    train, rows = checked(train), checked(rows)
    known = train.select(F.col(group).alias("_g")).where("_g <> ''").distinct()
    who = rows.select(set_col, group).where(F.col(group) != "").distinct().join(known, F.col(group) == F.col("_g"), "left")
    people = who.groupBy(set_col).agg(F.count("*").alias("speakers"), F.count("_g").alias("speakers_in_train"))
    out = []
    for kind, key in (("raw", strip(text)), ("normalized", normalize(text, language))):
        r = read_counts(rows.select(set_col, key.alias("_k")), train.select(key.alias("_k")), "_k")
        n = r.groupBy(set_col, "_k").agg(F.count("*").alias("n"), F.max("train_reads").alias("reads"))
        seen, again = F.col("reads") > 0, F.col("n") > 1
        out.append(n.groupBy(set_col).agg(
            F.sum("n").alias("utterances"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("in_train"), F.count("*").alias("sentences"),
            F.count_if(seen).alias("sentences_in_train"), F.count_if(again).alias("repeated_sentences"),
            F.sum(F.when(again, F.col("n")).otherwise(0)).alias("repeated_utterances"), F.max("reads").alias("most_reads"),
        ).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out).join(people, set_col, "left").fillna(0, ["speakers", "speakers_in_train"])


def train_record(train: DataFrame, language: str, group: str = "speaker", text: str = "text") -> DataFrame:
    """Per kind of key: utterances, speakers, sentences, most reads, sentences
    read more than once."""
    out = []
    for kind, key in (("raw", strip(text)), ("normalized", normalize(text, language))):
        n = train.groupBy(key.alias("_k")).agg(F.count("*").alias("n"))
        out.append(n.agg(F.sum("n").alias("utterances"), F.count("*").alias("sentences"), F.max("n").alias("most_reads"), F.count_if(F.col("n") > 1).alias("repeated_sentences")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out).join(F.broadcast(train.agg(distinct_nonempty(group).alias("speakers"))))


#: Shares of the gain below which memory counts as small, and from which as half.
SMALL_SHARE, HALF_SHARE = 0.25, 0.5


def holdout_report(
    candidate: DataFrame, full: DataFrame, baseline: DataFrame, unseen: DataFrame, seen: DataFrame, id_col: str = "id", samples: int = 10_000, **how,
) -> DataFrame:
    """One row: what a model that was held out from some sentences tells of
    memory: gain (baseline - full on unseen ones), m and c (candidate - full on
    unseen and seen ones), share (m - c) with share_low and share_high, upper
    (the upper end of candidate - baseline on unseen ones), verdict and
    interpretation.  Reports that don't cover all ids are an error."""
    def pairs(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
        return compare.paired(a, b, id_col).join(ids.select(id_col).distinct(), id_col, "left_semi")

    def delta(a: DataFrame, b: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        there = ids.select(id_col).distinct().agg(F.count("*").alias("_n"))
        got = compare.compare(pairs(a, b, ids)).join(F.broadcast(there))
        message = F.lit("the reports do not cover all ids; measure the whole set again")
        return got.select(F.when(F.col("utterances") == F.col("_n"), F.col("delta")).otherwise(F.raise_error(message).cast("double")).alias(name))

    how = {"samples": samples, **how}
    parts = [
        delta(full, baseline, unseen, "full_delta"), delta(candidate, baseline, unseen, "against"), delta(candidate, full, unseen, "m"), delta(candidate, full, seen, "c"),
        resample.difference_interval(pairs(candidate, baseline, unseen), id_col, **how).withColumnsRenamed({"low": "lower", "high": "upper"}),
        resample.share_interval(pairs(candidate, full, unseen), pairs(candidate, full, seen), id_col, **how).withColumnsRenamed({"low": "share_low", "high": "share_high"}),
    ]
    d = reduce(lambda a, b: a.join(F.broadcast(b)), parts).withColumn("gain", -F.col("full_delta")).withColumn("share", F.col("m") - F.col("c"))
    verdict = F.when(F.col("upper") < 0, "gains on unseen sentences").otherwise("shows no gain on unseen sentences")
    memory = (
        F.when(F.col("gain") <= 0, "not interpreted").when(F.col("share") < F.col("gain") * SMALL_SHARE, "memory is small")
        .when(F.col("share") >= F.col("gain") * HALF_SHARE, "half of the gain or more is memory").otherwise("part of the gain is memory"))
    return d.select("gain", "against", "lower", "upper", "m", "c", "share", "share_low", "share_high", verdict.alias("verdict"), memory.alias("interpretation"))
