"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words are a stream that is cut into blocks of equal size.  The
mix has as many blocks as its words make; sources get them by the highest
quotients ``votes / (2 j - 1)``, and each source's blocks go to its shards in
the same way, so every shard has an integer quota.  Within a shard the blocks
are chosen by a seeded permutation: each one as often as the quota has whole
rounds, and the first of the permutation once more.

Counting and apportioning are aggregates: the quotients are never listed.  The
number of seats that a divisor gives is a sum, so the divisor is narrowed down
by sums at ``STEPS`` divisors at once, and only seats of the last bracket are
ranked.  A shard has about ``SHARD_WORDS`` words, however large its source is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import bounded_broadcast, discard, written
from .texthash import IS_SPACE

#: What sources weigh, in the order of their names, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that a block has, about; words of a shard; times a word is taken at most.
BLOCK_WORDS, SHARD_WORDS, MOST_TIMES = 32, 2_000_000, 2
#: Divisors that are tried at once, and how often.
STEPS, ROUNDS = 256, 3


def count_words(texts: pa.Array) -> np.ndarray:
    """How many runs of other than the six white-space bytes each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    out, step = np.zeros(len(texts), np.int64), 1 << 22
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    i = 0
    while i < len(texts):  # some megabytes at once, one text at least
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + step, "right")) - 1)
        space = np.concatenate([[True], IS_SPACE[data[ends[i] : ends[j]]]])
        first = ~space[1:] & space[:-1]
        at = ends[i : j + 1] - ends[i]
        begin = at[:-1][at[:-1] < at[1:]]
        first[begin] = ~space[1:][begin]  # a text begins a word whatever stands before
        total = np.concatenate([[0], np.cumsum(first)])
        out[i:j] = total[at[1:]] - total[at[:-1]]
        i = j
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size): the
    mix has ``share`` of all words, sources share it by weight, and what goes
    beyond ``most`` times a source's size is shared again among the rest.

    What a unit of weight gets rises until no source is above its limit; each
    step is a sum over the sources.
    """
    spark = sizes.sparkSession
    placed = numbered(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "place").drop("_last")
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")]
    named = written(placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))), "sources")
    total = (named.agg(F.sum("source_size")).first()[0] or 0) * share
    unit = 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * unit
        gone, free = named.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - gone) / free if free else unit
        if new <= unit:
            break
        unit = new
    return named.select("source", "source_size", F.least("limit", F.col("weight") * unit).alias("target"))


def apportion(parties: DataFrame, seats: DataFrame) -> DataFrame:
    """``parties`` (group, party, votes, limit) with ``quota``: the ``seats``
    (group, seats) of each group by the highest quotients votes / (2 j - 1).

    No party has more than ``limit`` seats; ties go to the least party.  A
    divisor d gives a party ``floor(votes / d + 1/2)`` seats, which are those
    of quotients of d / 2 and more."""
    spark = parties.sparkSession

    def at(divisor):
        return F.least(F.col("limit"), F.floor(F.col("votes") / divisor + 0.5).cast("long"))

    sums = parties.groupBy("group").agg(F.sum("limit").alias("all"), F.max("votes").alias("top"), F.min(F.when(F.col("limit") > 0, F.col("votes") / (2 * F.col("limit")))).alias("least"))
    # At ``lo`` every party is at its limit or all seats are given; at ``hi`` none is.
    state = written(sums.join(seats, "group").select("group", F.least("seats", "all").alias("seats"), (F.coalesce("least", F.lit(1.0)) / 2).alias("lo"), (F.col("top") * 2.5).alias("hi")), "divisors")
    ratio = F.pow(F.col("hi") / F.col("lo"), 1.0 / STEPS)
    for _ in range(ROUNDS):
        steps = state.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(STEPS - 1)), lambda k: F.col("lo") * F.pow(ratio, k))).alias("k", "d"))
        tried = parties.join(bounded_broadcast(steps), "group").groupBy("group", "k").agg(F.sum(at(F.col("d"))).alias("given"), F.first("d").alias("d"), F.first("seats").alias("seats"))
        found = tried.groupBy("group").agg(F.max(F.when(F.col("given") >= F.col("seats"), F.col("d"))).alias("enough"), F.min(F.when(F.col("given") < F.col("seats"), F.col("d"))).alias("few"))
        new = written(state.join(found, "group", "left").select("group", "seats", F.coalesce("enough", "lo").alias("lo"), F.coalesce("few", "hi").alias("hi")), "divisors")
        discard(spark, state)
        state = new
    given = parties.join(bounded_broadcast(state), "group").withColumn("sure", at(F.col("hi"))).withColumn("maybe", at(F.col("lo")) - F.col("sure"))
    given = written(given, "given")
    discard(spark, state)
    # Only parties with a quotient in the last bracket are ranked.
    missing = given.groupBy("group").agg((F.first("seats") - F.sum("sure")).alias("missing")).where("missing > 0")
    contested = given.where("maybe > 0").join(missing, "group").select("group", "party", "missing", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("maybe")), lambda j: F.col("votes") / (2 * (F.col("sure") + j) - 1))).alias("quotient"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("quotient"), "party"))
    won = contested.withColumn("rank", rank).where("rank <= missing").groupBy("group", "party").agg(F.count("*").alias("won"))
    out = given.join(won, ["group", "party"], "left")
    return out.select("group", "party", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def permuted(n: int, seed: int) -> np.ndarray:
    """A permutation of the first ``n`` numbers, the same wherever it is made."""
    return np.random.default_rng(seed).permutation(n)


def take(sizes: np.ndarray, blocks: int, quota: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to, times) runs of the words that a shard gives, for
    documents of ``sizes`` words in a row, cut into ``blocks`` blocks."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = int(ends[-1])
    times = np.full(blocks, quota // max(blocks, 1), np.int64)
    times[permuted(blocks, seed)[: quota % max(blocks, 1)]] += 1
    border = np.arange(blocks + 1, dtype=np.int64) * total // max(blocks, 1)
    # Neighbouring blocks of equal times are one run; documents cut runs.
    change = np.concatenate([[True], np.diff(times) != 0]) if blocks else np.zeros(0, bool)
    cut = np.unique(np.concatenate([border[:-1][change], ends[:-1][sizes > 0]]))
    to = np.concatenate([cut[1:], [total]])
    doc = np.searchsorted(ends, cut, "right") - 1
    n = times[np.searchsorted(border, cut, "right") - 1] if blocks else np.zeros(0, np.int64)
    some = n > 0
    doc, cut, to, n = doc[some], cut[some], to[some], n[some]
    return doc, cut - ends[doc], to - ends[doc], n


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target,
    ``takes`` (runs of words as from, to, times) and ``taken`` (their words,
    repeats counted).

    A source's words are taken as near its target as its blocks allow, a word
    twice at most.  A null or empty text has no words and gives none; a null
    source is one of its own, last in order; ids may be null or repeat; rows
    equal in id, source and text stand next to each other, so which of them
    gives words makes no difference.  The result depends on the rows and the
    seed alone, not on how they are dealt.  An empty table gives an empty
    result; other columns are ignored."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(count_words(b.column(3)))], names=["doc_id", "source", "h", "size"])

    rows = written(d.mapInArrow(count, "doc_id long, source string, h long, size long"), "sizes")
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    sources = written(sized.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("shards", shards), "targets")
    # Rows of a source are dealt by what they are, so each shard has the same ones each time.
    order = F.xxhash64(F.lit(seed), "doc_id", "h")
    keyed = rows.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    dealt = keyed.join(bounded_broadcast(sources.select("group", "source_size", "target", "shards")), "group").withColumn("order", order).withColumn("party", F.pmod(F.xxhash64("order"), F.col("shards")))
    blocks = dealt.groupBy("group", "party").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("words > 0").withColumn(
        "blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long"))
    parties = written(blocks.select("group", "party", "blocks", (F.col("target") * F.col("words") / F.col("source_size") / block_words).alias("votes"), (F.col("blocks") * MOST_TIMES).alias("limit")), "shards")
    one = F.lit(0).alias("group")
    top = parties.groupBy("group").agg(F.sum("votes").alias("votes"), F.sum("limit").alias("limit")).select(one, F.col("group").alias("party"), "votes", "limit").where("votes > 0")
    seats = apportion(top, top.agg(F.round(F.sum("votes")).cast("long").alias("seats")).select(one, "seats").where("seats is not null"))
    quotas = written(seats.select(F.col("party").alias("group"), F.col("quota").alias("seats")), "quotas")
    shard_quota = apportion(parties.drop("blocks").where("votes > 0"), quotas)
    plan = written(parties.select("group", "party", "blocks").join(shard_quota, ["group", "party"], "left").withColumn("quota", F.coalesce("quota", F.lit(0))), "plan")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("h", "ascending"), ("size", "ascending")])
        sizes = t["size"].to_numpy().astype(np.int64)
        group, party = t["group"][0].as_py(), t["party"][0].as_py()
        own = zlib.crc32(f"{seed}/{party}/{group}".encode())
        doc, a, b, n = take(sizes, t["blocks"][0].as_py() or 0, t["quota"][0].as_py() or 0, own)
        offsets = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["from", "to", "times"])
        taken = np.bincount(doc, weights=((b - a) * n).astype(np.float64), minlength=len(sizes)).astype(np.int64)
        return pa.table([*(t[c] for c in ("doc_id", "source", "size", "source_size", "target")), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(taken)],
                        names=["doc_id", "source", "size", "source_size", "target", "takes", "taken"])

    schema = "doc_id long, source string, size long, source_size long, target double, takes array<struct<from: long, to: long, times: long>>, taken long"
    planned = dealt.join(bounded_broadcast(plan), ["group", "party"], "left")
    return planned.groupBy("group", "party").applyInArrow(choose, schema)
