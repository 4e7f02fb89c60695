"""Line deduplication by a deletion-neighbourhood join, one edit being a word.

A line is its words, A-Z lowered.  Lines of ``min_words`` words or more are
compared: of equal ones the earliest stays, by document id and line number; and
a line of ``near_words`` or more goes if an earlier one is within one inserted,
deleted or replaced word.  For the latter each line emits the hashes of itself
and of all variants with one word deleted.  Equal variants with the deletion at
the same place are a replacement apart; a variant equal to a whole line is a
deletion apart.  The earliest line of each variant is all that others need, so
variants meet in a minimum, not in pairs, and what that finds is verified word
by word.

Only lines that share their first or last half with another emit variants:
lines within one edit always do.  What is deleted is not among the words that
two lines share, so a line that shares its first half alone emits no deletions
there.  Only variants that several lines have are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, bounded_broadcast, discard, row_key, small_batches, written
from .texthash import _MIX, _power_tables, Spans, mix, word_spans
from .tokens import text_slices
from .workers import tidy

#: Every line that has a word is compared; from five words on, one edit counts.
MIN_WORDS, NEAR_WORDS = 1, 5
#: Bytes of texts that are hashed at once: arrays of eight times that stay in a CPU's cache.
HASHED = 1 << 18
_SIDES = ("p1", "s1", "p2", "s2")


class _Lines:
    """Lines as runs of words' hashes: one's go from ``at`` to the next ``at``."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        self.hashes, self.at, self.n = hashes, at, np.diff(at)
        n = len(hashes)
        up, self.down = _power_tables(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def value(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sums[j] - self.sums[i]) * self.down[i]

    def key(self, value: np.ndarray, n: np.ndarray, kind: int = 0) -> np.ndarray:
        return mix(value + n.astype(np.uint64) * _MIX[1] + _MIX[2 + kind])

    def keys(self) -> np.ndarray:
        return self.key(self.value(self.at[:-1], self.at[1:]), self.n)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, where each text begins
    (one more at the end), and where the line feeds are: one ends each line."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.string()), "", "\n")
    begins = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[begins[0] : begins[-1]]
    return data, begins - begins[0], np.flatnonzero(data == 10)


def _hashed(data: np.ndarray, breaks: np.ndarray) -> _Lines:
    start, end = word_spans(data)
    return _Lines(Spans(data, lower=True).hash(start, end), np.concatenate([[0], np.searchsorted(start, breaks)]))


def _half(n: np.ndarray) -> np.ndarray:
    """Half of ``n``, rounded down to three binary digits, so that most lengths
    have that of the next."""
    h = n // 2
    return h - h % (1 << np.maximum(np.frexp(h)[1] - 3, 0))


def _halves(x: _Lines, at: np.ndarray, near_words: int) -> list[pa.Array]:
    """Keys of the first and last words, as many as ``_half`` of the line's
    length, and as that of one less where it differs."""
    i, j, n = x.at[at], x.at[at + 1], x.n[at]
    own, less = _half(n), _half(n - 1)
    out = []
    for h, none in ((own, n < near_words), (less, (n <= near_words) | (less == own))):
        for kind, key in ((1, x.value(i, i + h)), (2, x.value(j - h, j))):
            out.append(pa.array(x.key(key, h, kind).view(np.int64), mask=none))
    return out


def _lines_of(min_words: int, near_words: int):
    def run(batches):
        for b in batches:
            for i, j in text_slices(b.column(2), HASHED):
                data, begins, breaks = _bytes_of(b.column(2).slice(i, j - i))
                x = _hashed(data, breaks)
                row = np.searchsorted(begins, breaks, "right") - 1
                number = np.arange(len(breaks)) - np.searchsorted(breaks, begins[:-1])[row]
                at = np.flatnonzero(x.n >= min_words)
                row = pa.array(row[at] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.keys()[at].view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(number[at].astype(np.int32)), *_halves(x, at, near_words)],
                    names=["line", "doc_id", "k", "number", *_SIDES])

    return run


def _words_of(batches):
    """Of each text, the lines that are asked for, as their words' hashes."""
    for b in batches:
        for i, j in text_slices(b.column(0), HASHED):
            data, begins, breaks = _bytes_of(b.column(0).slice(i, j - i))
            lists = b.column(1).slice(i, j - i)
            wanted = lists.flatten()
            line = np.repeat(np.searchsorted(breaks, begins[:-1]), lists.value_lengths()) + wanted.field("number").to_numpy()
            order = np.argsort(line)
            line, sides = line[order], wanted.field("sides").take(pa.array(order))
            length = np.diff(np.concatenate([[-1], breaks]))
            mine = np.zeros(len(breaks), bool)
            mine[line] = True
            x = _hashed(data[np.repeat(mine, length)], np.cumsum(length[mine]) - 1)
            words = pa.Array.from_buffers(pa.binary(), len(line), [None, pa.py_buffer((x.at * 8).astype(np.int32)), pa.py_buffer(x.hashes.astype("<u8"))])
            yield pa.RecordBatch.from_arrays([pa.array(x.keys().view(np.int64)), sides, words], names=["line", "sides", "words"])


def _variants_of(batches):
    """Rows of (variant, place, line): place -1 is the whole line.

    Of two lines that share their first words, the edit is behind these; of two
    that share their last, and not their first, it is among the first."""
    for b in batches:
        for i, j in text_slices(b.column(2)):
            words = b.column(2).slice(i, j - i)
            hashes = np.frombuffer(b"".join(words.to_pylist()), "<u8")
            x = _Lines(hashes, np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy() // 8)]))
            n, sides, line = x.n, b.column(1).slice(i, j - i).to_numpy(), x.keys()
            own, less = _half(n), _half(n - 1)
            behind = np.minimum(np.where(sides & 1, own, n), np.where(sides & 4, less, n))
            before = np.maximum(np.where(sides & 2, own, 0), np.where(sides & 8, less, 0))
            of = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(of)) - np.repeat(x.at[:-1], n)
            cut = np.flatnonzero((place >= behind[of]) | (place < before[of]))
            of, place = of[cut], place[cut]
            s, e = x.at[of], x.at[of + 1]
            value = x.value(s, cut) + (x.sums[e] - x.sums[cut + 1]) * x.down[s + 1]
            keys = np.concatenate([line, x.key(value, n[of] - 1)])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.view(np.int64)), pa.array(np.concatenate([np.full(len(n), -1), place]).astype(np.int32)),
                pa.array(np.concatenate([line, line[of]]).view(np.int64)),
            ], names=["variant", "place", "line"])


def within_one(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sequences are within one edit."""
    if abs(len(x) - len(y)) > 1:
        return False
    m = min(len(x), len(y))
    same = x[:m] == y[:m]
    front = m if same.all() else int(same.argmin())
    same = x[::-1][:m] == y[::-1][:m]
    back = m if same.all() else int(same.argmin())
    return front + back >= max(len(x), len(y)) - 1


def _verified(batches):
    for b in batches:
        good = [within_one(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_()))], names=["line"])


def _left(texts: pa.Array, kept: pa.Array, min_words: int) -> pa.StructArray:
    """What is left of each text, null where nothing goes, and the numbers of its
    lines and of those that go: lines that aren't kept and have enough words."""
    data, begins, breaks = _bytes_of(texts)
    first = np.searchsorted(breaks, begins)
    length = np.diff(np.concatenate([[-1], breaks]))
    stay = np.zeros(len(breaks), bool)
    stay[np.repeat(first[:-1], pc.fill_null(kept.value_lengths(), 0).to_numpy()) + kept.flatten().to_numpy()] = True
    rest = np.flatnonzero(~stay)
    start, _ = word_spans(data[np.repeat(~stay, length)])
    n = np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum(length[rest]))]))
    stay[rest[n < min_words]] = True
    gone = np.diff(np.concatenate([[0], np.cumsum(~stay)])[first])
    # The lines that stay of changed texts, each text's last one without its line feed.
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.flatnonzero(stay & (gone > 0)[row])
    taken = np.zeros(len(breaks), bool)
    taken[at] = True
    taken = np.repeat(taken, length)
    last = at[np.flatnonzero(np.diff(row[at], append=-1))]
    taken[breaks[last]] = False
    size = np.bincount(row[at], length[at], len(texts)).astype(np.int64)
    size[row[last]] -= 1
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    changed = pa.array(gone > 0)
    text = pa.Array.from_buffers(pa.string(), len(texts), [changed.buffers()[1], pa.py_buffer(ends), pa.py_buffer(data[taken])])
    return pa.StructArray.from_arrays([text, pa.array(np.diff(first)), pa.array(gone)], names=["text", "n_lines", "n_removed"])


_LEFT = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])


def _rebuilt(min_words: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kept in batches:
            parts = [_left(texts.slice(i, j - i), kept.slice(i, j - i), min_words) for i, j in text_slices(texts, HASHED)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _LEFT)

    # Not to be called once more for a predicate on what it returns.
    return F.arrow_udf(tidy(run), "text string, n_lines long, n_removed long").asNondeterministic()


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS,
) -> DataFrame:
    """One row per input row: row (a struct of all its columns), text (what is
    left), n_lines, n_removed.

    A null text stays null with one line and none removed; an empty one is one
    line.  Null ids come first in order.  Rows with an equal id go by a hash of
    id and text; rows equal in both stand at one place and keep the same lines.
    An empty table gives an empty result.  Other columns are in ``row`` only.
    """
    if near_words < max(2, min_words):
        raise ValueError("near_words is 2 or more and not below min_words")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    place = F.struct("doc_id", "k", "number")
    lines = d.mapInArrow(tidy(_lines_of(min_words, near_words)), "line long, doc_id long, k long, number int, p1 long, s1 long, p2 long, s2 long")
    with small_batches(spark, TEXT_ROWS):
        distinct = written(lines.groupBy("line").agg(F.min(place).alias("first"), *[F.max(c).alias(c) for c in _SIDES]), "lines")
    halves = distinct.select("line", "first", F.posexplode(F.array(*_SIDES)).alias("side", "half")).where("half is not null")
    shared = written(_of_many(halves, "half"), "shared")
    near = halves.join(bounded_broadcast(shared), "half", "left_semi").groupBy("line", "first").agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"))
    near = written(near, "near")
    discard(spark, shared)
    gone = None
    if near.limit(1).count():
        wanted = near.groupBy("first.doc_id", "first.k").agg(F.collect_list(F.struct("first.number", "sides")).alias("numbers"))
        wanted = written(wanted.select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "numbers"), "wanted")
        own = d.join(bounded_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key"))).select("text", "numbers")
        with small_batches(spark, TEXT_ROWS):
            words = written(own.mapInArrow(tidy(_words_of), "line long, sides int, words binary").dropDuplicates(["line"]), "words")
            variants = written(words.mapInArrow(tidy(_variants_of), "variant long, place int, line long"), "variants")
        # Most variants are of one line alone.
        several = written(_of_many(variants, "variant"), "several")
        meeting = variants.join(bounded_broadcast(several), "variant", "left_semi").join(bounded_broadcast(near.select("line", "first")), "line")
        meeting = written(meeting, "meeting")
        entry = F.struct("first", "line")
        best = meeting.groupBy("variant", "place").agg(F.min(entry).alias("best"))
        whole = best.where("place = -1").select("variant", F.col("best").alias("whole"))
        cut = best.where("place >= 0").groupBy("variant").agg(F.min("best").alias("cut"))
        met = (
            meeting.join(best, ["variant", "place"]).join(whole, "variant", "left").join(cut, "variant", "left")
            # The whole line meets deletions of others; a deletion meets whole lines and its like.
            .select("line", "first", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("best", "whole")).alias("by"))
            .where("by is not null and by.first < first").groupBy("line").agg(F.min("by.line").alias("by"))
        )
        met = written(met, "met")
        pairs = met.join(words, "line").join(words.select(F.col("line").alias("by"), F.col("words").alias("others")), "by")
        gone = written(pairs.select("line", "words", "others").mapInArrow(tidy(_verified), "line long"), "gone")
        for x in (wanted, variants, several, meeting, met, words):
            discard(spark, x)
    stay = distinct if gone is None else distinct.join(gone, "line", "left_anti")
    kept = stay.groupBy("first.doc_id", "first.k").agg(F.collect_list("first.number").alias("kept"))
    kept = written(kept.select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "kept"), "kept")
    discard(spark, near)
    discard(spark, distinct)
    # The columns go through the join one by one, so that it carries each once and only those that are asked for.
    names = docs.columns
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"))
    text = F.col(f"c{names.index(text_col)}")
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left")
    out = joined.select(*[f"c{i}" for i in range(len(names))], _rebuilt(min_words)(text, "kept").alias("new"))
    row = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    return out.select(row.alias("row"), F.when(F.col("new.n_removed") > 0, F.col("new.text")).otherwise(text).alias("text"), "new.n_lines", "new.n_removed")


def _of_many(df: DataFrame, name: str) -> DataFrame:
    """The values of a column that several lines have."""
    return df.groupBy(name).agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select(name)
