"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as deep as the threshold, by digits of which the most
significant comes first, and only suffixes that share all digits so far go on
to the next pass; suffixes equal to the end of the last are the repeated
windows.

The first digit of the suffix at p is the ``GRAM``-byte string of least hash
within its window, with its distance from p.  Equal windows have it at the same
distance, so this digit parts no equal ones; and as neighbouring suffixes share
theirs, whole runs of suffixes go through a pass as one row.  The following
digits are the bytes that all suffixes of a run have in common (its core), for
runs cut to ``STEPS`` suffixes: 337, then 48, 8 and 1, where the core is the
window itself.  A run whose core nothing else has holds no repeated window; a
run that occurs elsewhere as a whole (its span is equal) holds only such; the
others are cut for the next pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, in_parts, row_key, written
from .texthash import _MIX, HashSpans, Spans, join_texts, mix, words
from .tokens import text_slices

WINDOW, GRAM = 400, 64
STEPS = (48, 8, 1)
#: Passages "of over 50 words", by the passes over words instead of bytes.
PASSAGE_WORDS, PASSAGE_GRAM, PASSAGE_STEPS = 51, 20, (8, 1)
#: Rows of the passes' tables that a part has.
PART_ROWS = 250_000
_ROWS = "core long, wide long, t long, lo int, hi int, a int"


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over each ``w`` values in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    front = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], front[w - 1 : n])


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of starts p whose least hash among ``h[p : p + w]`` (of
    equal ones the last) is at one place: that place, first and last p."""
    m = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    last = np.concatenate([first[1:], [len(m)]]) - 1
    # Where the runs' values stand, by value and place.
    values, own = np.unique(m[first], return_inverse=True)
    where = np.searchsorted(values, h)
    where[where == len(values)] = 0
    hit = np.flatnonzero(values[where] == h)
    keys = np.sort(where[hit] * np.int64(len(h) + w + 1) + hit)
    span = np.int64(len(h) + w + 1)
    hi = np.searchsorted(keys, own * span + last + w - 1, "right")
    several = hi - np.searchsorted(keys, own * span + first) > 1
    if not several.any():
        return keys[hi - 1] % span, first, last
    # Equal hashes within a window: the place moves along the run.
    n = np.where(several, last - first + 1, 1)
    run = np.repeat(np.arange(len(first)), n)
    p = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    upto = np.where(several[run], p, last[run])
    at = keys[np.searchsorted(keys, own[run] * span + upto + w - 1, "right") - 1] % span
    cut = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1])]))
    ends = np.concatenate([cut[1:], [len(run)]]) - 1
    return at[cut], p[cut], np.where(several[run[ends]], p[ends], last[run[ends]])


def _wide(spans: Spans, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, window: int) -> np.ndarray:
    return mix(spans.hash(lo, hi + window) + (a - lo).astype(np.uint64) * _MIX[3] + (hi - lo).astype(np.uint64) * _MIX[4])


def _batch(core, wide, t, lo, hi, a):
    return pa.RecordBatch.from_arrays(
        [pa.array(core.view(np.int64)), pa.array(wide.view(np.int64)), pa.array(t), *[pa.array(x.astype(np.int32)) for x in (lo, hi, a)]],
        names=["core", "wide", "t", "lo", "hi", "a"])


def _sequences(texts: list[str], unit: str) -> tuple[Spans, np.ndarray, np.ndarray]:
    """Hashes of spans of all texts in a row, in bytes or words, and where each
    text begins and ends."""
    if unit == "words":
        hashes, at = words(texts, lower=False)
        return HashSpans(hashes), at[:-1], at[1:]
    data, begins = join_texts(texts)
    return Spans(data), begins[:-1], begins[1:] - 1


def _first_pass(window: int, gram: int, unit: str):
    w = window - gram + 1

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            texts, own = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in text_slices(texts):
                spans, begin, end = _sequences(texts[i:j], unit)
                if len(spans.sums) <= window:
                    continue
                at = np.arange(len(spans.sums) - gram)
                h = spans.hash(at, at + gram)
                out = []
                for r in range(j - i):
                    x, n = int(begin[r]), int(end[r] - begin[r])
                    if n < window or own[i + r] in seen:
                        continue
                    seen.add(own[i + r])  # copies of a text are one to the passes
                    a, lo, hi = anchors(h[x : x + n - gram + 1], w)
                    out.append((h[x + a], _wide(spans, x + lo, x + hi, x + a, window), np.full(len(a), own[i + r], np.int64), lo, hi, a))
                if out:
                    yield _batch(*map(np.concatenate, zip(*out, strict=True)))

    return run


def _next_pass(window: int, gram: int, step: int, unit: str):
    most = window - gram

    def run(batches):
        for b in batches:
            texts, own, runs = b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2)
            for i, j in text_slices(texts):
                spans, begin, _ = _sequences(texts[i:j], unit)
                part = runs.slice(i, j - i)
                n, flat = pc.list_value_length(part).to_numpy(), part.flatten()
                base, t = np.repeat(begin, n), np.repeat(np.array(own[i:j], np.int64), n)
                lo, hi, a = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                # Distances from a, from a - hi to a - lo, cut at multiples of step.
                c0, c1 = (a - hi) // step, (a - lo) // step
                m = c1 - c0 + 1
                k = np.repeat(np.arange(len(a)), m)
                c = c0[k] + np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
                near, far = c * step, np.minimum(c * step + step - 1, most)
                lo2, hi2 = np.maximum(lo[k], a[k] - far), np.minimum(hi[k], a[k] - near)
                core = mix(spans.hash(base[k] + a[k] - near, base[k] + a[k] - far + window) + c.astype(np.uint64) * _MIX[5] + np.array([step], np.uint64) * _MIX[6])
                yield _batch(core, _wide(spans, base[k] + lo2, base[k] + hi2, base[k] + a[k], window), t[k], lo2, hi2, a[k])

    return run


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (t, lo, hi, across) that occur elsewhere whole, and runs (t, lo, hi,
    a) that may in part: one of each span whose core has other spans too."""
    n = rows.count()
    place = F.struct("t", "lo", "hi", "a")
    g = written(in_parts(rows.groupBy("core", "wide").agg(F.min(place).alias("one"), F.max(place).alias("other")), n, PART_ROWS), "spans")
    whole = g.where("one <> other").select("core", "wide", (F.col("one.t") != F.col("other.t")).alias("across"))
    repeated = written(in_parts(rows.join(whole, ["core", "wide"]).select("t", "lo", "hi", "across"), n, PART_ROWS), "repeated")
    mixed = g.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    active = written(in_parts(g.join(mixed, "core", "left_semi").select("one.*"), n, PART_ROWS), "active")
    discard(rows.sparkSession, g)
    return repeated, active


def _cut(batches):
    """What is left of each text without its runs' windows."""
    for b in batches:
        cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, runs, window in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw, spans = (text or "").encode("utf-8", "surrogatepass"), []
            for r in sorted(runs or [], key=lambda r: (r["lo"], r["hi"])):
                lo, end = r["lo"], r["hi"] + window
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([lo, end])
            at, kept = 0, []
            for lo, end in spans:
                kept.append(raw[at:lo])
                at = end
            kept.append(raw[at:])
            left = b"".join(kept)
            for k, v in zip(cols, (len(raw), len(raw) - len(left), len(spans), left), strict=True):
                cols[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *[pa.array(cols[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(cols["kept"], pa.binary()), b.column(4)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "repeats"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k (a key of the row), t (one of the text) and text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"),
        F.xxhash64(F.col(text_col), F.octet_length(text_col)).alias("t"), F.col(text_col).alias("text"))


def _runs(d: DataFrame, window: int, gram: int, steps: tuple[int, ...], unit: str) -> DataFrame:
    """(t, lo, hi, across): runs of starts of windows that other starts equal;
    ``across``: such of other texts are known."""
    spark = d.sparkSession
    least = window if unit == "bytes" else 2 * window - 1
    long_ones = d.where(F.octet_length("text") >= least)
    rows = written(long_ones.select("t", "text").mapInArrow(_first_pass(window, gram, unit), _ROWS), "runs")
    repeated, active = _settle(rows)
    discard(spark, rows)
    found = repeated
    one = long_ones.groupBy("t").agg(F.min(F.struct("doc_id", "k")).alias("r"))
    for step in steps:
        if active.limit(1).count() == 0:
            break
        runs = active.groupBy("t").agg(F.collect_list(F.struct("lo", "hi", "a")).alias("runs"))
        wanted = written(runs.join(one, "t").select("t", F.col("r.doc_id").alias("id"), F.col("r.k").alias("key"), "runs"), "wanted")
        texts = d.drop("t").join(bounded_broadcast(wanted), (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
        rows = written(texts.select("t", "text", "runs").mapInArrow(_next_pass(window, gram, step, unit), _ROWS), "runs")
        discard(spark, active)
        repeated, active = _settle(rows)
        discard(spark, rows)
        discard(spark, wanted)
        found = found.union(repeated)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(k, repeats) for rows with a run of ``n_words`` words or more that a row
    of another text, or another row of the same text, has too: the passes over
    words.  ``k`` is ``common.row_key`` of the id and text.

    Words are runs without white space, compared as they are.  Null texts and
    those of fewer words are left out, as are rows without such a run.
    """
    d = _rows(docs, id_col, text_col).where(F.octet_length("text") >= 2 * n_words - 1)
    found = _runs(d, n_words, gram, PASSAGE_STEPS, "words").where("across").select("t").distinct()
    ids = written(d.select("t", "k"), "ids")
    again = ids.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    copies = d.join(again, "t", "left_semi").where(F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")) >= n_words)
    out = ids.join(found, "t", "left_semi").select("k").union(copies.select("k"))
    return out.distinct().withColumn("repeats", F.lit(True))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    passage_words: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (the remaining bytes) and, with ``passage_words``,
    repeats: whether a run of so many words is in another row, too, be it short
    of the window or not.

    A byte goes if a ``window``-byte string over it also starts elsewhere, in
    the same text or another.  Null and empty texts, and those shorter than the
    window, keep what they have.  Rows that repeat a text, and rows equal in
    all, are copies of each other and go whole if long enough; ids may be null
    or repeat; an empty table gives an empty result; other columns are ignored.
    """
    if not 8 <= gram <= window or window - gram + 1 > 4096:
        raise ValueError("gram is from 8 to the window")
    spark = docs.sparkSession
    d = _rows(docs, id_col, text_col)
    names = written(d.where(F.octet_length("text") >= window).select("doc_id", "k", "t", F.octet_length("text").alias("n")), "texts")
    spans = _runs(d, window, gram, STEPS, "bytes").select("t", "lo", "hi")
    of_text = names.groupBy("t").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    whole = of_text.where("copies > 1").select("t", F.lit(0).alias("lo"), (F.col("n") - window).cast("int").alias("hi"))
    by_text = spans.join(whole.select("t"), "t", "left_anti").union(whole).groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    # By row first, in narrow rows: a text may have very many copies.
    by_row = names.join(by_text, "t").groupBy("k").agg(F.first("runs").alias("runs")).withColumnRenamed("k", "key")
    if passage_words is None:
        by_row = by_row.withColumn("repeats", F.lit(False))
    else:
        again = repeated_passages(docs, id_col, text_col, passage_words, min(PASSAGE_GRAM, passage_words)).withColumnRenamed("k", "key")
        by_row = by_row.join(again, "key", "full")
    joined = d.join(by_row, F.col("k") == F.col("key"), "left").select(
        "doc_id", "text", "runs", F.lit(window).alias("window"), F.coalesce("repeats", F.lit(False)).alias("repeats"))
    out = joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, repeats boolean")
    return out if passage_words else out.drop("repeats")
