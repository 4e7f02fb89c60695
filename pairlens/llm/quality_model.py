"""A quality classifier: histogram gradient-boosted trees over text statistics.

Trees are complete binary trees of fixed depth, kept as flat arrays of split
feature, threshold bin and leaf value, so that numpy sends all rows down all
levels at once.  Training happens on the driver on a bounded sample of labelled
rows; scoring is a pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast
from .texthash import Spans, join_texts, shingles, word_spans
from .tokens import text_slices

#: Labelled rows to train on, about, by the hash of their id.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2 = 32, 4, 60, 0.2, 1.0
FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "symbols_per_word", "bars_per_word", "marks_per_word",
    "stops_per_word", "commas_per_word", "upper_share", "digit_share", "beyond_ascii_share", "space_share", "words_per_line",
    "equal_line_share", "distinct_word_share", "distinct_triple_share", "most_frequent_word_share",
)
_CLASSES = {
    "symbols": b"#*$%&|<>", "bars": b"|", "marks": b"!?", "stops": b".", "commas": b",",
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "beyond": bytes(range(128, 256)), "space": b" \t\n\x0b\x0c\r", "lines": b"\n",
}
_WEIGHTS = np.zeros((len(_CLASSES), 256), np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _WEIGHTS[_k, list(_v)] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` for each whole text; null and empty texts are zeros."""
    data, begins = join_texts(texts)
    start, end = word_spans(data)
    hashes = Spans(data, lower=True).hash(start, end)
    at = np.searchsorted(start, begins)
    breaks = np.flatnonzero(data == 10)
    lines = Spans(data).hash(np.concatenate([[0], breaks[:-1] + 1]), breaks)
    filled = np.diff(np.concatenate([[0], breaks])) > 1
    line_at = np.searchsorted(breaks, begins)
    longest = end - start
    out = np.zeros((len(texts), len(FEATURES)))
    for r in range(len(texts)):
        i, j, x, y = begins[r], begins[r + 1] - 1, at[r], at[r + 1]
        if x == y:
            continue
        n, size = y - x, j - i
        c = dict(zip(_CLASSES, _WEIGHTS @ np.bincount(data[i:j], minlength=256), strict=True))
        own = hashes[x:y]
        _, times = np.unique(own, return_counts=True)
        triples = shingles(own, 3)
        rows = lines[line_at[r] : line_at[r + 1]][filled[line_at[r] : line_at[r + 1]]]
        out[r] = (
            np.log1p(size), np.log1p(n), longest[x:y].mean(), longest[x:y].max(), c["symbols"] / n, c["bars"] / n, c["marks"] / n,
            c["stops"] / n, c["commas"] / n, c["upper"] / size, c["digit"] / size, c["beyond"] / size, c["space"] / size, n / (c["lines"] + 1),
            1 - len(np.unique(rows)) / max(1, len(rows)), len(times) / n, len(np.unique(triples)) / max(1, len(triples)), times.max() / n,
        )
    return out


@dataclass
class Model:
    """``edges`` [feature, bin], ``feature`` and ``bin`` [tree, inner node],
    ``leaf`` [tree, leaf], ``base`` the starting log-odds."""

    edges: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > t[node])
            total += leaf[node - (1 << depth) + 1]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Second-order boosting on the logistic loss; equal gains go to the first
    feature and bin.  Without rows, or with one label alone, a constant."""
    n, m = len(x), x.shape[1]
    rate = (y.sum() + 1) / (n + 2) if n else 0.5
    edges = np.array([np.quantile(x[:, k], np.arange(1, BINS) / BINS) if n else np.zeros(BINS - 1) for k in range(m)])
    model = Model(edges, np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, 1 << depth)), float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max():
        return model
    b = model.binned(x)
    total = np.full(n, model.base)
    kept: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, bins = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            gain = np.zeros((m, width, BINS))
            for k in range(m):
                cell = (node - first) * BINS + b[:, k]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain[k] = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            flat = gain.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(1)
            good = flat[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(good, best // BINS, 0)
            bins[first : first + width] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > bins[node])
        own = node - (1 << depth) + 1
        leaf = -RATE * np.bincount(own, g, 1 << depth) / (np.bincount(own, h, 1 << depth) + L2)
        total += leaf[own]
        kept.append((feature, bins, leaf))
    model.feature, model.bin, model.leaf = (np.array(c) for c in zip(*kept, strict=True))
    return model


def _features_of(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        x = np.concatenate([features(texts[i:j]) for i, j in text_slices(texts)]) if texts else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE_ROWS,
) -> Model:
    """The model from about ``sample`` labelled rows, by the hash of their id.

    Rows without a label, an id or a partner don't train.  Labels that repeat
    count once; an id with both labels trains with each; of documents that
    share an id the least text trains.  Without rows the score is 0.5."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").distinct()
    n = own.count()
    chosen = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(min(1.0, sample / max(n, 1)) * 1_000_003) + 1))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    one = d.join(bounded_broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = one.select("label", "text").mapInArrow(_features_of, "label int, x array<double>")
    got = sorted((r["label"], tuple(r["x"])) for r in rows.collect())
    return fit_trees(np.array([r[1] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[0] for r in got], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 likelier).

    Null and empty texts are scored by their all-zero statistics; very long ones
    are read whole; repeated rows each get the same score; an empty table gives
    an empty result; a null id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [shared.value.score(features(texts[i:j])) for i, j in text_slices(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
