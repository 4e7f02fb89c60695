"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer and is fixed; training learns, per
language, a probability for each of its pieces.  A word's likelihood is the sum
over all its segmentations into pieces of the product of their probabilities,
which a forward pass over its positions gives; a text's is the product over its
words.  Training maximises the likelihood by expected piece counts (forward and
backward passes), on a bounded sample of rows with a language.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import byte_alphabet, text_slices, tokenizer_path
from .workers import per_stage, release

#: Training rows per language, about, by the hash of their text.
SAMPLE_PER_LANGUAGE = 400
#: Distinct training words per language at most, the most frequent.
SAMPLE_WORDS = 4000
ROUNDS, SMOOTH = 2, 0.1
CACHE_WORDS = 300_000
UNKNOWN = "und"
#: Runs of letters; a longer run counts as several words, so that no product
#: of probabilities underflows.  No longer piece can occur in one.
LONGEST = 40
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def vocabulary(path: str) -> dict[str, int]:
    """The letter pieces of a tokenizer file's vocabulary, without its marks.
    A worker keeps it until another stage begins."""
    return per_stage(("vocabulary", path), lambda: _read_vocabulary(path))


def _read_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in byte_alphabet().items()}
    pieces = set()
    for x in found:
        x = x.removesuffix("</w>")
        if all(c in byte for c in x):
            try:
                text = bytes(byte[c] for c in x).decode()
            except UnicodeDecodeError:
                continue
            if text and len(text) <= LONGEST and text.isalpha() and text == text.lower():
                pieces.add(text)
    return {p: i for i, p in enumerate(sorted(pieces))}


def lattice(word: str, vocab: dict[str, int], unknown: int) -> list[tuple[int, int, int]]:
    """(from, to, piece) of every piece in ``word``; a character that is no
    piece by itself is the unknown piece."""
    out = []
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - LONGEST), j):
            p = vocab.get(word[i:j])
            if p is not None:
                out.append((i, j, p))
            elif j - i == 1:
                out.append((i, j, unknown))
    return out


def word_scores(words: list[str], probability: np.ndarray, vocab: dict[str, int]) -> np.ndarray:
    """The log-likelihood of each word in each language, all words at once: the
    forward pass goes from position to position over the pieces that end there."""
    unknown, get = len(vocab), vocab.get
    longest = max(map(len, words))
    at: list[list[int]] = [[] for _ in range(longest + 1)]
    start: list[list[int]] = [[] for _ in range(longest + 1)]
    piece: list[list[int]] = [[] for _ in range(longest + 1)]
    for k, w in enumerate(words):
        for j in range(1, len(w) + 1):
            a, b, c = at[j], start[j], piece[j]
            for i in range(max(0, j - LONGEST), j):
                p = get(w[i:j])
                if p is None:
                    if j - i > 1:
                        continue
                    p = unknown
                a.append(k)
                b.append(i)
                c.append(p)
    forward = np.zeros((longest + 1, len(words), probability.shape[1]))
    forward[0] = 1
    for j in range(1, longest + 1):
        k = np.array(at[j])
        each = forward[np.array(start[j]), k] * probability[np.array(piece[j])]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        forward[j, k[first]] = np.add.reduceat(each, first)
    lengths = np.array([len(w) for w in words])
    return np.log(np.maximum(forward[lengths, np.arange(len(words))], 1e-300))


def train(counts: dict[str, dict[str, int]], vocab: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each piece (and, last, of an
    unknown character) in each, from words and their counts per language."""
    langs = sorted(counts)
    table = np.full((len(vocab) + 1, len(langs)), 1.0 / (len(vocab) + 1))
    lattices: dict[str, list] = {}
    for _ in range(rounds):
        new = np.full_like(table, SMOOTH)
        for k, lang in enumerate(langs):
            p = table[:, k].tolist()
            got = np.zeros(len(table)).tolist()
            for word, n in counts[lang].items():
                edges = lattices.setdefault(word, lattice(word, vocab, len(vocab)))
                fore, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
                for i, j, x in edges:
                    fore[j] += fore[i] * p[x]
                for i, j, x in sorted(edges, key=lambda e: -e[1]):
                    back[i] += back[j] * p[x]
                if fore[-1] > 0:
                    for i, j, x in edges:
                        got[x] += n * fore[i] * p[x] * back[j] / fore[-1]
            new[:, k] += got
        table = new / new.sum(0)
    return langs, table


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", tokenizer: str | None = None,
    sample: int = SAMPLE_PER_LANGUAGE,
) -> tuple[list[str], np.ndarray]:
    """The model from rows with a text and a language: of each language about
    ``sample`` distinct texts by their hash, at most twice as many, and of their
    words the most frequent ``SAMPLE_WORDS``.  Copies of a text count once."""
    vocab = vocabulary(tokenizer or tokenizer_path("word_bpe_49k.json"))
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    distinct = rows.select("lang", "h").distinct()
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in chosen.withColumn("rank", rank).where(F.col("rank") <= 2 * sample).collect():
        own = counts[r["lang"]]
        for w in _WORD.findall(r["text"].lower()):
            own[w] = own.get(w, 0) + 1
    counts = {k: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:SAMPLE_WORDS]) for k, v in counts.items() if v}
    return train(counts, vocab)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the language's share of
    the likelihoods, per word as a geometric mean over words).

    A null text, and one without a letter, is ``und`` with score 0; a model
    without languages gives that to all; ties go to the language first in
    order; repeated rows are judged each by itself; an empty table gives an
    empty result; other columns are ignored, or with ``keep_row`` come along in
    a struct ``row``.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    langs, table = model
    spread = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        vocab, probability = vocabulary(path), spread.value
        known: dict[str, int] = {}
        scores = np.zeros((1 << 12, max(1, len(langs))))
        for b in batches:
            texts = (b.column(1).field(text_at) if keep_row else b.column(1)).to_pylist()
            pred, score = [], []
            for i, j in text_slices(texts):
                words: list[str] = []
                counts = np.zeros(j - i + 1, np.int64)
                for k, t in enumerate(texts[i:j]):
                    words += _WORD.findall(t.lower()) if t else []
                    counts[k + 1] = len(words)
                if not langs or not words:
                    pred += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                new = set(words).difference(known)
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = set(words)
                fresh = sorted(new, key=len)
                while len(known) + len(fresh) > len(scores):
                    scores = np.resize(scores, (2 * len(scores), scores.shape[1]))
                for a in range(0, len(fresh), 4000):
                    part = fresh[a : a + 4000]
                    scores[len(known) : len(known) + len(part)] = word_scores(part, probability, vocab)
                    known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
                each = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
                total, n = sums[counts[1:]] - sums[counts[:-1]], np.diff(counts)
                mean = total / np.maximum(n, 1)[:, None]
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = total.argmax(1)
                pred += [langs[x] if m else UNKNOWN for x, m in zip(best, n, strict=True)]
                score += np.where(n > 0, share[np.arange(j - i), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *b.columns[1:][:keep_row]],
                names=["doc_id", "lang_pred", "score", "row"][: 3 + keep_row])
        del known, scores
        release()

    # A text that comes along goes to the workers once, as a field of its row.
    text_at = docs.columns.index(text_col) if keep_row else None
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row") if keep_row else F.col(text_col).alias("text")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), own)
    schema = d.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return d.mapInArrow(run, schema.add(d.schema["row"]) if keep_row else schema)
