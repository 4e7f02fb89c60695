"""Alignment of two tokenizers' ids over the same bytes.

Tokens of both are nodes of a graph, and an edge joins two that share a byte.
Union-find gives its components, which are the minimal groups of tokens that
cover the same bytes.  Within a group the edges are the links.

How many documents hold a pair of ids linked is counted over the whole corpus:
a chunk of documents sends each of its distinct pairs once, with the number of
its documents, and gets back their counts once, so the shuffles have rows for
chunks and distinct pairs, not for links.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .tokens import CACHE_ENTRIES, Encoder, Remembered, byte_alphabet, text_slices, tokenizer_path
from .workers import per_stage

#: Bytes of texts of a chunk, and of those whose graphs are made at once; a text is never cut.
CHUNK_BYTES, SLICE_BYTES = 1 << 23, 1 << 20
_SPACE = "▁"
_PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def _blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries' bytes in a row, each one's start and length."""
    length = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


class BytePieces(Encoder):
    """A byte-level vocabulary; special tokens within texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = self.tok.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            entries[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.entries = _blob(entries)

    def _ids_of_new(self, new: list[str]) -> list[tuple[int, ...]]:
        odd = [k for k, x in enumerate(new) if "<|" in x]
        if not odd:
            return super()._ids_of_new(new)
        own = {k: tuple(x.ids) for k, x in zip(odd, self.plain.encode_batch_fast([new[k] for k in odd], add_special_tokens=False), strict=True)}
        rest = iter(super()._ids_of_new([x for k, x in enumerate(new) if k not in own]))
        return [own[k] if k in own else next(rest) for k in range(len(new))]


class SpacePieces:
    """A sentencepiece vocabulary in which a space only begins an entry, so that
    a text may be cut before each run of spaces, and at line feeds, which are
    bytes of their own.  Such cuts are checked against the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        if any(_SPACE in x.lstrip(_SPACE) or ("\n" in x) for x in names):
            raise ValueError("entries of this vocabulary go across words")
        self.entries = _blob([
            bytes([int(x[3:5], 16)]) if self.sp.is_byte(k) else b"" if self.sp.is_control(k) or self.sp.is_unknown(k) else x.replace(_SPACE, " ").encode()
            for k, x in enumerate(names)])
        self.lone = self.sp.piece_to_id(_SPACE)
        self.known = Remembered(CACHE_ENTRIES)

    def _ids_of_new(self, new: list[str]) -> list[tuple[int, ...]]:
        made = self.sp.encode([x[1:] if x[:1] == " " else x for x in new], num_threads=1) if new else []
        return [(self.lone,) if x in ("", " ") else tuple(ids[1:]) if x[0] == "\n" else tuple(ids) for x, ids in zip(new, made, strict=True)]

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts that aren't empty, and where each text's begin."""
        odd = pc.match_substring_regex(texts, "^ |  |\x1f")
        plain = pc.if_else(odd, "x", texts)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\x1f "), "\n", "\x1f\n"), "\x1f")
        pieces, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        lists, before, n = [], 0, np.diff(at)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = _PARTS.findall(" " + texts[k].as_py())
            lists += [pieces.slice(before, at[k] - before), pa.array(own, pieces.type)]
            n[k], before = len(own), at[k + 1]
        if not lists:
            return pieces, at
        return pa.concat_arrays([*lists, pieces.slice(before)]), np.concatenate([[0], np.cumsum(n)])

    _rows = Encoder._rows


class Numbered:
    """Texts of a chunk as numbers of their distinct pieces; ids by slices."""

    def __init__(self, encoder, texts: pa.Array):
        pieces, self.at = encoder._pieces(texts)
        numbered = pieces.dictionary_encode()
        self.index = numbered.indices.to_numpy()
        self.flat, self.start, self.length = encoder._rows(numbered.dictionary)

    def ids(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts ``i`` to ``j`` in a row, and where each text's begin."""
        which = self.index[self.at[i] : self.at[j]]
        n = self.length[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.start[which] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int64), ends[self.at[i : j + 1] - self.at[i]]


def joined_bytes(ids: np.ndarray, entries) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes in a row, and where each token ends."""
    data, start, length = entries
    n = length[ids]
    ends = np.cumsum(n)
    return data[np.repeat(start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over the edges (a, b) of ``n`` nodes: each node's least one
    that edges reach.  Roots are hooked on lesser ones, then paths are halved."""
    top = np.arange(n)
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            far = top[top]
            if np.array_equal(far, top):
                break
            top = far
    return top


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens that share a byte: one for each stretch between
    neighbouring ends of either, in order.  Both cover the same bytes."""
    if all((np.diff(ends, prepend=0) > 0).all() for ends in (ends_a, ends_b)):
        # Marks at the bytes where tokens end: those before a stretch number its token.
        size = int(ends_a[-1]) if len(ends_a) else 0
        marks = np.zeros((2, size), bool)
        marks[0, ends_a - 1] = marks[1, ends_b - 1] = True
        at = np.flatnonzero(marks[0] | marks[1])
        x, y = marks[0, at], marks[1, at]
        return np.cumsum(x) - x, np.cumsum(y) - y
    ends = np.union1d(ends_a, ends_b)  # tokens without a byte have no stretch
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _digits(most: int) -> np.ndarray:
    """Decimal digits of all numbers below ``most``, each with zero bytes before
    and one after them."""
    width = len(str(max(0, most - 1)))
    return np.array([str(k).rjust(width, "\0") + "\0" for k in range(most)], f"S{width + 1}").view(np.uint8).reshape(most, width + 1)


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: np.ndarray, digits: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text.  ``group_a`` and ``group_b`` number the
    groups over all texts; ``groups``: where each text's begin."""
    n = len(a) + len(b)
    total = groups[-1]
    na, nb = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
    at_a = np.arange(len(a)) + (np.cumsum(nb) - nb)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(na)[group_b]
    token, mark = np.empty(n, np.int64), np.full(n, 44, np.uint8)  # a comma after each
    token[at_a], token[at_b] = a, b
    last = np.cumsum(na + nb) - 1
    mark[last - nb] = 124  # |
    mark[last] = 59  # ;
    said = digits.take(token, 0)
    said[:, -1] = mark
    raw = said.tobytes()
    border = np.concatenate([[0], last + 1])[groups] * digits.shape[1]
    return [raw[i:j].translate(None, b"\0")[:-1] for i, j in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]


def pairs_of_texts(a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, text) of links, by text and pair, and how many links each
    has.  A pair is ``a << 32 | b``."""
    bits = [int(x.max(initial=0)).bit_length() for x in (text, a, b)]
    if sum(bits) < 64:  # one number each is sorted many times faster
        key = np.sort(text << bits[1] + bits[2] | a << bits[2] | b)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        at = key[new]
        text, pair = at >> bits[1] + bits[2], (at >> bits[2] & (1 << bits[1]) - 1) << 32 | at & (1 << bits[2]) - 1
    else:
        key = a << 32 | b
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        pair, text = key[new], text[new]
    return pair, text, np.diff(np.append(new, len(key)))


def _aligned(texts: pa.Array, one: Numbered, two: Numbered, i: int, j: int, bytes_a, bytes_b, digits, digest: bool):
    """Of texts ``i`` to ``j``: counts of tokens, groups and links, the groups'
    text, and the links' ids with the text of each."""
    a, at_a = one.ids(i, j)
    b, at_b = two.ids(i, j)
    raw_a, ends_a = joined_bytes(a, bytes_a)
    raw_b, ends_b = joined_bytes(b, bytes_b)
    own = texts.slice(i, j - i)
    sizes = pc.binary_length(own).to_numpy().astype(np.int64) + 1
    border = np.concatenate([[0], np.cumsum(sizes)])
    end_of = lambda ends, at: np.concatenate([[0], ends])[at]
    where_a, where_b = end_of(ends_a, at_a), end_of(ends_b, at_b)
    want = np.frombuffer(b"".join(b" " + t.encode() for t in own.to_pylist()), np.uint8)
    good = np.ones(j - i, bool)
    if not (np.array_equal(where_a, border) and np.array_equal(where_b, border) and np.array_equal(raw_a, want) and np.array_equal(raw_b, want)):
        for k in range(j - i):
            good[k] = all(np.array_equal(want[border[k] : border[k + 1]], raw[w[k] : w[k + 1]]) for raw, w in ((raw_a, where_a), (raw_b, where_b)))
        keep_a, keep_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
        a, b = a[keep_a], b[keep_b]
        at_a, at_b = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (at_a, at_b))
        ends_a, ends_b = np.cumsum(bytes_a[2][a]), np.cumsum(bytes_b[2][b])
    if not len(a):
        zero = np.zeros(j - i, np.int64)
        return zero, zero, zero, zero, [""] * (j - i), (a, b, a)
    x, y = links_of(ends_a, ends_b)
    top = components(len(a) + len(b), x, y + len(a))
    first = top == np.arange(len(top))
    number = np.cumsum(first) - 1  # the least token of a group is an A token, so groups are in order
    group_a, group_b = number[top[: len(a)]], number[top[len(a) :]]
    total = int(first.sum())
    groups = np.append(group_a, total)[at_a]
    text_of = np.repeat(np.arange(j - i), np.diff(at_a))[x]
    said = group_texts(a, b, group_a, group_b, groups, digits)
    names = [hashlib.sha256(s).hexdigest() if s and digest else s.decode() for s in said]
    return np.diff(at_a), np.diff(at_b), np.diff(groups), np.bincount(text_of, minlength=j - i), names, (a[x], b[y], text_of)


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, pairs binary, times binary, keys binary, holders binary"


def align(
    docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair is held by as many documents as any of its A id),
    count_sum (over links, the documents that hold the pair) and ``groups``,
    or with ``digest`` their SHA-256, empty where there are no tokens.

    A is a byte-level vocabulary over a space and the text, B a sentencepiece
    one over the text.  A null or empty text, and one whose bytes either
    vocabulary doesn't give back, has no tokens: zeros, and it holds no pair.
    Rows are told apart by themselves: each one that repeats an id or a text
    counts as a document.  Texts are taken whole, however long.  An empty table
    gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    path_a, path_b = byte_bpe or tokenizer_path("byte_bpe_50k.json"), pieces or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        from pyspark import TaskContext

        one = per_stage((path_a, "bytes"), lambda: BytePieces(path_a))
        two = per_stage((path_b, "pieces"), lambda: SpacePieces(path_b))
        digits = per_stage("digits", lambda: _digits(max(len(one.entries[1]), len(two.entries[1]))))
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            whole = pc.fill_null(batch.column(1), "")
            for lo, hi in text_slices(whole, CHUNK_BYTES):
                texts = whole.slice(lo, hi - lo)
                some = pc.not_equal(texts, "")
                rows, texts = np.flatnonzero(some.to_numpy(zero_copy_only=False)), texts.filter(some)
                spaced = pc.binary_join_element_wise("", texts, " ")
                n_a, n_b = Numbered(one, spaced), Numbered(two, texts)
                counts, groups, seen = np.zeros((4, hi - lo), np.int64), [""] * (hi - lo), []
                for i, j in text_slices(texts, SLICE_BYTES):
                    *numbers, names, (a, b, text) = _aligned(texts, n_a, n_b, i, j, one.entries, two.entries, digits, digest)
                    counts[:, rows[i:j]] = numbers
                    for k, s in zip(rows[i:j].tolist(), names, strict=True):
                        groups[k] = s
                    pair, text, times = pairs_of_texts(a, b, text)
                    seen.append((pair, rows[i:j][text], times))
                keys, texts_of, times = (np.concatenate(c) for c in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64),) * 3
                distinct, place, holders = np.unique(keys, return_inverse=True, return_counts=True)
                border = np.searchsorted(texts_of, np.arange(hi - lo + 1))
                pack = lambda x: [x[s:e].astype("<u4").tobytes() for s, e in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]  # noqa: E731, B023
                none = pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), *map(pa.array, counts), pa.array(groups), pa.array(np.full(hi - lo, chunk)),
                    pa.array(pack(place), pa.binary()), pa.array(pack(times), pa.binary()), none, none], names=_names)
                yield pa.RecordBatch.from_arrays([
                    *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.array([chunk]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                    pa.array([distinct.astype("<i8").tobytes()], pa.binary()), pa.array([holders.astype("<i8").tobytes()], pa.binary())], names=_names)
                chunk += 1

    def unpack(batches):
        for b in batches:
            for c, keys, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                k = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c)), pa.array(np.arange(len(k))), pa.array(k), pa.array(np.frombuffer(n, "<i8"))], names=["chunk", "place", "pair", "n"])

    def weigh(rows: pa.Table, weights: pa.Table) -> pa.Table:
        size = weights.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = weights["place"].to_numpy()
        count[at], best[at] = weights["n"].to_numpy(), weights["best"].to_numpy()
        total, n_best = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        for k, (p, t) in enumerate(zip(rows["pairs"].to_pylist(), rows["times"].to_pylist(), strict=True)):
            p, t = np.frombuffer(p, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)
            total[k], n_best[k] = (count[p] * t).sum(), t[best[p]].sum()
        return pa.table([*(rows[c] for c in _names[:5]), pa.array(n_best), pa.array(total), rows["groups"]], names=[*_names[:5], "n_best", "count_sum", "groups"])

    _names = [x.split()[0] for x in _DOCS.split(", ")]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = written(d.mapInArrow(run, _DOCS), "aligned")
    held = written(made.where("keys is not null").select("chunk", "keys", "holders").mapInArrow(unpack, "chunk long, place long, pair long, n long"), "pairs")
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    marked = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    weights = held.select("chunk", "place", "pair").join(marked, "pair").select("chunk", "place", "n", "best")
    rows = made.where("pairs is not null").select(*_names[:6], "chunk", "pairs", "times")
    out = written(rows.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(
        weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"), "weighed")
    for x in (made, held, counts):
        discard(spark, x)
    return out
