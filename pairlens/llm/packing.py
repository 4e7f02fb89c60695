"""Packing by power-of-two decomposition.

A document of n tokens is cut into ``n // max_length`` pieces of ``max_length``
and then pieces by the binary digits of the rest, longest first.  Each piece
has a power of two as its length and is a sequence by itself, so no sequence
crosses documents and none is padded.  Sequences of equal length form a bucket:
the sequence id has the bucket in its high bits, so sorting or filtering by it
takes the buckets apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, tokenizer_path

MAX_LENGTH, END_ID = 2048, 1
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def decompose(n: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``n`` tokens: each piece's document, start and length."""
    full, rest = n // max_length, n % max_length
    doc = [np.repeat(np.arange(len(n)), full)]
    rank = np.arange(len(doc[0])) - np.repeat(np.cumsum(full) - full, full)
    start, length = [rank * max_length], [np.full(len(rank), max_length)]
    for bit in range(max_length.bit_length() - 2, -1, -1):
        has = np.flatnonzero(rest >> bit & 1)
        doc.append(has)
        start.append(n[has] // max_length * max_length + (rest[has] >> bit + 1 << bit + 1))
        length.append(np.full(len(has), 1 << bit))
    doc, start, length = map(np.concatenate, (doc, start, length))
    order = np.lexsort((start, doc))
    return doc[order], start[order].astype(np.int64), length[order].astype(np.int64)


def pack(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    max_length: int = MAX_LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset (0, as each piece is a sequence), ids (unsigned 32-bit
    little-endian).

    ``max_length`` is a power of two.  A null or empty text has the end id
    alone.  Rows that repeat an id, and null ids, are packed each by itself; an
    empty table gives no pieces; other columns are ignored.  Nothing is
    shuffled: sequence ids hold bucket, partition and rank within both.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length is a power of two")
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(path, drop_space=True).encode, TaskContext.get().partitionId()
        rank = np.zeros(max_length.bit_length(), np.int64)
        for batch in batches:
            for i, j, ids, counts in encode(batch.column(1)):
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                n = counts + 1
                doc, start, length = decompose(n, max_length)
                bucket = np.log2(length).astype(np.int64)
                seq = np.empty(len(doc), np.int64)
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    seq[at] = (int(b) << 56) + (part << 32) + rank[b] + np.arange(len(at))
                    rank[b] += len(at)
                # Pieces of a document follow each other, and so do documents.
                ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64)
                blob = pa.Array.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.array(n[doc]), pa.array(seq), pa.array(np.zeros(len(doc), np.int64)), blob.cast(pa.binary()),
                ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
