"""Token ids in binary files: an adaptive context-mixing range coder.

A file is a row of frames; a frame holds whole documents in ascending id order
as blocks of ``BLOCK_TOKENS`` ids.  Each block starts with a fresh model and
has a checksum of its ids, so it can be decoded alone, by its frame's head.
Blocks of a frame are coded side by side, one numpy lane each.

Per id the model mixes three predictions: the id that came last after the same
two ids (order 2), that after the same id (order 1), and all ids by how often
the frame has them (order 0), which its head says.  The weights of the mixture
are learned: for each pair of confidences of the two contexts, the share of ids
that each prediction has got right, of late more than before.  One number per id
goes to a carrying range coder with 64-bit range and 32-bit output.

Frame, little-endian: magic ``TKF3``, u32 documents, u32 blocks, u64 ids, u32
bits of an id, u32 bits of a sum of frequencies, u32 distinct ids, u32 bytes of
the table, then the table (deflated: u32 steps from one distinct id to the next,
u32 frequencies), i64 document ids, u8 null marks, u32 ids per document, u32
ids, bytes and crc32 per block, the blocks' bytes, and a line feed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, fresh_path, written
from .tokens import encoder, tokenizer_path
from .workers import new_stage

BLOCK_TOKENS, LANES, END_ID = 4096, 2304, 2
#: A frame of full blocks has less than 30 MB.
FRAMES_PER_FILE = 32
_U = np.uint64
_M, _TOP = np.uint32((1 << 24) - 1), _U(1 << 32)
#: Slots of the order-1 and order-2 tables of a lane, in bits.
_B1, _B2 = 9, 10
#: A slot has an id and, for order 1 and order 2, a confidence from 0 to 3 above.
_ONE, _THREE = np.array([[1 << 24], [1 << 26]], np.uint32), np.array([[3 << 24], [3 << 26]], np.uint32)
#: Weights are two 16-bit bounds in one number: order 2 has what is below the
#: lower, order 0 what is from the upper on.  Both lose a 32nd with each id, and
#: gain by what was right; order 1 keeps a gap, and order 0 some 480 of 65,536.
_KEEP, _S5, _S16, _S24 = np.uint32(0x07FF07FF), np.uint32(5), np.uint32(16), np.uint32(24)
_GAIN = np.array([2032 << 16 | 2030, 2032 << 16 | 1, 3 << 16 | 1], np.uint32)
_LOW16, _W16, _W32 = np.uint32(0xFFFF), _U(16), _U(32)
_K, _PAIR = _U(0x9E3779B97F4A7C15), _U(3)
#: Steps whose slots are found at once when ids are known.
_AHEAD = 32


def _first_weights() -> np.ndarray:
    """Of each pair of confidences, order 2's being the higher."""
    upper = lambda one: (1500, 12000, 24000, 36000)[one]
    lower = [(1000, 16000, 32000, 48000)[two] for two in range(4) for _ in range(4)]
    return np.array([low | low + (65000 - low) * upper(k & 3) // 65000 << 16 for k, low in enumerate(lower)], np.uint32)


class _Lanes:
    """The models of ``n`` blocks side by side.

    Order 1 and order 2 predict the id that came last after the same id and the
    same two, with a confidence from 0 to 3, in one table of two rows of slots.
    """

    def __init__(self, n: int):
        lanes = np.arange(n)
        self.first = np.stack([lanes << _B1, (n << _B1) + (lanes << _B2)])
        self.slots = np.full(n * ((1 << _B1) + (1 << _B2)), _M)
        self.at, self.weights = lanes << 4, np.tile(_first_weights(), n)

    def slots_of(self, before: np.ndarray, last: np.ndarray, a: int) -> np.ndarray:
        """Where to look after ids of the keys ``before`` and ``last``."""
        out = np.empty((*last.shape[:-1], 2, a), _U)
        np.right_shift(last, _U(64 - _B1), out=out[..., 0, :])
        np.right_shift(last + (before >> _PAIR), _U(64 - _B2), out=out[..., 1, :])
        out = out.view(np.int64)
        out += self.first[:, :a]
        return out

    def look(self, i: np.ndarray, a: int) -> None:
        """What is predicted by the slots ``i``, and the weights."""
        self.i, self.v = i, self.slots.take(i)
        self.guess = self.v & _M
        self.iw = self.at[:a] + ((self.v[0] | self.v[1]) >> _S24)
        self.w = self.weights.take(self.iw)

    def learn(self, x: np.ndarray, hit: np.ndarray, outcome: np.ndarray) -> None:
        """Learns that ``x`` came; ``outcome``: 0 for order 2, 1 and 2 for orders 1 and 0."""
        w = self.w - (self.w >> _S5 & _KEEP)
        w += _GAIN.take(outcome)
        self.weights[self.iw] = w
        self.slots[self.i] = np.where(hit, np.minimum(self.v + _ONE, x | _THREE), x)


class Frequencies:
    """Order 0: distinct ids in order, with frequencies of a sum of ``1 << bits``.
    Without ids, all of ``bits`` bits are equally likely."""

    def __init__(self, bits: int, ids: np.ndarray | None = None, frequencies: np.ndarray | None = None):
        self.bits, self.ids, self.frequencies = bits, ids, frequencies
        if ids is not None:
            self.starts = np.cumsum(frequencies, dtype=_U) - frequencies.astype(_U)

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        n = int(ids.max(initial=0)) + 1
        if n <= 1 << 20:
            counts = sum((np.bincount(ids[i : i + (1 << 20)], minlength=n) for i in range(0, len(ids), 1 << 20)), np.zeros(n, np.int64))
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(ids, return_counts=True)
        bits = min(24, max(16, (len(found) * 4).bit_length()))
        out = 1 + counts * ((1 << bits) - len(found)) // max(1, len(ids))
        if len(found):
            out[out.argmax()] += (1 << bits) - out.sum()
        return cls(bits, found.astype(np.uint32), out.astype(np.uint32))

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and frequencies by id."""
        n = int(self.ids.max(initial=0)) + 1
        start, size = np.zeros(n, _U), np.ones(n, _U)
        start[self.ids], size[self.ids] = self.starts, self.frequencies
        return start, size

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([np.diff(self.ids, prepend=np.uint32(0)), self.frequencies]).astype("<u4").tobytes(), 1)

    @classmethod
    def unpacked(cls, bits: int, n: int, content: bytes) -> Frequencies:
        try:
            steps = np.frombuffer(zlib.decompress(content), "<u4")
        except zlib.error:
            steps = np.zeros(1, np.uint32)
        if len(steps) != 2 * n or n and int(steps[n:].sum(dtype=np.int64)) != 1 << bits:
            raise ValueError("the frame's table is damaged")
        return cls(bits, np.cumsum(steps[:n], dtype=np.uint32), steps[n:])


def id_bits(ids) -> int:
    most = int(max((int(b.max(initial=0)) for b in ids), default=0))
    if most >= int(_M):
        raise ValueError("ids are below 2 ** 24 - 1")
    return max(16, most.bit_length())


def _spans(lengths: np.ndarray):
    """(from, to, lanes) for runs of steps with as many lanes; lengths descend."""
    t = 0
    for end in np.unique(lengths[lengths > 0]).tolist():
        yield t, end, int(np.searchsorted(-lengths, -t, "left"))
        t = end


def encode_blocks(blocks: list[np.ndarray], bits: int, order0: Frequencies | None = None) -> list[bytes]:
    """The bytes of each block; blocks are in descending order of length."""
    n, m = len(blocks), _Lanes(len(blocks))
    lengths = np.array([len(b) for b in blocks], np.int64)
    most = int(lengths.max(initial=0))
    ids = np.zeros((most + 2, n), np.uint32)  # two come before the first
    for k, b in enumerate(blocks):
        ids[2 : len(b) + 2, k] = b
    order0 = order0 or Frequencies(bits)
    start_of, size_of = (None, None) if order0.ids is None else order0.by_id()
    width = 4 + most * (order0.bits + 10) // 32
    out, low, size = np.zeros(n * width, np.uint32), np.zeros(n, _U), np.arange(n) * width
    ranges, shift = np.full(n, 0xFFFFFFFFFFFFFFFF, _U), _U(order0.bits)

    def carry(lanes):
        at = size[lanes] - 1
        while len(at):
            out[at] += np.uint32(1)
            at = at[out[at] == 0] - 1

    for begin, end, a in _spans(lengths):
        lo, rg = low[:a], ranges[:a]
        for t in range(begin, end):
            k = (t - begin) % _AHEAD
            if k == 0:
                part = ids[t : min(t + _AHEAD, end) + 2, :a]
                keys = part[:-1] * _K
                slots = m.slots_of(keys[:-1], keys[1:], a)
                part = np.ascontiguousarray(part[2:])
                starts, sizes = (part.astype(_U), np.ones(part.shape, _U)) if start_of is None else (start_of.take(part), size_of.take(part))
            x = part[k]
            m.look(slots[k], a)
            hit = m.guess == x
            one, two = hit
            lower, upper = m.w & _LOW16, m.w >> _S16
            not_two = ~two
            rest = not_two & ~one
            at = np.where(rest, upper, np.where(two, 0, lower))
            till = np.where(rest, np.uint32(1 << 16), np.where(two, lower, upper))
            m.learn(x, hit, not_two.view(np.int8) + rest.view(np.int8))
            r = rg >> _W16
            add = r * at
            r *= till - at
            # Order 0 then says which id.
            fine = r >> shift
            add += fine * (starts[k] * rest)
            fine *= sizes[k]
            np.copyto(r, fine, where=rest)
            lo += add
            over = lo < add
            if over.any():
                carry(np.flatnonzero(over))
            small = np.flatnonzero(r < _TOP)
            y, z = lo.take(small), size.take(small)
            out[z] = y >> _W32
            size[small] = z + 1
            lo[small] = y << _W32
            r[small] <<= _W32
            rg[:] = r
    for _ in range(2):
        out[size] = low >> _W32
        size += 1
        low = low << _W32
    return [out[k * width : size[k]].astype("<u4").tobytes() for k in range(n)]


def decode_blocks(parts: list[bytes], lengths: np.ndarray, bits: int, order0: Frequencies | None = None) -> list[np.ndarray]:
    n, m = len(parts), _Lanes(len(parts))
    width = max(map(len, parts), default=0) // 4 + 2
    data = np.zeros((n, width), np.uint32)
    for k, b in enumerate(parts):
        data[k, : len(b) // 4] = np.frombuffer(b, "<u4")
    codes = data[:, 0].astype(_U) << _W32 | data[:, 1]
    data, places = data.ravel(), np.arange(n) * width + 2
    ids = np.zeros((int(lengths.max(initial=0)) + 2, n), np.uint32)
    order0 = order0 or Frequencies(bits)
    even, shift, most = order0.ids is None, _U(order0.bits), _U((1 << order0.bits) - 1)
    if not even:
        rank_of = np.repeat(np.arange(len(order0.ids), dtype=np.int32), order0.frequencies)
        starts, sizes = order0.starts, order0.frequencies.astype(_U)
    ranges, key = np.full(n, 0xFFFFFFFFFFFFFFFF, _U), np.zeros(n, _U)
    before = key
    for begin, end, a in _spans(lengths):
        code, rg, pos, before, key = codes[:a], ranges[:a], places[:a], before[:a], key[:a]
        for t in range(begin, end):
            m.look(m.slots_of(before, key, a), a)
            r = rg >> _W16
            lower, upper = r * (m.w & _LOW16), r * (m.w >> _S16)
            not_two, rest = code >= lower, code >= upper
            at = np.where(rest, upper, lower * not_two)
            c = code - at
            r = np.where(rest, r << _W16, np.where(not_two, upper, lower))
            r -= at
            fine = r >> shift
            u = c // fine
            np.minimum(u, most, out=u)
            if even:
                x0, fine_at = u.astype(np.uint32), fine * u
            else:
                rank = rank_of.take(u.view(np.int64))
                x0, fine_at = order0.ids.take(rank), fine * starts.take(rank)
                fine *= sizes.take(rank)
            c -= fine_at * rest
            np.copyto(r, fine, where=rest)
            x = np.where(rest, x0, np.where(not_two, m.guess[0], m.guess[1]))
            m.learn(x, m.guess == x, not_two.view(np.int8) + rest.view(np.int8))
            small = np.flatnonzero(r < _TOP)
            z = pos.take(small)
            c[small] = c.take(small) << _W32 | data.take(z)
            pos[small] = z + 1
            r[small] <<= _W32
            code[:], rg[:], ids[t + 2, :a] = c, r, x
            before, key = key, x * _K
    return [ids[2 : lengths[k] + 2, k].astype("<u4") for k in range(n)]


def encode_frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame without its final line feed."""
    blocks = [ids[i : i + BLOCK_TOKENS] for i in range(0, len(ids), BLOCK_TOKENS)]
    bits = id_bits(blocks)
    order0 = Frequencies.of(ids)
    table = order0.packed()
    parts = encode_blocks(blocks, bits, order0)
    crcs = [zlib.crc32(np.ascontiguousarray(b, "<u4").tobytes()) for b in blocks]
    return b"".join([
        b"TKF3", struct.pack("<IIQIIII", len(doc_ids), len(blocks), len(ids), bits, order0.bits, len(order0.ids), len(table)), table,
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(counts, "<u4").tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes(),
        np.array([len(p) for p in parts], "<u4").tobytes(), np.array(crcs, "<u4").tobytes(), *parts,
    ])


def decode_frames(content: bytes):
    """(document ids, ids per document, all ids) of each frame; an error if a
    checksum differs."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != b"TKF3":
            raise ValueError(f"no frame at byte {at}")
        docs, blocks, total, bits, sum_bits, distinct, size = struct.unpack_from("<IIQIIII", content, at + 4)
        at += 36 + size
        order0 = Frequencies.unpacked(sum_bits, distinct, content[at - size : at])
        fields = []
        for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("<u4", blocks), ("<u4", blocks)):
            fields.append(np.frombuffer(content, kind, k, at))
            at += fields[-1].nbytes
        doc_ids, null, counts, lengths, sizes, crcs = fields
        ends = at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        got = decode_blocks([content[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], lengths.astype(np.int64), bits, order0)
        for k, b in enumerate(got):
            if zlib.crc32(b.tobytes()) != crcs[k]:
                raise ValueError(f"block {k} of the frame is damaged")
        ids = np.concatenate(got) if got else np.zeros(0, "<u4")
        if len(ids) != total or content[ends[-1] : ends[-1] + 1] != b"\n":
            raise ValueError("the frame's end is damaged")
        yield [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], counts.astype(np.int64), ids
        at = int(ends[-1]) + 1


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Writes the ids of every text, each document closed by ``end_id``, to
    files under ``path``, in ascending document id order over the files' names.

    Null ids come first; null and empty texts have the end id alone; rows that
    repeat an id stand next to each other; an empty table writes no frame;
    other columns are ignored.  Spark's own committer writes the files, so a
    lost executor leaves no half of one.
    """
    model = tokenizer or tokenizer_path("byte_bpe_50k.json")
    most = BLOCK_TOKENS * LANES

    def run(batches):
        encode = encoder(model).encode
        doc_ids: list = []
        counts: list = []
        ids: list = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for i, j, got, n in encode(batch.column(1)):
                ids.append(np.insert(got, np.cumsum(n), end_id))
                doc_ids += own[i:j]
                counts.append(n + 1)
                held += len(ids[-1])
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_frame(doc_ids, np.concatenate(counts), np.concatenate(ids))], pa.binary())], names=["frame"])
                    doc_ids, counts, ids, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode_frame(doc_ids, np.concatenate(counts), np.concatenate(ids))], pa.binary())], names=["frame"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # The text writer puts out a string's bytes as they are and a separator
    # after each, here the line feed that ends a frame.
    frames = ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # Files are read whole, so they stay well below 2 GiB.
    frames.write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: doc_id, start (ids before it), n_tokens,
    ids_crc32, and on demand ids (unsigned 32-bit little-endian)."""
    def run(batches):
        new_stage()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for doc_ids, counts, ids in decode_frames(content.as_py()):
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    view = memoryview(ids.tobytes())
                    own = [view[4 * i : 4 * j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                    columns = [
                        pa.array([file] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(before + ends[:-1]),
                        pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ] + [pa.array([x.tobytes() for x in own], pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "before", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        (F.regexp_extract("path", r"part-(\d+)", 1).cast("long") * (1 << 20) + F.regexp_extract("path", r"-c(\d+)\.", 1).cast("long")).alias("file"), "content")
    rows = written(files.mapInArrow(
        run, "file long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids), "token-rows")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row per file, so the window over all of them is small.
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("file", earlier.alias("base"))
    return rows.join(bounded_broadcast(bases), "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_store(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a fresh folder of the shared one and reads it back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    out = read_tokens(spark, path)
    discard(spark, path)
    return out
