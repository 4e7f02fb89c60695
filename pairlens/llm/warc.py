"""WARC archives: writing them, and normalising monolithic gzip files.

``write_monolithic`` writes a record per page, each file one gzip stream.
``normalise`` inflates each such file once, from front to back, and rewrites
every record as a gzip member of its own beside an offset index.
``read_archives`` reads members back.

All files go through Spark's text writer, which puts out a string's bytes as
they are and a separator after each row.  Records end in the four bytes that
separate them in WARC.  A gzip member ends in the high byte of its size, which
is 0 below 16 MiB, and so does an index entry; that byte is the separator.  A
larger record's member is followed by an empty member, which does end in 0.

Index entry, 32 bytes little-endian: i64 offset, i64 length of the member, i64
inflated size, 7 bytes of the SHA-1 of the record's id, and a 0.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, fresh_path, held

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = zlib.compress(b"", 1, 31)
_STEP = 1 << 15


def base32(hex_digest: Column) -> Column:
    """The base32 form of a SHA-1 in hex: every five hex digits are four characters."""
    groups = [F.conv(F.substring(hex_digest, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    alphabet = F.lit(BASE32)
    return F.concat(*[
        F.substring(alphabet, F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for v in groups for k in range(4)
    ])


def write_monolithic(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """A WARC record per row of ``pages`` in files of one gzip stream each.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, those with
    the largest id are responses and the others revisit it; a null id is below
    all others and alone a response.  A null html is an empty payload; a null
    url leaves out its line.  Rows that repeat an id are records each; an empty
    table writes no record; other columns are ignored.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("sha", held(F.sha1(F.col("html").cast("binary"))))
    # Payloads stay where they are: only digests and ids are shuffled, and of
    # those only groups of copies go on.
    groups = (
        p.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1 and top is not null").select("sha", "top")
    )
    q = p.join(bounded_broadcast(groups), "sha", "left")
    revisit = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("top")),
            F.lit("\r\nPayload-Length: "), F.octet_length("html").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.when(revisit, 0).otherwise(F.octet_length("html")) + len(HTTP)).cast("string"),
        F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("html")),
    )
    q.select(head.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option(
        "lineSep", "\r\n\r\n").text(path)


def records(content: bytes):
    """The records of a gzip file of one or more streams, each whole, inflated
    once and held one at a time."""
    buffer, at, stream = bytearray(), 0, zlib.decompressobj(31)
    need = None
    while at < len(content) or buffer:
        if need is None:
            end = buffer.find(b"\r\n\r\n")
            if end >= 0:
                length = next(int(x.split(b":", 1)[1]) for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
        if need is not None and len(buffer) >= need:
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
            continue
        if at >= len(content):
            raise ValueError("the archive ends within a record")
        piece = content[at : at + _STEP]
        buffer += stream.decompress(piece)
        at += len(piece) - len(stream.unused_data)
        if stream.eof:
            stream = zlib.decompressobj(31)
            while at < len(content) and content[at] == 0:
                at += 1


def members(content: bytes):
    """(offset, length, inflated record) of each member of a normalised file."""
    at = 0
    while at < len(content):
        stream, start, out = zlib.decompressobj(31), at, []
        while not stream.eof:
            piece = content[at : at + _STEP]
            if not piece:
                raise ValueError("the archive ends within a member")
            out.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        if record := b"".join(out):
            yield start, at - start, record


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, in lower case, and its block."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, block[: int(fields["content-length"])]


def normalise(spark: SparkSession, source: str, path: str, level: int = 1) -> None:
    """Rewrites the gzip files under ``source`` to ``path/kind=warc``, a member
    per record, with the offset index of each file in ``path/kind=index``; the
    two go by the number in their names.  Files without a record give none."""
    def run(batches):
        seq, offset = 0, 0
        entries = []
        for batch in batches:
            for content in batch.column(0):
                rows: list[bytes] = []
                size = 0
                for record in records(content.as_py()):
                    member = zlib.compress(record, level, 31)
                    own = hashlib.sha1(parse(record)[0].get("warc-record-id", "").encode()).digest()[:7]
                    entries.append(struct.pack("<qqq", offset, len(member), len(record)) + own)
                    if member[-1]:
                        member += _EMPTY_MEMBER
                    rows.append(member[:-1])
                    offset += len(member)
                    size += len(member)
                    if size > 1 << 22:
                        yield _rows("warc", seq, rows)
                        seq, rows, size = seq + len(rows), [], 0
                yield _rows("warc", seq, rows)
                seq += len(rows)
        yield _rows("index", 0, entries)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    out = files.mapInArrow(run, "kind string, seq long, value binary")
    out.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value")).write.partitionBy(
        "kind").option("lineSep", "\0").text(path)


def _rows(kind: str, seq: int, values: list[bytes]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(range(seq, seq + n), pa.int64()), pa.array(values, pa.binary())],
        names=["kind", "seq", "value"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, html (null for revisits).  Fails on a payload that
    doesn't match its digest and on a member that the index doesn't have."""
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file")

    def page(urn: str | None) -> int | None:
        found = (urn or "").rpartition(":")[2].rstrip(">")
        return int(found) if found and found != "null" else None

    def run(batches):
        names = ["file", "at", "size", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held_bytes = [], 0
                for at, size, record in members(content.as_py()):
                    fields, block = parse(record)
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    own = fields["warc-type"] == "response"
                    if own and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"a payload differs from its digest at byte {at} of file {file}")
                    rows.append((
                        file, at, size, page(fields["warc-record-id"]), len(payload) if own else int(fields["payload-length"]), digest,
                        fields["warc-type"], page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload.decode() if own else None))
                    held_bytes += len(payload)
                    if held_bytes > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held_bytes = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def entries(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, *struct.unpack_from("<qq", content.as_py(), i)) for i in range(0, len(content.as_py()), 32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["file", "at", "size"])

    load = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind={kind}").select(number, "content")
    found = load("warc").mapInArrow(
        run, "file long, at long, size long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
    index = load("index").mapInArrow(entries, "file long, at long, size long").withColumn("listed", F.lit(True))
    checked = found.join(index, ["file", "at", "size"], "left")
    known = F.when(F.col("listed"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a member is not in the index")).cast("long"))
    return checked.select("page_id", known.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "html")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to monolithic files of the shared folder, normalises
    them and reads the archives back; an empty table gives an empty result."""
    spark = pages.sparkSession
    whole, path = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc")
    write_monolithic(pages, whole, id_col, url_col, html_col, min_revisit_bytes)
    normalise(spark, whole, path)
    discard(spark, whole)
    try:
        return read_archives(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
