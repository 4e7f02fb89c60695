"""A store of samples: large blobs that many utterances lie in, an index of
where, and reads of slices without reading a blob whole."""

from __future__ import annotations

from itertools import groupby
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import running_sum

#: Bytes of a blob, and of the stretch of one that a task sorts its requests in, about.
BLOB_BYTES, STRETCH_BYTES = 128 << 20, 16 << 20
#: Ranges are read as one if what lies between is at most this share of them.
SLACK = 0.15
#: Bytes of slices that a task holds at once, about.
HELD_BYTES = 32 << 20
#: What stands between two utterances: as many bytes as a sample has.
_MARK = "\n\n"


def write_store(df: DataFrame, path: str, order: list[str], data: str = "data", blob_bytes: int = BLOB_BYTES) -> None:
    """Writes the bytes of ``data`` in ``order`` to blobs under ``path/blobs``,
    and the other columns with blob, offset and length (in bytes) to ``path/index``.

    Offsets are a running sum in two levels, so the index is known before a
    blob is written; each blob is one task's and one file's.  Null bytes count
    as empty.  Nothing that exists is written over."""
    d = df.withColumn(data, F.coalesce(data, F.lit(b""))).withColumn("length", F.octet_length(data).cast("long"))
    placed = running_sum(d, F.col("length") + len(_MARK), [], order, "_at")
    dealt = placed.withColumn("blob", F.floor(F.col("_at") / blob_bytes).cast("long"))
    first = dealt.groupBy("blob").agg(F.min("_at").alias("_first"))  # a row per blob
    located = dealt.join(F.broadcast(first), "blob").withColumn("offset", F.col("_at") - F.col("_first")).drop("_at", "_first")
    # The text writer puts out a string's bytes as they are.
    blobs = located.repartition("blob").sortWithinPartitions("blob", "offset").select("blob", F.col(data).cast("string").alias("value"))
    blobs.write.mode("errorifexists").option("lineSep", _MARK).partitionBy("blob").text(f"{path}/blobs")
    located.drop(data).write.mode("errorifexists").parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``file``, the place of each row's blob."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/blobs")
    files = listed.select(F.regexp_extract("path", r"blob=(\d+)/", 1).cast("long").alias("blob"), F.col("path").alias("file"))  # names only, a row per blob
    return spark.read.parquet(f"{path}/index").join(F.broadcast(files), "blob", "left")


def merged(offsets: np.ndarray, ends: np.ndarray, slack: float = SLACK) -> np.ndarray:
    """Where new reads begin among ranges in order of their offsets: a range goes
    with the read before it if what is read then stays within ``slack`` of what
    is asked for, overlaps counted once."""
    starts, asked, begin, end = [], 0, 0, -1
    for k, (a, b) in enumerate(zip(offsets.tolist(), ends.tolist(), strict=True)):
        new = max(0, b - max(a, end))
        if starts and max(b, end) - begin <= (1 + slack) * (asked + new):
            asked, end = asked + new, max(b, end)
        else:
            starts.append(k)
            asked, begin, end = b - a, a, b
    return np.array(starts, np.int64)


def _opened(uri: str):
    """A file that can be sought in, on whatever file system Arrow knows."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_slices(requests: DataFrame, file: str = "file", offset: str = "offset", length: str = "length", name: str = "data", slack: float = SLACK) -> DataFrame:
    """``requests`` with ``name``, the bytes of each one's slice, and ``bytes_read``:
    what was read from the file for it, on the first row of a read.

    Requests are dealt by file and stretch, so many tasks share a large file,
    and sorted; neighbours are read as one.  A slice beyond the end of its file
    has the bytes that there are; a null file, offset or length, or an empty
    slice, reads nothing."""
    schema = requests.schema
    stretch = F.floor(F.col(offset) / STRETCH_BYTES)
    d = requests.withColumn("_stretch", stretch).repartition(F.col(file), F.col("_stretch")).sortWithinPartitions(file, offset).drop("_stretch")
    at = {c: schema.fieldNames().index(c) for c in (file, offset, length)}

    def run(batches):
        handle, held = None, None
        for whole in batches:
            sizes = np.array([x or 0 for x in whole.column(at[length]).to_pylist()], np.int64)
            turn = np.cumsum(sizes) // HELD_BYTES  # so many bytes are held at once, one slice at least
            for b in (whole.slice(int(k[0]), len(k)) for k in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(turn)) + 1) if len(k)):
                files, starts, sizes = (b.column(at[c]).to_pylist() for c in (file, offset, length))
                rows = [k for k, x in enumerate(zip(files, starts, sizes, strict=True)) if None not in x]
                got, read = [None] * len(files), np.zeros(len(files), np.int64)
                for name_of, own in groupby(rows, key=files.__getitem__):
                    own = [*own]
                    if name_of != held:
                        if handle is not None:
                            handle.close()
                        handle, held = _opened(name_of), name_of
                    low = np.array([starts[k] for k in own], np.int64)
                    high = low + np.maximum([sizes[k] for k in own], 0)
                    for group in np.split(np.arange(len(own)), merged(low, high, slack)[1:]):
                        first, last = int(low[group[0]]), int(high[group].max())
                        handle.seek(first)
                        piece = handle.read(last - first) if last > first else b""
                        read[own[group[0]]] = len(piece)
                        for k in group.tolist():
                            got[own[k]] = piece[low[k] - first : high[k] - first]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()), pa.array(read)], names=[*b.schema.names, name, "bytes_read"])
        if handle is not None:
            handle.close()

    return d.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.BinaryType()), T.StructField("bytes_read", T.LongType())]))


def pcm_floats(data) -> Column:
    """16-bit little-endian bytes as floats of -1 to 1."""
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 2 * 2], "<i2").astype(np.float32) / np.float32(32768))

    return run(F.col(data) if isinstance(data, str) else data)


def pcm_bytes(samples) -> Column:
    """Samples of -1 to 1 as 16-bit little-endian bytes, as a built-in expression."""
    c = F.col(samples) if isinstance(samples, str) else samples
    cut = lambda v: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(v.cast("double") * 32768.0)))
    h = lambda v: F.lpad(F.hex(cut(v).cast("long").bitwiseAND(0xFFFF)), 4, "0")
    return F.unhex(F.array_join(F.transform(c, lambda v: F.concat(F.substring(h(v), 3, 2), F.substring(h(v), 1, 2))), ""))
