"""File listings and files over HTTP as Spark data sources.

A listing is a task a page, a download a task a file.  Requests are tried
again after failures that may pass; a body that is shorter than was said is
such a failure, and never a result.
"""

from __future__ import annotations

import http.client
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "page int, place int, path string, kind string, bytes long, digest string"
PIECE = "url string, number int, offset long, content binary, total long"
#: Bytes of a file that a row holds at most.
PIECE_BYTES = 4 << 20


class ShortBody(OSError):
    """A body ended before the length that its header gives."""


def _may_pass(e: Exception) -> bool:
    return e.code >= 500 or e.code == 429 if isinstance(e, urllib.error.HTTPError) else isinstance(e, OSError | http.client.HTTPException)


def attempt(options: dict, work):
    """``work()``, again after a failure that may pass: ``tries`` times in all,
    with waits of ``wait`` seconds, doubled each time."""
    tries, wait = int(options.get("tries", 4)), float(options.get("wait", 0.5))
    for k in range(tries):
        try:
            return work()
        except Exception as e:
            if k + 1 == tries or not _may_pass(e):
                raise
            time.sleep(wait * 2**k)


def _open(url: str, options: dict, method: str = "GET", first: int = 0):
    headers = {"Range": f"bytes={first}-"} if first else {}
    return urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=float(options.get("timeout", 60)))


def _whole(url: str, options: dict) -> bytes:
    with _open(url, options) as answer:
        body = answer.read()
        said = answer.headers.get("Content-Length")
    if said is not None and len(body) != int(said):
        raise ShortBody(f"{url}: {len(body)} of {said} bytes")
    return body


@dataclass
class Page(InputPartition):
    number: int
    url: str


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        """The pages: of a template with ``{page}`` and a number of ``pages``, or
        by the links to the next page, whose headers alone are asked for."""
        url, pages = self.options["url"], self.options.get("pages")
        if pages is not None:
            return [Page(k, url.replace("{page}", str(k))) for k in range(int(pages))]
        out = []
        while url:
            out.append(Page(len(out), url))

            def links(url=url):
                with _open(url, self.options, "HEAD") as answer:
                    return answer.headers.get("Link") or ""

            found = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', attempt(self.options, links))
            url = found[1] if found else None
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        entries = attempt(self.options, lambda: json.loads(_whole(page.url, self.options)))
        for k, x in enumerate(entries):
            digest = (x.get("lfs") or {}).get("oid") or x.get("oid")
            yield page.number, k, x.get("path"), x.get("type"), x.get("size"), digest


class Listing(DataSource):
    """``format("http_listing")``: the entries of JSON pages."""

    @classmethod
    def name(cls) -> str:
        return "http_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


@dataclass
class RemoteFile(InputPartition):
    url: str


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[RemoteFile]:
        return [RemoteFile(u) for u in json.loads(self.options["urls"])]

    def read(self, file: RemoteFile) -> Iterator[tuple]:
        """Pieces of a file in order.  After a failure the rest is asked for from
        where the last piece ended; a server that knows no ranges starts anew
        and what is held already is passed over."""
        done = {"at": 0, "number": 0, "total": None}
        ready: list[tuple] = []

        def go_on():
            with _open(file.url, self.options, first=done["at"]) as answer:
                skip = 0 if answer.status == 206 else done["at"]
                said = answer.headers.get("Content-Length")
                if said is not None:
                    done["total"] = int(said) + done["at"] - skip
                while skip:
                    skip -= len(answer.read(min(skip, PIECE_BYTES)) or (_ for _ in ()).throw(ShortBody(file.url)))
                while piece := answer.read(PIECE_BYTES):
                    ready.append((file.url, done["number"], done["at"], piece))
                    done["at"] += len(piece)
                    done["number"] += 1
                    if len(ready) >= 4:
                        return False
                if done["total"] is not None and done["at"] != done["total"]:
                    raise ShortBody(f"{file.url}: {done['at']} of {done['total']} bytes")
            return True

        over = False
        while not over:
            over = attempt(self.options, go_on)
            for row in ready:
                yield *row, done["total"]
            ready.clear()


class Files(DataSource):
    """``format("http_files")``: files by pieces, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "http_files"

    def schema(self) -> str:
        return PIECE

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
    spark.dataSource.register(Files)


def read_listing(spark: SparkSession, url: str, pages: int | None = None, **options) -> DataFrame:
    """(page, place, path, kind, bytes, digest) of a paged listing."""
    register(spark)
    r = spark.read.format("http_listing").option("url", url).options(**options)
    return (r if pages is None else r.option("pages", str(pages))).load()


def read_files(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """(url, number, offset, content, total) of files, in pieces of 4 MiB at most."""
    register(spark)
    return spark.read.format("http_files").option("urls", json.dumps(list(urls))).options(**options).load()


def remote_sizes(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """(url, bytes) by headers alone; 0 where a server doesn't say."""
    def ask(batches):
        import pandas as pd

        for b in batches:
            def size(u):
                with _open(u, options, "HEAD") as answer:
                    return int(answer.headers.get("Content-Length") or 0)

            yield pd.DataFrame({"url": b["url"], "bytes": [attempt(options, lambda u=u: size(u)) for u in b["url"]]})

    d = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, min(len(urls), 64)))
    return d.mapInPandas(ask, "url string, bytes long")


def proven_revision(listing: DataFrame, local: DataFrame, revisions: DataFrame, group: str = "folder", path: str = "path", digest: str = "digest", suffix: str = ".parquet") -> DataFrame:
    """(group, revision, remote, local, differing): a group's revision is proven,
    and else null, if its listed files with ``suffix``, in order of their paths,
    have the digests of the local ones in order of their place.

    ``listing`` (group, path, digest, kind), ``local`` (group, place, digest),
    ``revisions`` (group, revision).  A group that one side lacks, or without
    any file, is not proven."""
    files = listing.where((F.col("kind") == "file") & F.col(path).endswith(suffix))
    place = lambda by: F.row_number().over(Window.partitionBy(group).orderBy(by))  # noqa: E731  a group is a folder's files
    a = files.select(group, place(path).alias("_n"), F.col(digest).alias("_remote"), F.lit(1).alias("_r"))
    b = local.select(group, place("place").alias("_n"), F.col(digest).alias("_local"), F.lit(1).alias("_l"))
    n = a.join(b, [group, "_n"], "full_outer").groupBy(group).agg(
        F.count("_r").alias("remote"), F.count("_l").alias("local"), F.count_if(~F.coalesce(F.col("_remote") == F.col("_local"), F.lit(False))).alias("differing"))
    out = revisions.select(group, "revision").join(n, group, "left").na.fill(0, ["remote", "local", "differing"])
    good = (F.col("remote") > 0) & (F.col("differing") == 0)
    return out.select(group, F.when(good, F.col("revision")).alias("revision"), "remote", "local", "differing")
