"""WARC archives without repeated payloads, and their reader.

Headers (page, sizes, digests) are taken in one scan and grouped by payload digest, with counts merged before the
shuffle; pages of a group join its original. Groups that hold more than a ten-thousandth of all pages, of which there
are ten thousand at most, join by broadcast, so that no task gets all copies of a payload. Pages that can't be revisits
are then written straight from a second scan; only those that may be are shuffled with their payload. A task writes
its records to archives of its own, a gzip member each; an archive counts once Spark has committed the row that names
it, so that what lost or repeated tasks left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.bloom import of_keys
from weir.session import bound_batches, settle, shared_dir, table

#: Bytes at which an archive ends and the next begins; bytes read at once; groups that may join by broadcast; longest address in a revisit's header.
ARCHIVE, CHUNK, FREQUENT, ADDRESS = 1 << 30, 1 << 20, 10_000, 2048
#: Fixed values of the format.
_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a missing page_id, which comes after all others.
_LAST = (1 << 63) - 1
_NAMES = uuid.UUID("5f0c4ad4-93b7-5e0f-9a53-6d4de3a1f0c1")
_MANIFEST = "file string, records long, bytes long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string, offset long, payload binary"


def record_id(page: int, same: bytes) -> str:
    """The name of the response that holds this payload of this page."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{same.hex()}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"".join((_VERSION, head.encode(), b"\r\n", block, _END))


def _address(url: str | None, page: int) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else f"urn:page:{page}"


def page_record(page: int, url: str | None, html: bytes, same: bytes, original: int | None, original_url: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit without it where original names the page that has it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    again = original is not None
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if again else record_id(page, same)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _address(url, page)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", _PROFILE if again else None),
        ("WARC-Refers-To", record_id(original, same) if again else None),
        ("WARC-Refers-To-Target-URI", _address(original_url, original) if again and original_url else None),
        ("Page-ID", page if page != _LAST else None),
        ("Refers-To-Page-ID", original),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, head if again else head + html)


def _gzip(b: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b) + z.flush()


class _Archives:
    """Archives written one after the other by one task; rows holds what was finished."""

    def __init__(self, folder: str, date: str, limit: int):
        self.fs, self.folder = FileSystem.from_uri(folder)
        self.date, self.limit, self.out, self.rows = date, limit, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.file, self.n = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.file}", compression=None)
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", self.file), ("Content-Type", "application/warc-fields")]
            self.out.write(_gzip(_record(about, b"software: weir\r\nformat: WARC File Format 1.1\r\n")))
        self.out.write(_gzip(record))
        self.n += 1
        if self.out.tell() >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.rows.append((self.file, self.n, self.out.tell()))
            self.out.close()
            self.out = None


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, limit: int, maybe=None) -> Iterator[pa.RecordBatch]:
    """Write a batch's pages, but those that maybe has, where it is given."""
    archives = _Archives(folder, date, limit)
    for batch in batches:
        rows = batch if maybe is None else batch.filter(pa.array(~maybe.value.has(batch.column("key").to_numpy())))
        names = ["d", "url", "html", "same", *(["first", "first_url"] if maybe is None else [])]
        for row in zip(*(rows.column(c) for c in names)):
            archives.add(page_record(*(x.as_py() for x in row), *([None, None] if maybe is not None else []), date))
    archives.close()
    if archives.rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*archives.rows)], ["file", "records", "bytes"])


def _candidates(batches: Iterator[pa.RecordBatch], maybe) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(maybe.value.has(batch.column("key").to_numpy())))


def revisits(heads: DataFrame, least: int = 0) -> DataFrame:
    """(d, same, first, first_url) of each page of heads (d, url, n, same) that repeats the payload, of least bytes or more, of a page with a smaller d."""
    url = F.when(F.length("url") <= ADDRESS, F.col("url"))
    groups = heads.where(F.col("n") >= least).groupBy("same").agg(F.min(F.struct("d", url.alias("url"))).alias("o"), F.max("d").alias("last"), F.count("*").alias("pages"))
    groups = settle(groups.where("o.d < last").select("same", F.col("o.d").alias("first"), F.col("o.url").alias("first_url"), "pages"), "groups")
    often = F.col("pages") * FREQUENT > heads.count()
    pages = heads.select("d", "same")
    found = pages.join(F.broadcast(groups.where(often)), "same").union(pages.join(groups.where(~often), "same"))
    return found.where("d > first").groupBy("d", "same").agg(F.first("first").alias("first"), F.first("first_url").alias("first_url"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, limit: int = ARCHIVE) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) as WARC files; returns their folder and a table (file, records, bytes) of those that count.

    A null html is an empty payload. Of pages with equal payloads (by SHA-256) of least bytes or more, those with the
    smallest page_id are responses and the others revisits of it; shorter ones are all responses. A null page_id comes
    after all others; rows that repeat the smallest page_id with its payload are responses each, and share a record id.
    An empty table gives no archive. Other columns are ignored. folder: one that driver and executors share, and that
    Arrow's file systems reach (file, hdfs, s3, gs); a new one in the session's shared folder where none is given.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark)}/weir/{uuid.uuid4().hex}-archives"
    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_LAST)).alias("d"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("same", F.unhex(F.sha2("html", 256)))
    heads = settle(rows.select("d", "url", F.octet_length("html").alias("n"), "same"), "heads")
    again = settle(revisits(heads, least), "revisits")
    key = F.xxhash64("d", "same").alias("key")
    maybe = spark.sparkContext.broadcast(of_keys(again.select(key), again.count()))
    keyed = rows.select("*", key)
    write = partial(_write, folder=folder, date=date, limit=limit)
    straight = keyed.mapInArrow(partial(write, maybe=maybe), _MANIFEST)
    some = keyed.mapInArrow(partial(_candidates, maybe=maybe), keyed.schema).join(again, ["d", "same"], "left")
    return folder, settle(straight.union(some.mapInArrow(write, _MANIFEST)), "manifest")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; a member and a chunk are held at once."""
    at, held = 0, b""
    while True:
        z, out, start = zlib.decompressobj(31), [], at
        while not z.eof:
            held = held or stream.read(CHUNK)
            if not held:
                if out or at > start:
                    raise ValueError("an archive ends within a record")
                return
            out.append(z.decompress(held))
            at += len(held) - len(z.unused_data)
            held = z.unused_data
        yield start, b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, by lower-case names, and block; ValueError for what is not a record."""
    head, end, rest = record.partition(b"\r\n\r\n")
    if not end or not head.startswith(_VERSION):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    n = int(fields["content-length"])
    if rest[n:] != _END:
        raise ValueError("a record's length is not its header's")
    return fields, rest[:n]


def _page(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is not that of its header")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("page-id"), fields["warc-target-uri"], length, digest, fields["warc-type"], number("refers-to-page-id"), fields["warc-record-id"]), payload


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 2, pa.int64(), *[pa.string()] * 2, pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _READ.split(", ")]
    fs, path = FileSystem.from_uri(folder)
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for file in batch.column("file").to_pylist():
            with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                for offset, record in members(stream):
                    fields, block = parse(record)
                    if fields["warc-type"] in ("response", "revisit"):
                        about, payload = _page(fields, block)
                        keep = payload if payloads and fields["warc-type"] == "response" else None
                        rows.append((*about, file, offset, keep))
                        size += 500 + len(keep or b"")
                    if size > 4 * CHUNK:
                        yield out()
                        rows, size = [], 0
    if rows:
        yield out()


def read_archives(folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The pages of the archives that manifest names, a task an archive: what each record's header says, and of responses the payload if asked for.

    A response whose payload has not its header's length and digest, or a record cut short, is an error.
    """
    files = manifest.select("file")
    out = files.repartition(max(1, files.count())).mapInArrow(partial(_read, folder=folder, payloads=payloads), _READ)
    return out if payloads else out.drop("payload")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    folder, manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
