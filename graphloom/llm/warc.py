"""WARC archives: written with one gzip member for each record, read back by a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, materialize, small_batches

#: Bytes of an archive after which the next record starts another, and bytes that the reader decompresses at a time.
ARCHIVE_BYTES, BLOCK = 4 << 20, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is cut off, badly framed or whose digest doesn't match."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, kind: str, block: bytes, headers: dict[str, str], level: int = 1) -> bytes:
    """A WARC record as one gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **headers, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The response record of a page, or the revisit record that refers to the page with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if url and url.strip():
        head["WARC-Target-URI"] = url
    if refers_to is None:
        return record(f"urn:page:{page_id}", "response", http + payload, head)
    return record(f"urn:page:{page_id}", "revisit", http, head | {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"})


def _members(data: bytes) -> Iterator[bytes]:
    """Each gzip member, decompressed a block at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise WarcError("the last gzip member is cut off")
            block = view[at : at + BLOCK]
            try:
                parts.append(z.decompress(block))
            except zlib.error as e:
                raise WarcError(f"a gzip member is damaged: {e}") from e
            at += len(block) - len(z.unused_data)
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record headers, HTTP headers, payload) of each record; raises WarcError where something doesn't fit."""
    for member in _members(data):
        head, gap, rest = member.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"WARC/1."):
            raise WarcError("a member doesn't start with a record's header")
        fields = _fields(head)
        if not fields.get("content-length", "").isdecimal():
            raise WarcError("a record has no length")
        size = int(fields["content-length"])
        block, tail = rest[:size], rest[size:]
        if len(block) != size or tail != b"\r\n\r\n":
            raise WarcError("a record's length doesn't frame it")
        if fields.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
            raise WarcError("a block's digest doesn't match")
        http, gap, payload = block.partition(b"\r\n\r\n")
        http_fields = _fields(http) if gap else {}
        if fields.get("warc-type") == "response":
            if fields.get("warc-payload-digest") not in (None, f"sha1:{digest(payload)}"):
                raise WarcError("a payload's digest doesn't match")
            if http_fields.get("content-length") not in (None, str(len(payload))):
                raise WarcError("a payload's length doesn't match")
        yield fields, http_fields, payload


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for i, url, html, to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(page_record(i.as_py(), url.as_py(), (html.as_py() or "").encode(), to.as_py(), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary()), "records": pa.array([len(held)], pa.int64())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary()), "records": pa.array([len(held)], pa.int64())})

    return run


def write_archives(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, records): WARC files with a record for each row of pages (page_id, url, html), as binary values.

    Of payloads of at least `least` bytes that are equal, the one with the smallest page_id is a response, the others
    are revisits; a null html is empty. page_ids are taken as unique (of rows with equal page_id and equal payload
    all are responses); rows with a null page_id are left out. Null or blank urls and line ends in them leave the
    target out or become spaces. Digests meet in a partial minimum, so a payload that very many pages share stays
    spread; the pages themselves are joined on page_id. Concatenating archives gives an archive.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    light = src.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha")).where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    first = light.groupBy("sha").agg(F.min("page_id").alias("refers_to"))
    again = light.join(dealt(first), "sha").where("page_id > refers_to").select("page_id", "refers_to").distinct()
    return src.join(dealt(again), "page_id", "left").select("page_id", "url", "html", "refers_to").mapInArrow(_write(date), "archive binary, records long")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of page archives.

    Fails with WarcError on a damaged archive. Empty or null archives have no records.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        number = lambda s: int(s.strip("<>").rpartition(":")[2]) if s else None
        for batch in batches:
            for value in batch.column(column):
                rows = [(number(f["warc-record-id"]), f.get("warc-target-uri"), int(h["content-length"]), f["warc-payload-digest"].partition(":")[2], f["warc-type"], number(f.get("warc-refers-to"))) for f, h, _ in read(value.as_py() or b"")]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select(column).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of pages, written to the shared folder and read back."""
    small_batches(pages.sparkSession)
    return read_archives(materialize(write_archives(pages, least), "warc"))


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


#: base32(x) of a hex SHA-1 in SQL: 32 letters of 5 bits each, from the 40 hex digits.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
f as (select sha, min(page_id) as first_id from p group by sha)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast(('0x' || substr(p.sha || '00', 1 + cast(floor(i * 5 / 4) as int), 2)) as int) // cast(pow(2, 3 - (i * 5) % 4) as int)) % 32 as int), 1)), 'string_agg', '') as payload_digest,
  case when p.page_id = f.first_id then 'response' else 'revisit' end as record_type,
  case when p.page_id = f.first_id then null else f.first_id end as refers_to
from p join f on p.sha = f.sha
"""
