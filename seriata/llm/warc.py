"""WARC archives: a writer in the JVM and a salvage reader that survives damaged bytes.

Records are written by Spark's text sink, with the format's two line ends as line separator, so the archives can lie in any
store that Spark writes. The reader checks every record (lengths, ends, digests); where a check fails it looks for
the next version line or gzip member that passes all checks, goes on from there and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

#: Production parameters: payloads from this size are deduplicated; an archive's most bytes, but for one larger record; the date of the records.
MIN_DEDUP_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
#: Pages are written class by class of size, so that the number of records in a file bounds its bytes: below each of these, and beyond.
CLASSES = (4 << 10, 64 << 10, 1 << 20)
#: What a record has besides its page and url, at most.
HEAD_BYTES = 1 << 10
DATE = "2000-01-01T00:00:00Z"
#: Most digests with several records that are sent to every task (about 100 bytes each); beyond it they are joined by shuffle.
MAX_SENT_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"<urn:x-page:(-?\d+|null)>")


# --- writer -----------------------------------------------------------------------------------------------------


def _record(kind: Column, page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    eol = "\r\n"
    name = F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("urn:x-page:unknown")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(eol * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{eol}WARC-Refers-To: <urn:x-page:"), refers_to.cast("string"), F.lit(f">{eol}"))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), kind, F.lit(f"{eol}WARC-Record-ID: "), name, F.lit(f"{eol}WARC-Date: {DATE}{eol}WARC-Target-URI: "), uri, F.lit(eol), more,
        F.lit("WARC-Payload-Digest: sha1:"), digest, F.lit(f"{eol}WARC-Block-Digest: sha1:"), F.sha1(block),
        F.lit(f"{eol}Content-Type: application/http;msgtype=response{eol}Content-Length: "), F.octet_length(block).cast("string"), F.lit(eol * 2), block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES, max_sent: int = MAX_SENT_DIGESTS) -> None:
    """A record for each row of ``pages(page_id, url, html)``, into new files under ``path``.

    Of equal payloads of at least ``min_bytes`` the largest ``page_id`` is a response (each of its rows, if it repeats), the
    others revisit it; if none has an id, all are responses. Null html is an empty payload, a null url a placeholder.
    """
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload) + F.coalesce(F.octet_length("url"), F.lit(0))
    kind_of = F.when(size < CLASSES[0], 0).when(size < CLASSES[1], 1).when(size < CLASSES[2], 2).otherwise(3)
    digest = F.sha1(payload.cast("binary")).alias("digest")
    sized = pages.select("page_id", F.octet_length(payload).alias("n"), digest, kind_of.alias("class"))
    groups = sized.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies"), F.max("n").alias("n"), *[F.count_if(F.col("class") == k).alias(f"c{k}") for k in range(4)])
    told = groups.agg(F.count_if((F.col("copies") > 1) & (F.col("n") >= min_bytes)).alias("again"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(4)]).first()
    again = groups.where(f"copies > 1 and n >= {min_bytes}").select("digest", "best")
    revisits = F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best")))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    record = _record(kind, F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("best"))
    for k, most in enumerate((*CLASSES, archive_bytes)):
        if told[f"c{k}"] or not any(told[1:]) and k == 0:
            rows = pages.where(kind_of == k).select("page_id", "url", payload.alias("payload"), digest)
            rows = rows.join(F.broadcast(again) if told.again <= max_sent else again, "digest", "left")
            rows.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, archive_bytes // (most + HEAD_BYTES))).text(path)


# --- reader -----------------------------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    end: int
    headers: dict[bytes, bytes]
    block: bytes


@dataclass
class Gap:
    """Bytes that belong to no record which passes all checks."""

    start: int
    end: int


#: Headers end at an empty line, however long they are; a version line before it starts another record.
_HEAD_END = re.compile(rb"\r\n\r\n|\r\n(?=WARC/1\.[01]\r\n)")


def _plain(data: bytes, at: int) -> Record | None:
    if data[at : at + 7] != b"WARC/1.":
        return None
    found = _HEAD_END.search(data, at)
    if found is None or found[0] != b"\r\n\r\n":
        return None
    head = found.start()
    version, *lines = data[at:head].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not all(b":" in x for x in lines):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    length = headers.get(b"content-length", b"")
    if not length.isdigit():
        return None
    end = head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[head + 4 : end]
    told = headers.get(b"warc-block-digest")
    if told is not None:
        sound = _holds(told, block)
    elif headers.get(b"warc-type") == b"response" and b"warc-payload-digest" in headers:
        # a payload digest may be taken before or after a transfer encoding
        sound = _holds(headers[b"warc-payload-digest"], payload_of(block)) or b"\r\ntransfer-encoding:" in block.partition(b"\r\n\r\n")[0].lower()
    else:
        # a version line inside is data if another record, or the end, follows this one at once
        sound = b"\r\nWARC/1." not in block or end + 4 >= len(data) or _STARTS.match(data, end + 4) is not None
    return Record(at, end + 4, headers, block) if sound else None


_DIGESTS = ("md5", "sha1", "sha256", "sha512")


def _holds(digest: bytes, data: bytes) -> bool:
    """Whether a digest in hex or base32 is that of ``data``; one of an unknown kind holds."""
    kind, _, value = digest.partition(b":")
    name = kind.decode("latin-1").lower().replace("-", "")
    if name not in _DIGESTS:
        return True
    made = hashlib.new(name, data)
    return value.lower() == made.hexdigest().encode() or value.upper().rstrip(b"=") == base64.b32encode(made.digest()).rstrip(b"=")


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _member(data: bytes, at: int) -> Record | None:
    """The record in a gzip member. Nothing is inflated beyond the length that the record's own headers tell."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        return None
    z, plain, need, read = zlib.decompressobj(31), bytearray(), None, at
    try:
        while not z.eof:
            fed = z.unconsumed_tail or data[read : read + _STEP]
            read += 0 if z.unconsumed_tail else len(fed)
            if not fed:
                return None
            plain += z.decompress(fed, _STEP)
            if need is None and (b"WARC/1."[: len(plain)] != plain[:7] or (found := _HEAD_END.search(plain)) and (need := _length(plain, found)) is None):
                return None
            if need is not None and len(plain) > need:
                return None
    except zlib.error:
        return None
    inner = _plain(bytes(plain), 0)
    if inner is None or inner.end != len(plain):
        return None
    return Record(at, read - len(z.unused_data), inner.headers, inner.block)


_STEP = 1 << 16
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n")


def _length(plain: bytearray, head: re.Match) -> int | None:
    """Bytes of a record with both line ends, by its headers; None if they don't tell."""
    told = _LENGTH.search(plain, 0, head.end())
    return head.start() + 8 + int(told[1]) if told and head[0] == b"\r\n\r\n" else None


def _valid(data: bytes, at: int) -> Record | None:
    return _plain(data, at) or _member(data, at)


_STARTS = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records in order and the gaps between them; together they cover every byte."""
    at = 0
    while at < len(data):
        found = _valid(data, at)
        if found is None:
            for m in _STARTS.finditer(data, at + 1):
                found = _valid(data, m.start())
                if found:
                    break
            yield Gap(at, found.start if found else len(data))
        if found is None:
            return
        yield found
        at = found.end


SCHEMA = "archive string, start long, end long, gap boolean, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows for the records and the quarantined gaps (``gap`` true, record columns null) of all archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` are a response's own; a revisit repeats those of the response that it refers to.
    An archive is read by one task, so its size, which the writer bounds by ARCHIVE_BYTES, bounds the memory; Spark reads files of up to 2 GB so.
    Digests may be hex or base32. A record without digests counts if its lengths and ends hold.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                out: list[list] = [[] for _ in names]
                name, data = where.as_py(), content.as_py()
                for x in salvage(data):
                    for c, v in zip(out, (name, x.start, x.end, *_row(x, with_payload)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, SCHEMA)


def _row(x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (True, *[None] * 6)
    kind = x.headers.get(b"warc-type", b"").decode("latin-1")
    payload = payload_of(x.block)
    if kind == "revisit":
        told = re.search(rb"(?i)content-length: *(\d+)", x.block)
        size, digest = int(told[1]) if told else None, x.headers.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return False, _page(x, b"warc-record-id"), size, digest, kind, _page(x, b"warc-refers-to"), payload.decode("utf-8", "replace") if with_payload else None


def _page(x: Record, header: bytes) -> int | None:
    m = _ID.fullmatch(x.headers.get(header, b""))
    return None if m is None or m[1] == b"null" else int(m[1])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: one row per record or gap, as ``read_archives``."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
