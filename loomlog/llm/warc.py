"""WARC archives: writing pages with revisit records, and a reader that survives damage.

``write_pages`` writes uncompressed WARC files through Spark's text writer, so task retries and
any file system that Spark knows are its business. ``read_records`` reads whole archive files, plain or
of gzip members. A record must have a version line, headers, its full block, the closing blank
lines, and the block digest it names. Where that fails the reader searches for the next version
line or member that holds a valid record, goes on from there, and reports the bytes between as a
row of kind ``gap`` with the reason. The bytes of a file are its records and its gaps, nothing else.
Inside a gzip member the search is the same, also in what inflates before the member's damage: records
and gaps there carry the place of the member, and the reason of a gap names its bytes of the content.
Digests are hexadecimal or base32.

Defined cases: a null html is an empty payload, a null url an empty target; a null ``page_id``
is written as an empty field and read back as null, and counts as the smallest; repeated rows
each get a record, and all rows with the largest ``page_id`` of a payload are responses; an empty
table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import materialize

REVISIT_FROM = 1000
RECORDS_PER_FILE = 2000
RECORDS = (
    "file string, kind string, start long, stop long, reason string, page_id long, target string, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HEADERS_END = b"\r\n\r\n"
_INFLATE_STEP = 1 << 16


def roles(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the rows that revisit another page.

    Only ids and digests move. The largest id per digest comes from a partial aggregation, so a
    payload that a third of all pages share costs one row per task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    long = pages.select(F.col("page_id").cast("long"), html.alias("html"))
    long = long.filter(F.octet_length("html") >= REVISIT_FROM)
    seen = long.groupBy(F.sha1(F.encode("html", "UTF-8")).alias("digest"), "page_id").agg(F.lit(1).alias("_one"))
    seen = materialize(seen.select("digest", "page_id"), "warc-digests")
    largest = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    largest = largest.filter("_n > 1").drop("_n")
    revisits = seen.join(largest, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return materialize(revisits.select("page_id", "digest", "refers_to"), "warc-revisits")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """``record``: each page as the text of one WARC record without its last line break."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    rows = pages.select(
        F.col("page_id").cast("long"),
        url.alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
    )
    links = roles(pages).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("refers_to").alias("_to")
    )
    same = rows["page_id"].eqNullSafe(links["_id"]) & (rows["digest"] == links["_digest"])
    rows = rows.join(links, same, "left")
    revisit = F.col("_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    rows = rows.select("*", revisit.alias("revisit"), block.alias("block"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    profile = F.concat(
        _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_to").cast("string"), F.lit(">"))),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        F.when(F.col("revisit"), profile).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes").cast("string")),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("block", "UTF-8")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
        F.lit("\r\n"),
    )
    return rows.select(record.alias("record"))


def write_pages(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the pages as WARC files below ``path``, at most so many records in each."""
    writer = records(pages).write.option("lineSep", "\r\n").option("compression", "none")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


class Damaged(Exception):
    """Why the bytes at a place are no valid record."""


def _record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at ``start``."""
    version = _VERSION.match(data, start)
    if not version:
        raise Damaged("no version line")
    close = data.find(_HEADERS_END, version.end() - 2)
    if close < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[version.end() : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    begin = close + len(_HEADERS_END)
    stop = begin + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[begin:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != _hex(digest[5:]):
        raise Damaged("block digest differs")
    return headers, block, stop + 4


def _hex(digest: str) -> str:
    """A SHA-1 digest in hexadecimal, given so or in base32."""
    if re.fullmatch("[A-Za-z2-7]{32}", digest):
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def _member(data: bytes, start: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``start``, and what is wrong after that content."""
    inflate, parts, place = zlib.decompressobj(wbits=31), [], start
    while not inflate.eof:
        if place >= len(data):
            return b"".join(parts), place, "member is cut off"
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(data[place : place + _INFLATE_STEP]))
        except zlib.error:
            # The step gave nothing back, so its good bytes are inflated one at a time.
            with contextlib.suppress(zlib.error):
                for at in range(place, place + _INFLATE_STEP):
                    parts.append(before.decompress(data[at : at + 1]))
            return b"".join(parts), place, "member does not inflate"
        place = min(place + _INFLATE_STEP, len(data))
    return b"".join(parts), place - len(inflate.unused_data), None


def _inside(content: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """The same as ``salvage`` for the content of a member, by places in the content."""
    place, gap, reason = 0, None, None
    while place < len(content):
        try:
            headers, block, stop = _record(content, place)
        except Damaged as error:
            if gap is None:
                gap, reason = place, str(error)
            later = _VERSION.search(content, place + 1)
            place = later.start() if later else len(content)
            continue
        if gap is not None:
            yield gap, place, None, b"", reason
            gap = None
        yield place, stop, headers, block, None
        place = stop
    if gap is not None:
        yield gap, len(content), None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """``(start, stop, headers, block, reason)`` of all records, and of the gaps between them.

    A gap has no headers; its reason is the check that failed at its first byte. Records and gaps
    inside a gzip member carry the place of the member, which ends, if damaged, where the search
    goes on.
    """
    place, gap, reason = 0, None, None
    while place < len(data):
        found = []
        try:
            if data[place : place + 3] == b"\x1f\x8b\x08":
                content, stop, wrong = _member(data, place)
                for start, end, headers, block, why in _inside(content):
                    found.append((headers, block, why and f"{why}, bytes {start} to {end} of the member"))
                # A damaged member in which one record begins is a gap as a whole, not a valid record.
                if not any(headers for headers, _, _ in found) or wrong and len(_VERSION.findall(content)) == 1:
                    raise Damaged(wrong or (found[0][2] if found else "member is empty"))
                if wrong:
                    later = _NEXT.search(data, place + 1)
                    stop = later.start() if later else len(data)
                    found.append((None, b"", f"{wrong}, after {len(content)} bytes of the member"))
            else:
                headers, block, stop = _record(data, place)
                found.append((headers, block, None))
        except Damaged as error:
            if gap is None:
                gap, reason = place, str(error)
            later = _NEXT.search(data, place + 1)
            place = later.start() if later else len(data)
            continue
        if gap is not None:
            yield gap, place, None, b"", reason
            gap = None
        for headers, block, why in found:
            yield place, stop, headers, block, why
        place = stop
    if gap is not None:
        yield gap, len(data), None, b"", reason


def _page(text: str) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(match[1]) if match else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``; one task reads one or more whole files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for start, stop, headers, block, reason in salvage(content.as_py()):
                    if headers is None:
                        rows.append((file.as_py(), "gap", start, stop, reason, *[None] * 7))
                        continue
                    revisit = headers.get("warc-type") == "revisit"
                    payload = block.partition(_HEADERS_END)[2]
                    size = headers.get("warc-payload-length", "") if revisit else str(len(payload))
                    digest = _hex(headers.get("warc-payload-digest", "").removeprefix("sha1:"))
                    if not revisit:
                        digest = hashlib.sha1(payload).hexdigest()
                    rows.append(
                        (
                            file.as_py(), "record", start, stop, None,
                            _page(headers.get("warc-record-id", "")), headers.get("warc-target-uri", ""),
                            headers.get("warc-type"), _page(headers.get("warc-refers-to", "")),
                            int(size) if size.isdigit() else None, digest, payload if with_payload else None,
                        )
                    )
                columns = list(zip(*rows)) if rows else [()] * len(names)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                         pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, kinds)], names=names
                )

    return files.mapInArrow(read, RECORDS)
