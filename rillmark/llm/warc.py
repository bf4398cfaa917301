"""WARC archives: writing deduplicated records, and a reader that salvages what it can.

Writing: every page is one record, a gzip member of its own. Of records with equal payloads the one with the smallest
page_id is a response with the payload, the others are revisits without it. The archives are files of Spark's text writer:
its line separator is one NUL byte, and a gzip member ends in its length modulo 2^32, little-endian, whose last byte is NUL
below 16 MB; the member is handed over without that byte (a larger one is followed by an empty member, which ends in NUL).

Reading: members (or plain records) are taken one after another; a member must inflate with a right CRC, a record must have a
version line, a length that fits and, if it has a payload digest, a payload of that digest. After a failed check the reader
searches on for the next gzip header or version line at which a record passes all checks, and reports the bytes in between as
a gap.

Defined cases: an empty table gives no rows; very long payloads and urls are one record; a null html is an empty payload; a null url leaves its header out; a null page_id is written as an empty
number and read back as null, it sorts first; of rows with equal page_id and payload one is the response; other columns of
pages are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm._shared import cut, shared_dir
from rillmark.llm._tokens import pieces

VERSION = b"WARC/1.0"
GZIP = b"\x1f\x8b\x08"
#: RFC 4648 base 32 in the order of its digits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Revisit records name the rule by which they are copies.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of a file after which a next one is begun, and bytes that are inflated at a time.
FILE_BYTES, CHUNK = 64 << 20, 1 << 16
RECORDS = "archive string, position long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap boolean, reason string"


def base32_sha1(payload: Column) -> Column:
    """Base-32 SHA-1: every 5 hex digits are 4 digits of base 32."""
    digits = F.sha1(payload)
    native = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0"), native, BASE32) for k in range(8)])


def classify(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    The first page of each payload comes from a grouped minimum of narrow rows; a payload that a third of the pages share is
    summed before the shuffle, and the join on the digest may be split by adaptive execution.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    key = ["payload_digest", "payload_bytes"]
    first = rows.groupBy(*key).agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "_row")).alias("_first"), F.count("*").alias("_copies"))
    # Only payloads that occur again need their first page.
    first = cut(first.where("_copies > 1").select(*key, "_first"))
    rows = rows.join(first, key, "left")
    again = F.col("_first").isNotNull() & (F.col("_first._row") != F.col("_row"))
    kind = F.when(again, "revisit").otherwise("response").alias("record_type")
    return rows.select("page_id", "url", "payload", *key, "_row", kind, F.when(again, F.col("_first.page_id")).alias("refers_to"), F.when(again, F.col("_first._row")).alias("_refers_row"))


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to, row: int = 0, refers_row: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: headers, blank line, block, two line ends. A record's id is the page's and the number of its row, as pages may be repeated."""
    name = lambda x, k: f"<urn:page:{'' if x is None else x}:{k or 0}>"
    block = payload if kind == "response" else b""
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to, refers_row)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member (with an empty one behind it, should its last byte not be NUL)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.flush()
    return out


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes classified pages as .warc.gz bytes (Spark names the files .txt) under path, in files of about FILE_BYTES or of one record. date is the time of the crawl, which pages don't tell."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = 0, 0
        for batch in batches:
            for part in pieces(batch, ["payload"], 4 << 20):
                made, files = [], []
                for r in part.to_pylist():
                    made.append(member(record_bytes(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], r["_row"], r["_refers_row"], date))[:-1])
                    if size and size + len(made[-1]) > FILE_BYTES:
                        file, size = file + 1, 0
                    size += len(made[-1]) + 1
                    files.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(made, pa.binary())], names=["file", "member"])

    rows = classify(pages).select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "_row", "_refers_row")
    lines = rows.mapInArrow(pack, "file int, member binary").select("file", F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").partitionBy("file").text(path)


def parse_record(data: bytes) -> tuple[dict, int] | str:
    """The record at the start of data and its length, or why there is none."""
    if not data.startswith(b"WARC/"):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "no end of headers"
    lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return "bad version line"
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return "bad header"
        headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "block does not end where it should"
    block = data[end + 4 : stop]
    kind, digest = headers.get("warc-type", ""), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and b32encode(hashlib.sha1(block).digest()).decode() != digest:
        return "payload digest differs"
    number = lambda h: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)(?::\d+)?>", headers.get(h, ""))) else None
    length = headers.get("warc-payload-length", "")
    return {
        "page_id": number("warc-record-id"), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload_bytes": int(length) if length.isdigit() else len(block), "payload_digest": digest or None, "payload": block,
    }, stop + 4


def _at(data: memoryview, at: int) -> tuple[list[dict], int] | str:
    """The records of the member (or the plain record) at this place, and where it ends."""
    if data[at : at + 3] != GZIP:
        found = parse_record(bytes(data[at:]) if len(data) - at < 1 << 16 else _plain(data, at))
        return found if isinstance(found, str) else ([found[0]], at + found[1])
    unpack, parts, k = zlib.decompressobj(31), [], at
    try:
        while k < len(data) and not unpack.eof:
            parts.append(unpack.decompress(data[k : k + CHUNK]))
            k += CHUNK
    except zlib.error:
        return "member does not inflate"
    if not unpack.eof:
        return "member is cut short"
    inner, end = b"".join(parts), min(k, len(data)) - len(unpack.unused_data)
    records, k = [], 0
    while k < len(inner):
        found = parse_record(inner[k:] if k else inner)
        if isinstance(found, str):
            return found
        records.append(found[0])
        k += found[1]
    return records, end


def _plain(data: memoryview, at: int) -> bytes:
    """As many bytes as the plain record at this place says it has (or, if its headers tell no length, these; or all there are, if they do not end)."""
    size = 1 << 16
    while True:
        head = bytes(data[at : at + size])
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[: end + 2])
            return bytes(data[at : at + end + 8 + int(length[1])]) if length else head[: end + 4]
        if at + size >= len(data) or not re.match(rb"WARC/\d+\.\d+\r\n", head):
            return head  # what begins with no version line is no record, however far it goes
        size *= 2


def salvage(data: bytes) -> Iterator[tuple[int, int, list[dict], str]]:
    """(position, length, records, reason) of every member and every gap, which together cover the archive. A gap has no records but a reason; an empty member has neither."""
    view, at = memoryview(data), 0
    marks = re.compile(rb"\x1f\x8b\x08|WARC/\d")
    while at < len(data):
        found = _at(view, at)
        if not isinstance(found, str):
            yield at, found[1] - at, found[0], ""
            at = found[1]
            continue
        reason, resume = found, len(data)
        for mark in marks.finditer(data, at + 1):
            found = _at(view, mark.start())
            if not isinstance(found, str) and found[0]:
                resume = mark.start()
                break
        yield at, resume - at, [], reason
        at = resume


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path, and a row with gap = true for each quarantined stretch of bytes. A file is read whole by one task; write_archives bounds their size, and Spark refuses files of more than 2 GB."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[dict] = []
                for at, length, records, reason in salvage(content.as_buffer().to_pybytes()):
                    if reason:
                        rows.append({"position": at, "length": length, "gap": True, "reason": reason})
                    rows += [r | {"position": at, "length": length, "gap": False} for r in records]
                    if len(rows) >= 512:
                        yield _batch(rows, name)
                        rows = []
                yield _batch(rows, name)

    def _batch(rows: list[dict], name: str) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([name if n == "archive" else r.get(n) for r in rows], kinds[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
