"""WARC archives: written with Spark's text writer, read back by a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_join, shared_folder

ARCHIVE_RECORDS = 2048
# fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (20 bits) at a time."""
    full = F.sha1(payload)
    groups = [
        F.translate(F.lpad(F.conv(F.substring(full, 1 + 5 * i, 5), 16, 32), 4, "0"), _HEX32, _BASE32) for i in range(8)
    ]
    return F.concat(*groups)


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, value): one WARC record per row, without the two line ends that close it.

    Among rows with equal payloads of at least ``min_bytes`` the largest page_id is a response, the others revisit it;
    rows that repeat that page_id are responses too. A null payload is empty. Control characters and blanks in the URL
    are percent-encoded; a null URL leaves the field out. A null page_id is written as id ``null`` and read back as null.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"),
    ).withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.octet_length("body").cast("long"))
    shared = rows.filter(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("_d"), F.col("size").alias("_s")).agg(
        F.max("page_id").alias("origin"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    shared = for_join(shared.select("_d", "_s", "origin"))
    rows = rows.join(shared, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    revisit = F.col("origin").isNotNull() & ~F.col("origin").eqNullSafe(F.col("page_id"))
    body = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "body"))
    address = F.regexp_replace("url", r"[\x00-\x20\x7f\x{85}\x{2028}\x{2029}]", "%20")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), address, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("origin").cast("string"),
            F.lit(">\r\nWARC-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\n"),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select("page_id", F.concat(head, body).alias("value"))


def write_archives(records: DataFrame, path: str, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write records as plain .warc text files of at most ``archive_records`` records each.

    A record with UTF-8 content is text, so Spark's own text writer makes the archives on any file system, with its
    commit protocol; the record separator is the two line ends that close each record.
    """
    writer = records.select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", archive_records)
    writer.text(path)


_MARK = re.compile(rb"WARC/\d+\.\d+[ \t]*\r?\n")
_GZIP = b"\x1f\x8b\x08"


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _plain_records(data: bytes, base: int, gaps: list):
    """Records of uncompressed bytes. A record counts when its length and digest hold and a record or the end follows;
    else the bytes up to the next version line are a gap."""
    at = 0
    while at < len(data):
        mark = _MARK.match(data, at)
        if mark is None:
            after = _MARK.search(data, at)
            end = after.start() if after else len(data)
            if data[at:end].strip(b"\r\n"):
                gaps.append((base + at, end - at, "no version line"))
            at = end
            continue
        problem, end = "", at
        close = data.find(b"\r\n\r\n", mark.end() - 2)
        fields = _fields(data[mark.end():close]) if close >= 0 else {}
        length = fields.get("content-length", "")
        if close < 0:
            problem = "header without end"
        elif not length.isascii() or not length.isdigit():
            problem = "no valid length"
        else:
            begin = close + 4
            end = begin + int(length)
            block = data[begin:end]
            if end > len(data):
                problem = "cut off"
            elif data[end:end + 4] != b"\r\n\r\n":
                problem = "wrong length"
            else:
                split = block.find(b"\r\n\r\n")
                payload = block[split + 4:] if split >= 0 else block
                stated = fields.get("warc-payload-digest", "")
                if fields.get("warc-type") == "response" and stated.startswith("sha1:"):
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated[5:]:
                        problem = "wrong digest"
        if not problem:
            yield fields, payload
            at = end + 4
            continue
        after = _MARK.search(data, mark.end())
        stop = after.start() if after else len(data)
        gaps.append((base + at, stop - at, problem))
        at = stop


# bytes that are given to the decompressor at once
_FEED = 1 << 16


def _member(data: bytes, start: int) -> tuple[bytes, int, str | None]:
    """(content, end, problem) of the gzip member at ``start``; the rest of the archive is not copied."""
    machine, view, parts, at = zlib.decompressobj(31), memoryview(data), [], start
    try:
        while at < len(data) and not machine.eof:
            part = view[at:at + _FEED]
            parts.append(machine.decompress(part))
            at += len(part)
    except zlib.error:
        return b"".join(parts), at, "damaged"
    if not machine.eof:
        return b"".join(parts), at, "cut off"
    return b"".join(parts), at - len(machine.unused_data), None


def salvage(data: bytes) -> tuple[list, list]:
    """([(fields, payload)], [(offset, length, reason)]) of a plain or member-compressed archive.

    After a failed check the reader looks for the next gzip member or version line and goes on from there; the bytes
    between are listed as gaps. Offsets in a member count from the start of that member's content.
    """
    records, gaps = [], []
    if not data.startswith(_GZIP) and (_MARK.match(data) or _GZIP not in data):
        records.extend(_plain_records(data, 0, gaps))
        return records, gaps
    at = 0
    while at < len(data):
        member = data.find(_GZIP, at)
        if member != at:
            end = member if member >= 0 else len(data)
            gaps.append((at, end - at, "no gzip member"))
            if member < 0:
                break
        content, end, problem = _member(data, member)
        found, inner = [], []
        found.extend(_plain_records(content, 0, inner))
        if problem is None:
            records.extend(found)
            gaps.extend(inner)
            at = end
            continue
        # whole records in front of the damage are kept: all of a member that is only cut off, of a damaged one those
        # whose digest was checked
        records.extend(r for r in found if problem == "cut off" or r[0].get("warc-type") == "response" and r[0].get(
            "warc-payload-digest", "").startswith("sha1:"))
        after = data.find(_GZIP, member + 1)
        end = after if after >= 0 else len(data)
        gaps.append((member, end - member, "broken gzip member"))
        at = end
    return records, gaps


_ROWS = (
    "archive string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary, gap_offset long, gap_bytes long, gap_reason string"
)


def _id(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value)
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of all archives below ``path``: records (gap columns null), then gaps (record columns null).

    One task reads one archive at a time; an empty archive has no rows.
    """

    def read(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                records, gaps = salvage(bytes(data))
                out = []
                for fields, payload in records:
                    kind = fields.get("warc-type")
                    if kind == "revisit":
                        size = fields.get("warc-payload-length", "")
                        size, sum_ = int(size) if size.isdigit() else None, fields.get("warc-payload-digest", "")[5:]
                        body = None
                    else:
                        size, sum_ = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        body = payload if payloads else None
                    out.append((name, _id(fields.get("warc-record-id", "")), size, sum_, kind,
                                _id(fields.get("warc-refers-to", "")), body, None, None, None))
                out += [(name, None, None, None, None, None, None, *g) for g in gaps]
                for k in range(0, len(out), 512):
                    frame = pd.DataFrame(out[k:k + 512], columns=[c.split()[0] for c in _ROWS.split(", ")])
                    for c in ("page_id", "payload_bytes", "refers_to", "gap_offset", "gap_bytes"):
                        frame[c] = frame[c].astype("Int64")
                    yield frame

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, _ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 0, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; see ``read_archives``."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(to_records(pages, min_bytes=min_bytes), path, archive_records)
    return read_archives(spark, path, payloads=False)
