"""WARC archives: a writer with revisit records and a reader that salvages what it can.

Archives are written by Spark's own writer, so they may lie in any store. A row is one record in a gzip member of its own, and
the line separator is an empty gzip member, which adds nothing when the archive is unpacked. The reader checks each
member and record. After a failed check it looks for the next member or version line that passes, goes on from
there, and reports the bytes in between as a gap. Inside a member it goes on at the next version line of what was unpacked, also where
the member is damaged or cut off.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records an archive holds at most.
RECORDS = 1_000
#: Payloads of at least so many bytes that occur before become revisit records.
LEAST_REVISIT = 0
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|WARC/1\.[01]\r\n")
_PIECE = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class Broken(ValueError):
    """A member or record that fails a check."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def packed(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: Follows every record, also the last.
SEPARATOR = packed(b"")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m.group()), value)


def record(page: str, url: str | None, payload: bytes, number: int, first: tuple[str, int] | None) -> bytes:
    """One WARC record. ``first`` names page and number of the equal payload a revisit refers to."""
    name = lambda p, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{p}/{n}')}>"
    block = _HTTP + payload if first is None else _HTTP
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page, number)}",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url) if url else 'urn:page:' + page}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {name(*first)}", f"X-Refers-To-Page-Id: {first[0]}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, records: int = RECORDS) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Of payloads of at least ``least`` bytes that are equal, that with the smallest page_id is the response and the others are
    revisits; a null page_id comes last, and of rows that share the id one is the response. A null html is an empty
    payload. Other columns are ignored. An empty table writes no record.
    """
    number, key, size = "number", "key", "size"
    rows = pages.select(
        F.col("page_id").cast("string").alias("page"), F.col("page_id"), F.col("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn(number, F.monotonically_increasing_id())
    rows = rows.withColumn(key, F.sha1("payload")).withColumn(size, F.octet_length("payload"))
    first = (
        rows.filter(F.col(size) >= least).groupBy(key, size)
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", number)).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(F.col(key).alias("f_key"), F.col(size).alias("f_size"), "first")
    )
    told = rows.join(first, (F.col(key) == F.col("f_key")) & (F.col(size) == F.col("f_size")), "left").select(
        "page", "url", "payload", number, F.col("first.page_id").cast("string").alias("f_page"), F.col(f"first.{number}").alias("f_number")
    )

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, url, payload, n, f_page, f_n in b.itertuples(index=False):
                refers = None if pd.isna(f_n) or int(f_n) == n else ("" if f_page is None else f_page, int(f_n))
                out.append(packed(record("" if page is None else page, url, bytes(payload), n, refers)))
            yield pd.DataFrame({"member": out})

    told.mapInPandas(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR.decode("latin-1")
    ).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(folder)


@dataclass
class Found:
    """A record (``reason`` empty) or a gap, with its place in the archive as stored.

    In a member, ``offset`` and ``length`` are those of the member, and ``inner`` is the place in its content. A record out of a member
    that is damaged or cut off has length 0, as the bytes count to the gap that reports the member.
    """

    offset: int
    length: int
    reason: str = ""
    headers: dict[str, str] | None = None
    block: bytes = b""
    inner: int = 0


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises Broken if any check fails."""
    v = VERSION.match(data, at)
    if not v:
        raise Broken("no version line")
    ends = _HEAD_END.search(data, v.end() - 2)  # headers hold no version line
    if not ends or ends.group() != b"\r\n\r\n":
        raise Broken("no end of the headers")
    end = ends.start()
    headers = {}
    for line in data[v.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("a header without a name")
        name = name.strip().lower()
        if name in headers and name != "warc-concurrent-to":  # the only one that may repeat: two records ran into one
            raise Broken("a header twice")
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Broken("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("the block does not end where it should")
    block = data[start:stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest32(block):
        raise Broken("the block digest differs")
    return headers, block, stop + 4


def unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``at``; if it is damaged or cut off, what comes before the damage, and the reason."""
    d, out, p, reason = zlib.decompressobj(31), [], at, ""
    while not d.eof and p < len(data):
        try:
            out.append(d.decompress(data[p : p + _PIECE]))
        except zlib.error as e:
            reason = f"gzip: {e}"
            break
        p += _PIECE
    if reason:  # the failed piece again in single bytes, for all that it gives
        d = zlib.decompressobj(31)
        for q in range(at, p, _PIECE):
            d.decompress(data[q : q + _PIECE])
        try:
            for q in range(p, min(p + _PIECE, len(data))):
                out.append(d.decompress(data[q : q + 1]))
        except zlib.error:
            p = q
    elif not d.eof:
        reason = "the member is cut off"
    return b"".join(out), min(p, len(data)) - len(d.unused_data), reason


def inside(content: bytes) -> Iterator[tuple[int, str, dict[str, str] | None, bytes]]:
    """(place, reason, headers, block) of the records in the content of a member, and of the gaps between."""
    p, gap = 0, False
    while p < len(content):
        try:
            headers, block, end = parse(content, p)
        except Broken as e:
            if not gap:
                yield p, str(e), None, b""
            gap = True
            m = VERSION.search(content, p + 1)
            p = m.start() if m else len(content)
            continue
        gap = False
        yield p, "", headers, block
        p = end


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive that pass the checks, and the gaps between, in the order of their offsets."""
    at, gap, reason, inner = 0, None, "", 0
    while at < len(data):
        bad, got, end = "", [], at
        if data.startswith(MAGIC, at):
            content, end, bad = unpack(data, at)
            got = [Found(at, 0 if bad else end - at, why, headers, block, p) for p, why, headers, block in inside(content)]
        else:
            try:
                headers, block, end = parse(data, at)
                got = [Found(at, end - at, "", headers, block)]
            except Broken as e:
                bad = str(e)
        if bad:
            kept = [f for f in got if f.headers is not None]
            if kept and gap is not None:  # records of a damaged member: the gap before ends here
                yield Found(gap, at - gap, reason, inner=inner)
                gap = None
            yield from kept
            if gap is None:
                gap, reason, inner = at, bad, next((f.inner for f in got if f.headers is None), len(content) if kept else 0)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason, inner=inner)
            gap = None
        yield from got
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, reason, inner=inner)


_READ = (
    "archive string, offset long, length long, inner_offset long, gap_reason string, warc_type string, record_id string, target_uri string, "
    "page_id string, refers_to_page_id string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``folder``, packed by member or plain.

    A gap has ``gap_reason`` and null fields; ``inner_offset`` is the place of a record or gap in what its member holds. Digest and size are those of the full payload: of a response they are taken from what was
    read, of a revisit from its headers. An archive is read whole into one task, so it should stay well below 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in b.itertuples(index=False):
                rows, held = [], 0
                for f in salvage(bytes(content)):
                    h = f.headers
                    if h is None:
                        rows.append((path, f.offset, f.length, f.inner, f.reason, *[None] * 8))
                        continue
                    payload = f.block
                    if h.get("content-type", "").startswith("application/http"):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    kind = h.get("warc-type")
                    digest, size = h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("x-payload-length")
                    if kind != "revisit":
                        digest, size = digest32(payload), len(payload)
                    rows.append((
                        path, f.offset, f.length, f.inner, None, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("x-page-id") or None,
                        h.get("x-refers-to-page-id") or None, digest, None if size is None else int(size), payload if payloads else None,
                    ))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in _READ.split(", ")]
    return files.mapInPandas(records, _READ)
