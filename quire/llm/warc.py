"""WARC in seekable Zstandard bundles.

A bundle holds the records of one partition's run of rows, at most ``BUNDLE`` bytes of them: independent Zstandard frames
of some ``FRAME`` bytes of whole records each, then a seek table in a skippable frame (for each frame its compressed and
plain size; count, descriptor and magic number at the end, as the public seekable format has it). The index maps each
record to its bundle, frame, and place in the plain frame, so one record is read by opening one frame.

Of records with equal payloads of ``SAME`` bytes or more, that with the least page_id is the response and the others are
revisits that name it and carry no payload; shorter ones are responses all. Null html is empty. Rows alike in page_id
and html: all but those of the least page_id are revisits; rows of that page_id stay responses each. A null page_id
comes before all others. Equal payloads meet as 64-character digests with partial minima, never as texts.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table, written

NULL_ID = -(2**63)
FRAME, BUNDLE, SAME = 64 << 10, 4 << 20, 100
# Fixed values of the seekable format: skippable frame's magic number, seek table's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLES_DDL = "bundle string, data binary, ids array<long>, frames array<int>, places array<int>"
READ_DDL = "page long, url string, payload_bytes long, payload_digest string, record_type string, refers long, payload binary"


def record(page: int, url: str, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit names the page it refers to and leaves the payload out."""
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_table(data: bytes) -> list[tuple[int, int, int]]:
    """Place, compressed size and plain size of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if flags & 0x80 else 8
    sizes = [struct.unpack_from("<II", data, len(data) - 9 - each * (n - k)) for k in range(n)]
    ends = np.cumsum([0, *(x for x, _ in sizes)]).tolist()
    return [(at, *x) for at, x in zip(ends, sizes, strict=False)]


def frame(data: bytes, k: int) -> bytes:
    at, size, plain = read_table(data)[k]
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(plain, 1))


def parsed(plain: bytes, at: int = 0):
    """Headers and payload of the records in a plain frame, from `at` on."""
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        lines = plain[at:stop].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, plain[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def planned(pages: DataFrame) -> DataFrame:
    """(page, url, html, size, digest, refers): each page with the page that its record refers to, if any."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    own = own.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    least = own.where(f"size >= {SAME}").groupBy("digest").agg(F.min("page").alias("refers"), F.max("page").alias("most")).where("refers < most").drop("most")
    small = own.where(f"size >= {SAME}").select("page", "digest").join(least, "digest").where("page <> refers")
    small = small.select(F.col("page").alias("p"), F.col("digest").alias("d"), "refers").distinct()
    return own.join(small, (F.col("page") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page", "url", "html", "size", "digest", "refers")


def bundles(plan: DataFrame, level: int = 3) -> DataFrame:
    """The archives: one row for each bundle, with the index of its records."""

    def run(batches):
        import uuid

        held, load = [], 0
        for b in chunks(batches, "html", FRAME):
            for row in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "size", "digest", "refers")), strict=True):
                held.append((row[0], record(row[0], row[1], row[2].encode(), row[4], row[3], row[5])))
                load += len(held[-1][1])
                if load >= BUNDLE:
                    yield packed(held, uuid.uuid4().hex)
                    held, load = [], 0
        if held:
            yield packed(held, uuid.uuid4().hex)

    def packed(held, name):
        press = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        out, sizes, frames, places, plain, n = [], [], [], [], [], 0
        for k, (_, data) in enumerate(held):
            frames.append(len(sizes))
            places.append(n)
            plain.append(data)
            n += len(data)
            if n >= FRAME or k == len(held) - 1:
                out.append(press.compress(b"".join(plain)))
                sizes.append((len(out[-1]), n))
                plain, n = [], 0
        columns = [[name], [b"".join([*out, seek_table(sizes)])], [[page for page, _ in held]], [frames], [places]]
        kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bundle", "data", "ids", "frames", "places"])

    return plan.mapInArrow(run, BUNDLES_DDL)


def index(archives: DataFrame) -> DataFrame:
    """(page, bundle, frame, place) of each record."""
    return archives.select("bundle", F.explode(F.arrays_zip("ids", "frames", "places")).alias("r")).select(F.col("r.ids").alias("page"), "bundle", F.col("r.frames").alias("frame"), F.col("r.places").alias("place"))


def lookup(data: bytes, k: int, place: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its frame and place; other frames stay closed."""
    return next(parsed(frame(data, k), place))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record, found through the seek tables. A response's size and digest are those of the payload read."""

    def run(batches):
        for b in batches:
            for data in b.column("data"):
                data = data.as_py()
                open_ = zstandard.ZstdDecompressor()
                for at, size, plain in read_table(data):
                    rows = []
                    for head, payload in parsed(open_.decompress(data[at : at + size], max_output_size=max(plain, 1))):
                        page = int(head["WARC-Record-ID"][10:-1])
                        digest, n, refers = head["WARC-Payload-Digest"][7:], int(head["X-Payload-Length"]), None
                        if head["WARC-Type"] == "response":
                            found = hashlib.sha256(payload).hexdigest()
                            if found != digest or n != len(payload):
                                raise ValueError(f"page {page}: payload does not match its digest")
                        else:
                            refers = int(head["WARC-Refers-To"][10:-1])
                        rows.append((page, head["WARC-Target-URI"], n, digest, head["WARC-Type"], refers, payload if payloads else None))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"])

    return archives.select("data").mapInArrow(run, READ_DDL)


def export(archives: DataFrame, folder: str) -> None:
    """Each bundle as a file <bundle>.warc.zst in a folder that all executors mount."""

    def put(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/{r.bundle}.part", "wb") as f:
                f.write(r.data)
            os.replace(f"{folder}/{r.bundle}.part", f"{folder}/{r.bundle}.warc.zst")

    archives.select("bundle", "data").foreachPartition(put)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    archives = written(bundles(planned(table(spark, sf_dir, "pages"))))
    null = F.lit(NULL_ID)
    return read(archives, payloads=False).select(F.nullif("page", null).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.nullif("refers", null).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest AS pd, min(page_id) AS lead FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM d LEFT JOIN m ON payload_digest = pd
"""
