"""Operator 7, WARC in seekable Zstandard bundles.

Pages become WARC records. Of records with equal payloads of at least ``MIN_REVISIT`` bytes the
one with the largest id is the response and the others revisit it. Records are grouped into frames
that are compressed independently, so a reader can start at any of them; a bundle ends with the
seek table of the seekable Zstandard format (a skippable frame that lists the frames' sizes, with its
magic number at the very end). The index maps a record's id to its bundle, frame and place in the frame.

Spark deals the records to tasks; a task writes bundles of bounded size into the shared folder, under
names of its attempt's own. The index is checkpointed, and it alone says which bundles there are: what an attempt
left that died, was run again or lost a race is named by no row and never read. Tasks read back the bundles
that the index names, frame by frame, as their seek tables say.

Equal payloads are found by their SHA-256. Ids and hashes only are grouped, with a map-side combine;
pages move once, by (page_id, hash), of which a group of copies holds many.

Defined results: null html is an empty payload (never a revisit); a null page_id is smaller than any
other and has the record id ``urn:page:``; among repeated rows one is the response; a null url leaves out the
target; an empty table gives no bundles and an empty result; pages of any length are one record, which may
be a frame of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.common import checkpoint_dir, cut_lineage, ship

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
# fixed values of the seekable format
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time
INDEX = ("page_id long, bundle string, frame int, frame_at long, record_at long, record_bytes long, type string")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One WARC record. A revisit has no payload, but its length and digest."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            f"WARC-Record-ID: <{_uri(page_id)}>".encode(), f"WARC-Date: {DATE}".encode(),
            f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Payload-Length: {len(payload)}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~").encode())
    if revisit:
        head += [f"WARC-Refers-To: <{_uri(refers_to)}>".encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(b"Content-Type: application/http; msgtype=response")
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records that a frame holds."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record here")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, raw[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer of (compressed, plain) frame sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of a bundle's frames, from its footer."""
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    begin, at, out = len(raw) - 9 - count * width, 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", raw, begin + k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_one(raw: bytes, frame: int, record_at: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """The record at a place of a frame; no other frame is decompressed."""
    at, packed, plain = frames_of(raw)[frame]
    body = zstandard.ZstdDecompressor().decompress(raw[at:at + packed], max_output_size=plain)
    return next(read_records(body[record_at:record_at + record_bytes]))


class BundleWriter:
    """Collects records to frames, and frames to a bundle."""

    def __init__(self, level: int = 3):
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.clear()

    def clear(self) -> None:
        self.body, self.sizes, self.frame, self.rows = [], [], bytearray(), []
        self.at = 0

    def add(self, page_id: int | None, kind: str, record: bytes) -> None:
        self.rows.append((page_id, len(self.sizes), self.at, len(self.frame), len(record), kind))
        self.frame += record
        if len(self.frame) >= FRAME_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.frame:
            packed = self.pack(bytes(self.frame))
            self.body.append(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.at += len(packed)
            self.frame = bytearray()

    def finish(self) -> bytes:
        self.cut()
        return b"".join(self.body) + seek_table(self.sizes)


def _store(folder: str):
    """(file system, path) of the shared folder, which may be a URI of any store that Arrow knows."""
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Pages with digest, payload and what they refer to (revisit, refers_to)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("hash", F.unhex(F.sha2("payload", 256))).withColumn("idnull", F.col("page_id").isNull()).withColumn(
        "id", F.coalesce("page_id", F.lit(0)))
    large = keyed.where(F.octet_length("payload") >= min_bytes).select("hash", "page_id", "id", "idnull")
    tops = large.groupBy("hash").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = large.distinct().join(tops, "hash").select("hash", "id", "idnull", "top", "copies")
    met = keyed.join(copies, ["hash", "id", "idnull"], "left")
    nth = F.row_number().over(Window.partitionBy("hash", "id", "idnull").orderBy("hash"))
    stays = F.col("page_id").eqNullSafe(F.col("top")) & (nth == 1)
    revisit = F.col("copies").isNotNull() & ~stays
    return met.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), revisit.alias("revisit"),
                      F.when(revisit, F.col("top")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write all pages as bundles into a shared folder; the index of the records, checkpointed."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        context, attempt, writer, made = TaskContext.get(), uuid4().hex, BundleWriter(), 0
        columns = ["page_id", "frame", "frame_at", "record_at", "record_bytes", "type"]

        def close() -> pd.DataFrame:
            nonlocal made
            name = f"bundle-{context.partitionId():06d}-{made:05d}-{attempt}.warc.zst"
            made += 1
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(writer.finish())
            index = pd.DataFrame(writer.rows, columns=columns).astype({"page_id": "Int64"})
            writer.clear()
            return index.assign(bundle=name)

        for frame in frames:
            for page_id, url, payload, digest, revisit, refers in frame.itertuples(index=False, name=None):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                record = write_record(page_id, url, bytes(payload), digest, refers, revisit)
                writer.add(page_id, "revisit" if revisit else "response", record)
                if writer.at + len(writer.frame) >= BUNDLE_BYTES:
                    yield close()
        if writer.rows:
            yield close()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return cut_lineage(marked(pages, min_bytes).mapInPandas(run, INDEX))


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """One row per record of the bundles that an index names, payload lengths and digests taken from the payloads read."""
    ship(spark)
    number = re.compile(r"urn:page:(-?\d*)")

    def page(value: str) -> int | None:
        digits = number.search(value)[1]
        return int(digits) if digits else None

    def parse(raw: bytes) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for at, packed, plain in frames_of(raw):
            for headers, block in read_records(unpack.decompress(raw[at:at + packed], max_output_size=plain)):
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size, refers = int(headers["WARC-Payload-Length"]), None
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload isn't what was written")
                else:
                    refers = page(headers["WARC-Refers-To"])
                yield page(headers["WARC-Record-ID"]), size, digest, kind, refers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for frame in frames:
            for name in frame["bundle"]:
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    raw = f.read()
                rows = pd.DataFrame(list(parse(raw)), columns=[x.split()[0] for x in RECORDS.split(", ")])
                yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.select("bundle").distinct().repartition(n).mapInPandas(run, RECORDS)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write all pages to bundles and read them back: one row per page."""
    spark = pages.sparkSession
    folder = folder or os.path.join(checkpoint_dir(spark), f"warc-{uuid4().hex}")
    index = write_bundles(pages, folder, min_bytes)
    if index.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_bundles(spark, folder, index)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             octet_length(payload) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY payload) AS again,
             max(page_id) OVER (PARTITION BY payload) AS top
      FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM s
"""
