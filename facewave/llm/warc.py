"""WARC archives in seekable Zstandard bundles (operator 7).

Every page becomes a WARC/1.1 record. Of records with equal payloads the one with the largest id is the response; the
others are revisits that refer to it and hold no payload. Records are grouped into frames that are compressed on their own; a
bundle is a run of frames with a seek table in a skippable frame at its end, so a reader gets any frame with two reads. The
index maps each record id to bundle, frame and the offset within the frame.

Bundles are files below a folder that all machines reach, one or more for each task, with the task attempt in their name: a
task that is run again writes new files, and the index names only those of the attempt that counted.

Defined results: null html is an empty payload, and empty payloads are equal payloads like others; a null url is left out
of the record; rows with a null id are left out, as a record must have one; repeated rows give repeated records of one type;
an empty table writes no bundle and gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facewave.llm._shared import shared_folder, stored

# Fixed values of the seekable Zstandard format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~-._' + chr(39))}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at an offset: WARC fields, HTTP head, payload, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    head, _, payload = data[start:stop].partition(b"\r\n\r\n")
    return fields, head, payload, stop + 4


class Bundle:
    """Writes frames, then the seek table."""

    def __init__(self, path: str, level: int) -> None:
        system, name = fs.FileSystem.from_uri(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.path, self.out, self.pack = path, system.open_output_stream(name, compression=None), zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.size = 0

    def frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw)))
        self.size += len(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str) -> None:
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.sizes, self.starts = sizes, [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles below ``folder`` and returns the index (page_id, bundle, frame, offset, length). Payloads of
    fewer than ``least`` bytes are never revisits."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    # ids and digests alone find the groups; the payloads move once, by id
    brief = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    last = brief.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to")
    revisits = brief.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    joined = rows.join(revisits, ["page_id", "digest"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}"
        bundle, many = None, 0
        raw: list[bytes] = []
        waiting: list[tuple[int, int, int]] = []
        at = 0
        done: list[tuple] = []

        def flush() -> None:
            nonlocal bundle, many, at
            if not raw:
                return
            if bundle is None:
                bundle = Bundle(f"{stem}-{many:04d}.warc.zst", level)
                many += 1
            done.extend((i, bundle.path, len(bundle.table), o, n) for i, o, n in waiting)
            bundle.frame(b"".join(raw))
            raw.clear()
            waiting.clear()
            at = 0
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None

        for batch in batches:
            for page, address, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = record(page, address, body.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers, date)
                if at and at + len(out) > frame_bytes:
                    flush()
                raw.append(out)
                waiting.append((page, at, len(out)))
                at += len(out)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
                done.clear()
        flush()
        if bundle:
            bundle.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

    return stored(joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, INDEX), "index")


RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload string"


def _row(data: bytes, at: int) -> tuple:
    fields, head, payload, _ = parse(data, at)
    number = lambda x: int(re.search(r"urn:page:(-?\d+)", x)[1]) if x else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload does not have its digest")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size, digest, fields.get("WARC-Target-URI"), None if revisit else payload.decode()


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index point to. Rows are brought together by bundle and frame, so each frame that is
    asked for is read and unpacked once; a whole index reads the whole archive, a few rows read a few frames."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))  # bounded by the frame's bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for bundle, frame, offsets in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if bundle != path:
                    reader, path = Reader(bundle), bundle
                data = reader.frame(frame)
                rows = [_row(data, at) for at in sorted(offsets)]
                columns = list(zip(*rows, strict=True))
                if not payloads:
                    columns[-1] = (None,) * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return frames.mapInArrow(work, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write(pages, f"{shared_folder(spark)}/warc")
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
