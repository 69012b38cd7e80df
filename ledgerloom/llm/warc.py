"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole records
(the first the bundle's warcinfo), and a skippable frame with the seek table as its footer. An index maps each
record to its bundle, its frame and its place inside the frame; a reader seeks
by the footer and unpacks single frames.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path, written

#: Fixed values of the seekable format and its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame of (compressed, decompressed) sizes and a 9-byte end."""
    body = b"".join(struct.pack("<II", *f) for f in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the end of an open bundle."""
    end = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    table = file.read_at(n * width, end - 9 - n * width)
    out, at = [], 0
    for i in range(n):
        size = struct.unpack_from("<I", table, i * width)[0]
        out.append((at, size))
        at += size
    return out


def _framed(fields: list[str], block: bytes) -> bytes:
    """One WARC/1.1 record of header lines and a block."""
    return "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    """The record that opens a bundle."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    return _framed([*head, f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id, url: str | None, kind: str, payload: bytes, digest: str, refers_to, length: int, date: str) -> bytes:
    """One record whose block is an HTTP response; a revisit's has the head only and names the response with the payload."""
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'' if url is None else ''.join(' ' if c in '\r\n' else c for c in url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if kind == "revisit":
        return _framed([*head, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"], block)
    return _framed(head, block + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload: of an HTTP response what follows its head, else the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http = fields.get("Content-Type", "").startswith("application/http")
    return fields, block.partition(b"\r\n\r\n")[2] if http else block


def _page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def qualified(spark: SparkSession, base: str) -> str:
    """The folder as Spark itself would name it: a path without a scheme lies in the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(base: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and folder of a qualified name."""
    if base.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + base.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(base)


class _Bundle:
    """Writes one bundle; its name is unique, so a repeated task never meets the file of another attempt."""

    def __init__(self, base: str, date: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store, folder = _open(base)
        store.create_dir(folder, recursive=True)
        self.out = store.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        first = info(self.name, date)
        packed = self.packer.compress(first)
        self.out.write(packed)
        self.frames = [(len(packed), len(first))]
        self.held, self.size, self.written = [], 0, len(packed)

    def add(self, page_id, data: bytes) -> None:
        self.held.append((page_id, self.size, data))
        self.size += len(data)

    def flush(self) -> dict | None:
        if not self.held:
            return None
        packed = self.packer.compress(b"".join(d for _, _, d in self.held))
        self.out.write(packed)
        row = {
            "bundle": self.name,
            "frame": len(self.frames),
            "page_ids": [p for p, _, _ in self.held],
            "offsets": [o for _, o, _ in self.held],
            "lengths": [len(d) for _, _, d in self.held],
        }
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0
        return row

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


INDEX = "bundle string, frame int, page_ids array<long>, offsets array<long>, lengths array<long>"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES, fetched: str | None = None) -> DataFrame:
    """Add payload, digest, length, ``fetched`` and ``response``: the largest page_id of equal payloads of enough bytes.

    ``fetched`` names the timestamp column of the fetch, if there is one.
    Only (digest, page_id) is aggregated; the payloads meet the few digests
    that repeat by an equi-join, whose hot keys adaptive execution splits.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        (F.date_format(F.to_utc_timestamp(fetched, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if fetched else F.lit(None).cast("string")).alias("fetched"),
    ).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    twice = (
        slim.filter(F.col("length") >= least_bytes)
        .groupBy("digest", "length")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and response is not null")
        .drop("n")
    )
    return slim.join(twice, ["digest", "length"], "left")


def write_bundles(records: DataFrame, base: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records below ``base``, a folder that all executors share; returns the index, a row per frame.

    The index is written with the bundles and names only those of tasks that
    ended well; what a lost attempt leaves behind is never read. Records whose
    time of fetch is unknown are dated by the start of the writing. All
    dates are in UTC.
    """
    base = qualified(records.sparkSession, base)
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, rows = None, []
        for pdf in frames:
            for x in pdf.itertuples(index=False):
                page = None if pd.isna(x.page_id) else int(x.page_id)
                first = None if pd.isna(x.response) else int(x.response)
                again = first is not None and page != first
                bundle = bundle or _Bundle(base, now)
                date = now if pd.isna(x.fetched) else x.fetched
                kind = "revisit" if again else "response"
                bundle.add(page, record(page, x.url, kind, bytes(x.payload), x.digest, first, int(x.length), date))
                if bundle.size >= frame_bytes:
                    rows.append(bundle.flush())
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
            if rows:
                yield pd.DataFrame(rows)
                rows = []
        if bundle:
            if row := bundle.flush():
                rows.append(row)
            bundle.close()
        if rows:
            yield pd.DataFrame(rows)

    return written(records.mapInPandas(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, base: str) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of every indexed record.

    A response's digest and length come from the payload itself; a revisit's
    from its header.
    """
    base = qualified(index.sparkSession, base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = _open(base)
        unpack, name, file, table = zstandard.ZstdDecompressor(), None, None, []
        for pdf in frames:
            for x in pdf.itertuples(index=False):
                if x.bundle != name:
                    name, file = x.bundle, store.open_input_file(f"{folder}/{x.bundle}")
                    table = read_seek_table(file)
                offset, size = table[x.frame]
                data = unpack.decompress(file.read_at(size, offset))
                out = []
                for at, length in zip(x.offsets, x.lengths):
                    fields, payload = parse(data[at : at + length])
                    again = fields["WARC-Type"] == "revisit"
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest = said if again else hashlib.sha1(payload).hexdigest()
                    if digest != said:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    out.append(
                        (
                            _page(fields["WARC-Record-ID"]),
                            fields["WARC-Target-URI"],
                            fields["WARC-Type"],
                            digest,
                            int(fields["X-Payload-Length"]) if again else len(payload),
                            _page(fields["WARC-Refers-To"]) if again else None,
                            payload,
                        )
                    )
                made = pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return index.mapInPandas(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A NULL html is an empty payload. Rows that repeat the response's page_id
    are responses too; a NULL page_id never is the response that others name.
    A NULL url reads back as an empty one. An empty table gives no rows.
    """
    base = scratch_path(pages.sparkSession, "warc")
    index = write_bundles(with_revisits(pages), base)
    return read_bundles(index, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
