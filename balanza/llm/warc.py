"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames. A bundle ends with the seek table of the
Zstandard seekable format (a skippable frame that lists compressed and plain frame sizes), so
ordinary tools can read it too. An index table maps each record to (bundle, frame, place in
the frame); where a frame lies is read from the bundle's own seek table, so one record costs
a read of the footer and one ranged read of one frame.

Bundles are written and read by tasks through the file system that the folder's URI names, so
the folder must be one that all executors share.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from balanza.llm.common import bounded_batches
from balanza.session import scratch_path, spread

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
LEAST_REVISIT = 100
#: Records without a date of their own carry this one, so that equal input gives equal archives.
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame int, place int, length int"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    width = 12 if descriptor & 0x80 else 8
    source.seek(size - 9 - width * count)
    table, start, out = source.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, width * i)
        out.append((start, packed, plain))
        start += packed
    return out


def record(kind: str, name: str, uri: str, digest: str, payload: bytes, full: int, refers: str | None) -> bytes:
    """One WARC record; ``full`` is the size of the whole payload, which a revisit leaves out."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {full}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Appends records to frames, frames to a bundle, and yields index rows as frames close."""

    def __init__(self, folder: str):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.root, self.folder = root, folder
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.out, self.name, self.frames, self.written = None, "", [], 0
        self.waiting: list[tuple[str, int, int]] = []
        self.plain = bytearray()

    def add(self, name: str, data: bytes) -> list[tuple]:
        rows = self.close_frame() if self.plain and len(self.plain) + len(data) > FRAME_BYTES else []
        self.waiting.append((name, len(self.plain), len(data)))
        self.plain += data
        return rows

    def close_frame(self) -> list[tuple]:
        if not self.plain:
            return []
        if self.out is None:
            # A repeated or speculative task gets a name of its own; the index names only what counts.
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.frames, self.written = [], 0
        packed = self.packer.compress(bytes(self.plain))
        self.out.write(packed)
        rows = [
            (name, self.name, len(self.frames), place, length) for name, place, length in self.waiting
        ]
        self.frames.append((len(packed), len(self.plain)))
        self.written += len(packed)
        self.waiting, self.plain = [], bytearray()
        if self.written >= BUNDLE_BYTES:
            self.close_bundle()
        return rows

    def close_bundle(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None

    def finish(self) -> list[tuple]:
        rows = self.close_frame()
        self.close_bundle()
        return rows


def plan_records(pages: DataFrame) -> DataFrame:
    """(record_id, uri, kind, refers_id, digest, full, payload) of each page.

    A null html is an empty payload, a null url an empty one; equal ids are all written. Among
    payloads of at least ``LEAST_REVISIT`` bytes that are equal, all rows with the smallest
    page_id are responses and the others revisit it; a null page_id is larger than any other.
    Other columns are not read, and an empty table gives no rows.
    The join's small side is one row for each payload that occurs again, and Spark broadcasts it
    only if it is below its own size limit.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("uri"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("full"),
    )
    again = (
        rows.where(F.col("full") >= LEAST_REVISIT)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & F.col("first").isNotNull())
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(again, (F.col("digest") == F.col("of")) & (F.col("full") >= LEAST_REVISIT), "left").select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        "uri",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_id"),
        "digest", "full",
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write bundles of ``plan_records`` rows into ``folder``; returns the index, kept as Parquet beside them.

    A task without records writes no bundle, and an empty table gives an empty index. Other
    columns of ``records`` are not written.
    """
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, names = BundleWriter(f"{folder}/bundles"), [f.split()[0] for f in INDEX.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for name, uri, kind, refers, digest, full, payload in zip(*columns):
                uri = uri.as_py().replace("\r", "%0D").replace("\n", "%0A")
                data = record(kind.as_py(), name.as_py(), uri, digest.as_py(), payload.as_py(), full.as_py(), refers.as_py())
                rows += writer.add(name.as_py(), data)
            if rows:
                yield table(rows)
        if rows := writer.finish():
            yield table(rows)

    index = f"{folder}/index"
    columns = ("record_id", "uri", "kind", "refers_id", "digest", "full", "payload")
    records.select(*columns).mapInArrow(run, INDEX).write.mode("errorifexists").parquet(index)
    return records.sparkSession.read.schema(INDEX).parquet(index)


READ = "record_id string, kind string, refers_id string, uri string, digest string, full bigint, payload binary"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` lists, read back by ranged reads of single frames.

    Any subset of an index does; each frame is read once by the task that holds its rows, at the
    place that the footer of its bundle gives.
    Records of one frame meet in one task (a frame holds few records or one large one). An index
    row is small but stands for much work, so the number of tasks is given, not left to sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(f"{folder}/bundles")
        names, unpack = [f.split()[0] for f in READ.split(", ")], zstandard.ZstdDecompressor()
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for batch in batches:
            rows = [(r["bundle"], r["frame"], r["places"]) for r in batch.to_pylist()]
            for bundle, frames in groupby(rows, key=lambda r: r[0]):
                with files.open_input_file(f"{root}/{bundle}") as source:
                    table = read_seek_table(source)
                    for _, frame, places in frames:
                        start, packed, plain = table[frame]
                        source.seek(start)
                        data = unpack.decompress(source.read(packed), max_output_size=plain)
                        out = []
                        for spot in places:
                            headers, payload = parse_record(data[spot["place"] : spot["place"] + spot["length"]])
                            refers = headers.get("warc-refers-to")
                            out.append((
                                headers["warc-record-id"][1:-1], headers["warc-type"], refers and refers[1:-1],
                                headers["warc-target-uri"], headers["warc-payload-digest"].partition(":")[2],
                                int(headers["x-payload-length"]), payload,
                            ))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    frames = (
        spread(index, "bundle", "frame").groupBy("bundle", "frame")
        .agg(F.collect_list(F.struct("place", "length")).alias("places"))
        .sortWithinPartitions("bundle", "frame")
    )
    return frames.mapInArrow(run, READ)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and digest what was read.

    One row per page, repeated ids included; an empty table gives none. Other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    back = read_archives(write_archives(plan_records(pages), folder), folder)
    page = F.substring("record_id", len("urn:page:") + 1, 40)
    response = F.col("kind") == "response"
    return back.select(
        F.when(page != "null", page.cast("long")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("full")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.substring("refers_id", len("urn:page:") + 1, 40).cast("long").alias("refers_to"),
    )
