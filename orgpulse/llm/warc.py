"""WARC archives with dictionary compression.

Each archive is one file: a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from the archive's own records, then one frame for each record, so a
record can be read alone. Payloads that equal an earlier-listed one are written as
revisit records.

A null payload is an empty one. Among equal payloads of at least ``min_revisit`` bytes the
row with the largest id is the response; rows that tie for it are all responses, and rows
without an id are revisits of it (responses, if no row has one). A null URL is written as
an empty one. A URL is written as it is; one with line breaks, which a header can't hold, is
percent-encoded and marked by a header of its own. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.session import cut_lineage

MAGIC = 0x184D2A5D
ESCAPED = "X-Target-URI-Escaped"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of records in one archive, records and bytes of each that the dictionary is built from, and its size.
ARCHIVE_BYTES = 16 << 20
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 16 << 10, 64 << 10


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit has the HTTP header of the response but not its payload."""
    uri = url or ""
    broken = "\r" in uri or "\n" in uri
    if broken:
        uri = uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if broken:
        lines.append(f"{ESCAPED}: line-breaks")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record. For a revisit the length comes from the HTTP header and there is no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(v) if (v := fields.get(name, "")[10:-1]) else None
    response = fields["WARC-Type"] == "response"
    uri = fields["WARC-Target-URI"]
    if ESCAPED in fields:
        uri = uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": number("WARC-Record-ID"), "url": uri, "record_type": fields["WARC-Type"], "payload_bytes": length,
            "payload_digest": fields["WARC-Payload-Digest"][5:], "refers_to": number("WARC-Refers-To"), "payload": payload if response else None}


def build_archive(records: list[bytes]) -> bytes:
    """An archive file of the given records."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too few or too small records to train on: their own bytes serve as raw content
        trained = b"".join(samples)[-DICTIONARY_BYTES:]
    packed = zstandard.ZstdCompressor(level=9).compress(trained)
    write = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True).compress
    return struct.pack("<II", MAGIC, len(packed)) + packed + b"".join(map(write, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at a place ends, from its header and block headers."""
    header = zstandard.get_frame_parameters(data[at : at + 18])
    place = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        block = int.from_bytes(data[place : place + 3], "little")
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return place + 4 * header.has_checksum


def read_archive(data: bytes) -> Iterator[bytes]:
    """Records of an archive file, one at a time."""
    view = memoryview(data)
    magic, size = struct.unpack("<II", view[:8])
    if magic != MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    trained = zstandard.ZstdDecompressor().decompress(view[8 : 8 + size])
    read = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)).decompress
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        yield read(view[at:end])
        at = end


def mark_revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, payload and refers_to: null for responses. The payload itself takes no part in the grouping."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keys = known.where(F.length("payload") >= min_revisit).select(F.sha2("payload", 256).alias("content"), "page_id")
    firsts = keys.groupBy("content").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    content = F.when(F.length("payload") >= min_revisit, F.sha2("payload", 256))
    joined = known.withColumn("content", content).join(firsts.drop("n"), "content", "left").drop("content")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages under a folder that all executors reach (any store Arrow opens) and returns path, n_records and n_bytes of the archives.

    They are written when this is called. A file is written under a name of its own attempt and only counts if it is in the returned
    list, so a task that is run again or twice adds nothing to what is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        records: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = build_archive(records)
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(name, compression=None) as out:
                out.write(data)
            done = pa.RecordBatch.from_pydict({"path": [name.rsplit("/", 1)[1]], "n_records": [len(records)], "n_bytes": [len(data)]})
            records.clear()
            return done

        for batch in batches:
            for start in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[start].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                records.append(record_bytes(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to, date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    size = 0
        if records:
            yield flush()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return cut_lineage(mark_revisits(pages, min_revisit).mapInArrow(write, "path string, n_records long, n_bytes long"))


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """Records of the listed archives of a folder, one row each. Digest and length of a response are checked against its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in read_archive(content.as_buffer()):
                    row = parse_record(record)
                    if row["payload"] is not None and (len(row["payload"]), hashlib.sha1(row["payload"]).hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
                        raise ValueError(f"record {row['page_id']} is damaged")
                    rows.append(row)
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.substring_index("path", "/", -1).alias("path"), "content")
    return named.join(archives.select("path"), "path", "left_semi").select("content").mapInArrow(read, READ)
