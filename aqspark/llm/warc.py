"""Dictionary-compressed web archives.

Pages become WARC 1.1 records. A task fills archives of bounded size; for each
it builds a Zstandard dictionary from (at most ``SAMPLE_BYTES`` of) the
archive's own records, writes the dictionary in a leading skippable frame and
compresses every record as a frame of its own, so a reader needs the file alone
and can start at any record. Payloads seen before are written as revisit
records that name the record with the smallest page id.

Archives are written under a name of their own for each attempt and renamed
when complete; the stored manifest names the archives of the attempts that
counted, and only those are read. The folder can be any that the executors'
Arrow library opens (local or mounted paths, HDFS, S3).

Defined results: null html is an empty payload; equal payloads of at least
``min_bytes`` are one response (all rows with the smallest page id, if it is
repeated) and revisits; a null page id is written as an empty field and is the
response only if all ids of its payload are null; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark.session import ensure_checkpoint_dir, settle

SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the frame that holds the dictionary
ARCHIVE_BYTES = 16 << 20  # of records, before compression
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
MAX_READERS = 10_000  # tasks that read archives
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages hold no date of capture
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
CRLF = b"\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sha1_column(payload):
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the response's headers but not its payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + x)}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + CRLF + CRLF


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; for a revisit the payload is empty. A damaged record raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if version != "WARC/1.1" or end != CRLF + CRLF:
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
    if fields["WARC-Type"] == "response" and (len(payload) != int(fields["payload_bytes"]) or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError("payload does not match its digest")
    return fields, payload


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on a spread of the records; where they are too few for training, made of their text."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:65536] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The skippable frame with the dictionary, then a frame for each record."""
    known = dictionary(records)
    raw = known.as_bytes()
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        yield writer.compress(r)


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive read from a binary file object, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdCompressionDict(source.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(1 << 16)
            if not rest:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def assigned(pages: DataFrame, id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Pages with payload digest and, for revisits, the page they refer to."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{url}`").cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", sha1_column(F.col("_payload")))
    keys = rows.where(F.octet_length("_payload") >= min_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    several = settle(keys.where("_n > 1").drop("_n"))
    rows = rows.join(several, "_digest", "left")
    return rows.withColumn("_refers", F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))).drop("_first")


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder``; returns the stored manifest (path, records)."""
    rows = assigned(pages, id, url, html, min_bytes).select(F.col("_id").cast("string"), "_url", "_payload", "_digest", "_refers")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context, n = TaskContext.get(), 0

        def close(records: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            path = f"{base}/{context.partitionId():06d}-{n:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
            n += 1
            with fs.open_output_stream(path + ".part", compression=None) as out:
                for frame in archive(records):
                    out.write(frame)
            fs.move(path + ".part", path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(records)], pa.int64())})

        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, link, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                held.append(record(page or "", link or "", payload, digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return settle(rows.mapInArrow(run, "path string, records bigint"))


def read(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Records of the archives a manifest names: page_id, url, payload (empty for revisits), and what the query returns."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_stream(path, compression=None) as source:
                    rows, held, seen = [], 0, 0
                    for raw in read_archive(source):
                        fields, payload = parsed(raw)
                        rows.append((fields["X-Page-ID"] or None, fields["WARC-Target-URI"], payload, int(fields["payload_bytes"]),
                                     fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")))
                        held, seen = held + len(payload), seen + 1
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    if seen != records:
                        raise ValueError(f"{path} holds {seen} records of {records}")

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    spread = manifest.repartition(max(1, min(manifest.count(), MAX_READERS)))
    out = spread.mapInArrow(run, "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, shared by all executors."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base.startswith("file:"):  # one of the forms of a local path, which Arrow writes with three slashes
        base = "file:///" + base.removeprefix("file:").lstrip("/")
    return f"{base}/archives-{uuid.uuid4()}"
