"""Zstandard web archives: a writer, and a reader that validates.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, and goes on with one frame per
record. The reader loads that dictionary first, decodes one frame at a time, and validates the version line, the
mandatory headers, the content length against the block, the digest of the payload, and the record's end.

Records with equal payloads of at least `least` bytes are stored once: the one with the smallest id is the response,
others are revisits that refer to it. Rows that meet there by a hot payload are joined, which the engine can split.

Archives are files in the shared folder, written by tasks under names of their own attempt and listed in a manifest
table only when complete; what a lost attempt leaves is not listed and so never read.

Defined results: a null payload is empty; null ids are written as responses unless an equal payload has an id; rows
that repeat the smallest id are all responses; ids that repeat are each written; an empty table writes no archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import binary_lists, materialise, scratch_path, small_batches

#: Fixed values of the format.
VERSION, DICTIONARY_MAGIC, FRAME_MAGIC = b"WARC/1.1", 0x184D2A5D, 0xFD2FB528
#: Bytes of the dictionary, and of payloads in one archive, about.
DICTIONARY_BYTES, ARCHIVE_BYTES = 65_536, 64 << 20
DIGEST = re.compile(r"[A-Z2-7]{32}")
EPOCH = "1970-01-01T00:00:00Z"


class BadArchive(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(number))}>"


def record(number: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of the record of that number without it."""
    block = payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(number)),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", re.sub(r"[\r\n\x00]", " ", uri or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Number", "" if number is None else str(number)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To", str(refers_to))]
    headers += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one decoded record; raises BadArchive."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name:
            raise BadArchive(f"bad header {name!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"no {name}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the length does not fit the block")
    block = rest[:-4]
    digest = headers.get("warc-payload-digest", "")
    if digest and not DIGEST.fullmatch(digest.removeprefix("sha1:")):
        raise BadArchive("bad digest")
    if digest and headers["warc-type"] == "response" and digest != f"sha1:{payload_digest(block)}":
        raise BadArchive("the digest does not fit the payload")
    if headers["warc-type"] == "revisit" and not (headers.get("warc-refers-to") or digest):
        raise BadArchive("a revisit without reference")
    return headers, block


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A raw-content dictionary: the heads of distinct payloads, the commonest openings last."""
    seen: dict[bytes, None] = {}
    for s in samples:
        seen.setdefault(s[:2048])
    return b"".join(reversed(list(seen)))[-size:]


def read_records(stream, chunk: int = 1 << 20):
    """Yields (headers, block) of an archive from a file-like object, holding one record at a time."""
    import zstandard

    buffer = b""

    def more() -> bool:
        nonlocal buffer
        got = stream.read(chunk)
        buffer += got
        return bool(got)

    while len(buffer) < 8 and more():
        pass
    if not buffer:
        return
    if len(buffer) < 8:
        raise BadArchive("cut off")
    magic, size = struct.unpack("<II", buffer[:8])
    shared = None
    if magic == DICTIONARY_MAGIC:
        while len(buffer) < 8 + size:
            if not more():
                raise BadArchive("the dictionary is cut off")
        content, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        shared = zstandard.ZstdCompressionDict(content) if content else None
    decompressor = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while True:
        while len(buffer) < 8 and more():
            pass
        if not buffer:
            return
        magic = struct.unpack("<I", buffer[:4].ljust(4, b"\0"))[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            size = struct.unpack("<I", buffer[4:8])[0]
            while len(buffer) < 8 + size:
                if not more():
                    raise BadArchive("a skippable frame is cut off")
            buffer = buffer[8 + size :]
            continue
        if magic != FRAME_MAGIC:
            raise BadArchive("no frame where one must start")
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = b""
            if not more():
                raise BadArchive("a frame is cut off")
        yield parse(b"".join(parts))


def dealt(df: DataFrame, least: int, key: str, payload: str, uri: str) -> DataFrame:
    """number, uri, payload, digest and refers_to of every row."""
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("long").alias("number"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("hex", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    groups = rows.where(F.col("size") >= least).groupBy("hex", "size").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("hex").alias("_hex"), F.col("size").alias("_size"), "first")
    joined = rows.join(groups, (F.col("hex") == F.col("_hex")) & (F.col("size") == F.col("_size")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("number", "uri", "payload", F.unhex("hex").alias("sha1"), refers.alias("refers_to"))


def write_archives(df: DataFrame, folder: str, least: int = 0, key: str = "page_id", payload: str = "html", uri: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row to archives in folder; the manifest: path and records of each archive."""

    def write(batches):
        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        label, number = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0
        out = compressor = None
        held = count = 0

        def manifest():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            sha1, payloads = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for n, (page, url, refers) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"archive-{label}-{number:05d}.warc.zst"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    primed = dictionary(payloads[n : n + 64])
                    out.write(skippable(primed))
                    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(primed), write_checksum=True) if primed else zstandard.ZstdCompressor(level=3, write_checksum=True)
                out.write(compressor.compress(record(page, url, payloads[n], base64.b32encode(sha1[n]).decode(), refers)))
                count, held = count + 1, held + len(payloads[n])
                if held >= archive_bytes:
                    out.close()
                    yield manifest()
                    out, held, count, number = None, 0, 0, number + 1
        if out is not None:
            out.close()
            yield manifest()

    return dealt(df, least, key, payload, uri).mapInArrow(write, "path string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives: its headers of use and its block (null for revisits)."""
    spark = manifest.sparkSession

    def read(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["number", "record_type", "payload_bytes", "payload_digest", "refers_to", "uri", "block"])

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in read_records(stream):
                        revisit = head["warc-type"] == "revisit"
                        number, refers = head.get("x-number", ""), head.get("x-refers-to", "")
                        size = int(head["x-payload-length"]) if revisit else len(block)
                        found.append((int(number) if number else None, head["warc-type"], size, head["warc-payload-digest"].removeprefix("sha1:"), int(refers) if refers else None, head.get("warc-target-uri"), None if revisit else block))
                        held, n = held + len(block), n + 1
                        if held > 4 << 20 or len(found) >= 2000:
                            yield rows(found)
                            found, held = [], 0
                if found:
                    yield rows(found)
                if n != records:
                    raise BadArchive(f"{name} holds {n} records, not {records}")

    spread = manifest.repartition(max(1, spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(read, "number long, record_type string, payload_bytes long, payload_digest string, refers_to long, uri string, block binary")


def round_trip(df: DataFrame, least: int = 0, key: str = "page_id", payload: str = "html", uri: str = "url") -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    folder = scratch_path(df.sparkSession, "warc")
    manifest = materialise(write_archives(df, folder, least, key, payload, uri), "manifest")
    return read_archives(manifest, folder)
