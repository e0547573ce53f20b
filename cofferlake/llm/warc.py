"""WARC archives compressed with Zstandard.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or not, then one
frame per record. Each writing task rotates to a new archive after ``ROTATE`` bytes of records and trains every
archive's dictionary on that archive's own first records, so nothing passes through the driver. Archives get names
of their own; the rows that a task returns list them, and only listed archives are read, so files that a lost or
repeated task left behind do no harm. The reader takes whole archives through Spark's binary files, loads the
dictionary, decodes frame by frame and validates version line, mandatory fields, lengths and digests.

Payloads that occur more than once are written once, by the row with the least page_id; the other rows become revisit
records that refer to it.

Cases: null html is an empty payload, and all empty payloads are equal; rows that repeat the least page_id of a
payload are all responses; a null page_id never is the least unless no row of the payload has one, and then all those
rows are responses; a null url becomes ``urn:page:<page_id>``; an empty table gives no archives and no rows; further
columns are ignored. Damaged archives give rows whose ``error`` is set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise, scratch_path

#: Bytes of records in one archive, size of a dictionary, bytes of records that train it.
ROTATE, DICTIONARY, TRAINING = 24 << 20, 16 << 10, 1 << 20
#: Repeated payloads whose table (some 60 bytes a row) may be broadcast.
SMALL = 200_000
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
_ZSTD = b"\x28\xb5\x2f\xfd"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_response: bool, date: str) -> bytes:
    digest = base32_sha1(payload)
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if is_response:
        block = _HTTP + payload
    else:
        block = b""
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", str(first))]
    fields += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary, or the first record's bytes where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, level=3).as_bytes()
    except zstandard.ZstdError:
        return records[0][:DICTIONARY] or b"WARC/1.1"


def _open(path: str):
    """Output stream in any store that pyarrow knows."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name, compression=None)


class _Archive:
    def __init__(self, path: str):
        self.path, self.waiting, self.size, self.records, self.out = path, [], 0, 0, None

    def _start(self) -> None:
        dictionary = dictionary_of(self.waiting)
        stored = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self.out = _open(self.path)
        self.out.write(SKIPPABLE + len(stored).to_bytes(4, "little") + stored)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for record in self.waiting:
            self.out.write(self.packer.compress(record))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.out is None:
            self.waiting.append(record)
            if self.size >= TRAINING:
                self._start()
        else:
            self.out.write(self.packer.compress(record))

    def close(self) -> tuple[str, int]:
        if self.out is None:
            self._start()
        self.out.close()
        return self.path, self.records


def _writer(folder: str, date: str):
    def run(batches):
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, archive = [], None
        for batch in batches:
            for page_id, url, html, first, is_response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "is_response")), strict=True):
                if archive is None:
                    archive = _Archive(f"{folder}/{stem}-{len(done):05d}.warc.zst")
                archive.add(make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, is_response, date))
                if archive.size >= ROTATE:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the result lists the archives (path, records)."""
    spark = pages.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("digest"))
    repeated = pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = materialise(repeated, "repeated")
    # A counted small table goes to the pages. A larger one makes them travel by digest; Spark splits hot digests then.
    small = repeated.limit(SMALL + 1).count() <= SMALL
    rows = pages.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    is_response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "first", is_response.alias("is_response"))
    return materialise(rows.mapInArrow(_writer(folder.rstrip("/"), date), "path string, records long"), "archives")


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record; raises ValueError where the record is not valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:40]}")
        fields[name.strip()] = value.strip()
    if missing := [k for k in _MANDATORY if k not in fields]:
        raise ValueError(f"missing fields: {missing}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("length of the block differs from Content-Length")
    block = rest[:-4]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    payload = block
    if fields["WARC-Type"] == "response" and block.startswith(b"HTTP/"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest != base32_sha1(payload):
        raise ValueError("payload digest differs")
    number = lambda k: int(fields[k]) if k in fields else None
    is_revisit = fields["WARC-Type"] == "revisit"
    if is_revisit and not fields.get("WARC-Refers-To"):
        raise ValueError("a revisit that refers to nothing")
    size = number("X-Payload-Length") if is_revisit else len(payload)
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "url": fields.get("WARC-Target-URI"), "payload": None if is_revisit else payload, "error": None}


def frames(archive: bytes, piece: int = 8 << 10) -> Iterator[bytes]:
    """Content of each frame after the leading dictionary."""
    if archive[:4] != SKIPPABLE or len(archive) < 8:
        raise ValueError("no leading dictionary frame")
    at = 8 + int.from_bytes(archive[4:8], "little")
    stored = archive[8:at]
    if len(archive) < at:
        raise ValueError("dictionary frame is cut short")
    dictionary = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == _ZSTD else stored
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    view = memoryview(archive)
    while at < len(archive):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("last frame is cut short")
            part = view[at : at + piece]
            parts.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield b"".join(parts)


def _reader(with_payload: bool):
    def rows(archive: bytes) -> Iterator[dict]:
        blank = dict.fromkeys(RECORD.names)
        try:
            for data in frames(archive):
                try:
                    row = parse_record(data)
                except ValueError as e:
                    row = blank | {"error": str(e)}
                yield row if with_payload else row | {"payload": None}
        except (ValueError, zstandard.ZstdError) as e:
            yield blank | {"error": str(e)}

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                waiting, size = [], 0
                for row in rows(content.as_py()):
                    waiting.append(row)
                    size += len(row["payload"] or b"")
                    if len(waiting) == 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(waiting, RECORD)
                        waiting, size = [], 0
                if waiting:
                    yield pa.RecordBatch.from_pylist(waiting, RECORD)

    return run


def read_archives(spark: SparkSession, folder: str, listed: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``folder``; with ``listed``, of those archives only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if listed is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(listed.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_semi")
    return files.select("content").mapInArrow(_reader(with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    listed = write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, listed, with_payload=False)
