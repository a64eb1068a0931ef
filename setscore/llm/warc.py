"""WARC archives with dictionary-compressed records (.warc.zst).

Every task writes one archive: a Zstandard dictionary trained on its first records, embedded in a
leading skippable frame, then every record as a frame of its own. Equal payloads are stored once:
the record with the smallest page_id is a response, the others are revisits of it. To find them,
only digests are grouped (pre-aggregated); a page meets its group in a join that Spark splits where
a payload is hot.

Archives are written below the shared folder under names that no other attempt uses, and only those
in the written manifest count, so lost executors and repeated tasks leave nothing that is read.
Reading streams each archive frame by frame.

Nulls: a null html is an empty payload; a null url is an empty one; a null page_id writes none and
reads back null, and its record is a revisit unless its payload has no page_id at all. Repeated rows
of a page are records of their own, of the same type. An empty table writes no archive. Other
columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscore.llm.common import materialise, shared_folder, table

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20       # of first records that a dictionary is trained on
LEVEL = 6
READ_BYTES = 1 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header, with the payload's length, but no payload."""
    # an id of the page's own in the record's id keeps it findable by other records
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary trained on sample records, or, where they are too few to train on, their own bytes."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        try:
            return zstd.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstd.ZstdError:
            pass                 # samples that are too alike
    return zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def write_archive(records, sink) -> tuple[int, int]:
    """Write an iterator of records; (records, bytes) written."""
    first, size = [], 0
    records = iter(records)
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    d = dictionary(first)
    raw = d.as_bytes()
    head = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    sink.write(head)
    n, written = 0, len(head)
    compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
    for part in (first, records):
        for r in part:
            frame = compressor.compress(r)
            sink.write(frame)
            n += 1
            written += len(frame)
    return n, written


def read_archive(source):
    """The records of an archive, one after another."""
    head = source.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    raw = source.read(size)
    # a trained dictionary has its own magic; anything else is content
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
    decompressor = zstd.ZstdDecompressor(dict_data=d)
    frame, out, begun = decompressor.decompressobj(), [], False
    data = source.read(READ_BYTES)
    while data:
        out.append(frame.decompress(data))
        begun = not frame.eof
        if frame.eof:
            yield b"".join(out)
            data, frame, out = frame.unused_data, decompressor.decompressobj(), []
            if data:
                continue
        data = source.read(READ_BYTES)
    if begun:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    """The fields of a record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    number = lambda f: int(x) if (x := fields.get(f, "<urn:page:>")[10:-1]) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def _open(uri: str):
    """File system and path of a folder's or file's address."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives below ``folder``, an address that all executors can write; the
    manifest (file, records, bytes) of the archives that count."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    first = (rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.col("digest").alias("of"))
                 .agg(F.min("page_id").alias("first_id")))
    joined = rows.join(first, F.col("digest") == F.col("of"), "left").select("page_id", "url", "html", "first_id")

    def write(batches):
        def records():
            for batch in batches:
                for page_id, url, payload, first_id in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    revisit = first_id is not None and page_id != first_id
                    yield record(page_id, url, payload.encode(), first_id if revisit else None, revisit)

        it = records()
        one = next(it, None)
        if one is None:
            return
        fs, at = _open(folder)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}") as sink:
            n, size = write_archive((r for part in ((one,), it) for r in part), sink)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "records", "bytes"])

    return materialise(joined.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, READ_SCHEMA; ``payloads=False`` leaves payloads null."""
    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = _open(folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}") as source:
                    for raw in read_archive(source):
                        rows.append(parse(raw))
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(raw)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = manifest.select("file")
    # names are few bytes and archives much work: a task each, which adaptive execution mustn't coalesce
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(read, READ_SCHEMA)


def op8_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_archives(manifest, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_zstd_warc": op8_zstd_warc}

ORACLE_SQL = {"op8_zstd_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, hex,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
      min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""}
