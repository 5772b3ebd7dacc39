"""Dictionary-compressed web archives.

A page becomes a WARC/1.1 record: the one with the smallest page_id among equal payloads of at least min_bytes is a
response, the others are revisits that refer to it, and smaller payloads are responses each. A Zstandard dictionary is
trained on a bounded sample of payloads; every archive begins with it, in a skippable frame, and each record is a frame
of its own, so that a reader needs nothing but the archive and can start at any record.

Archives go to the shared folder through its own file system. A task writes under a name of its own attempt and only
the attempts that succeed are in the written manifest, so a lost executor leaves at most an orphan file.

Defined cases: a null html is an empty payload; a null page_id is archived without an id, is a response if no row with
an id has its payload and else revisits that; repeated rows with the smallest page_id of their payload are responses
each; a null or unusable url becomes a urn; a payload of any size is one record; where too little is there to train a
dictionary, archives begin without one; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm import scratch

MANIFEST = "path string, records long, bytes long"
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
    "path string, record_offset long, record_length long"
)
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"
#: Sample for the dictionary: records, bytes of each, bytes of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 112_640
ARCHIVE_BYTES = 256 << 20


def file_system(path: str):
    """pyarrow's file system for a folder of Spark's, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload (binary), digest (hex), refers_to of pages(page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    equal = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    small = F.octet_length("payload") < min_bytes
    return rows.join(equal, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits & ~small, F.col("first_id")).alias("refers_to")
    )


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample: the records least by a hash of their text, SAMPLE_BYTES of each at most."""
    import zstandard

    some = pages.filter("html is not null and html <> ''").withColumn("_h", F.xxhash64("html"))
    chosen = some.select("_h").distinct().orderBy("_h").limit(records)
    text = F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES)
    sample = (
        some.join(F.broadcast(chosen), "_h", "left_semi")  # `records` hashes at most
        .groupBy("_h").agg(F.first(text).alias("s")).orderBy("_h").collect()
    )
    samples = [bytes(r["s"]) for r in sample]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' if page_id is not None else f'{url}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP header alone, whose length field still gives the full payload's."""
    if not url or not re.fullmatch(r"[!-~\u0080-\U0010ffff]+", url):
        url = f"urn:page:{page_id}"
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, url)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {sha1}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, digest, url)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += [
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_records(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes, level: int, archive_bytes: int):
    import zstandard
    from pyspark import TaskContext

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
    out, path, records, size, made = None, "", 0, 0, 0

    def done():
        out.close()
        return pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
            if out is None:
                path = f"{folder}/{name}-{made}.warc.zst"
                out = fs.open_output_stream(f"{root}/{name}-{made}.warc.zst", compression=None)
                records, size, made = 0, 0, made + 1
                if dictionary:
                    size = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            size += out.write(packer.compress(make_record(page_id, url, payload, digest, refers_to)))
            records += 1
            if size >= archive_bytes:
                yield done()
                out = None
    if out is not None:
        yield done()


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """offset, length and content of each record's frame, decompressed with the dictionary that leads the archive."""
    import zstandard

    data, offset, unpacker = stream.read(chunk), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8:
        magic, size = struct.unpack("<II", data[:8])
        if magic == DICTIONARY_MAGIC:
            while len(data) < 8 + size and (more := stream.read(chunk)):
                data += more
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
            data, offset = data[8 + size :], 8 + size
    while data or (data := stream.read(chunk)):
        one, parts, used = unpacker.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(data))
            used += len(data) - len(one.unused_data)
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield offset, used, b"".join(parts)
        offset += used


def parse_record(raw: bytes) -> dict:
    """The fields of a record; raises if its block or payload doesn't fit its digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    if fields["WARC-Block-Digest"] != sha1(block) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or fields["WARC-Payload-Digest"] != sha1(payload)):
        raise ValueError(f"a damaged payload: {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"][5:],
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "url": fields["WARC-Target-URI"],
    }


def read_records(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, at = file_system(path)
            rows = []
            with fs.open_input_stream(at, compression=None) as stream:
                for offset, length, raw in frames(stream):
                    rows.append(parse_record(raw) | {"path": path, "record_offset": offset, "record_length": length})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 9, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives below folder (by default the shared folder); returns the manifest: path, records, bytes."""
    spark = pages.sparkSession
    scratch.ship_code(spark)
    folder = folder or scratch.scratch_path(spark, "warc")
    dictionary = train_dictionary(pages)
    written = typed(pages, min_bytes).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        lambda b: write_records(b, folder, dictionary, level, archive_bytes), MANIFEST
    )
    return scratch.materialise(written, "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives, checked against its digests, with its place in its archive."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    scratch.ship_code(manifest.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(READ))
    spread = manifest.repartition(max(1, manifest.count()), "path")
    return spread.select("path").mapInArrow(lambda b: read_records(b, schema), READ)
