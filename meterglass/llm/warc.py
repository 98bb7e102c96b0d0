"""WARC archives compressed with an embedded Zstandard dictionary: writer and reader.

Each task writes archives of bounded size. An archive (`.warc.zst`) begins with a
skippable frame that holds a dictionary built from the archive's own first records
(a bounded sample); every record is then a Zstandard frame of its own, compressed
with that dictionary, so any record can be read at its offset. Archives go to the
shared folder (spark.checkpoint.dir) through Arrow's file systems, as executors have no
other: local and mounted paths, HDFS, S3, GCS and ABFS URIs; written under a name of the attempt and renamed when whole, so a repeated task replaces nothing
half-done, and the manifest lists only archives of tasks that ended.

Records: of records with equal payloads of at least `least` bytes, the one with the
largest page_id is a response; the others are revisits of it and carry HTTP headers
without a payload. Which one it is comes from a max() by digest, combined before the
shuffle, and only payloads that occur twice take part in the join back.

Defined cases: a null html is an empty payload; a null url is an empty target; a null
page_id is smaller than any other and is reported as null; rows that repeat page_id
and html: all are written, and all those with the largest id are responses; an empty
table gives an empty archive list and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.runtime import scratch, settled, ship, shuffle_partitions

SKIPPABLE = 0x184D2A5D  # the frame of a dictionary in .warc.zst files
LEAST = 1000
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 2 << 20, 64 << 20
FEED = 16 << 10
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, record_offset long"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it. Names that only Hadoop gives to S3 mean S3."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder)


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def header_safe(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def build_record(page: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {header_safe(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Page-Id: {'' if page is None else page}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from some records: trained, or their own bytes where they are too few to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 16))
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8)
        except zstandard.ZstdError:  # too much alike
            pass
    return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    """The archive of some records: the dictionary in a leading skippable frame, then a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size < SAMPLE_BYTES:
            sample.append(r[: 64 << 10])
            size += len(sample[-1])
    learned = dictionary(sample)
    held = learned.as_bytes()
    pack = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(held)) + held + b"".join(pack.compress(r) for r in records)


def read_archive(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of an archive. Frames are fed in pieces, so no record costs more than its own size and a piece."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame in front")
    view, at = memoryview(raw), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:at]))
    while at < len(raw):
        one, parts, pos = opener.decompressobj(), [], at
        while not one.eof:
            if pos >= len(raw):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(one.decompress(view[pos : pos + FEED]))
            pos = min(pos + FEED, len(raw))
        yield at, b"".join(parts)
        at = pos - len(one.unused_data)


def parse_record(record: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":").rstrip(), "") for line in lines)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    sha1 = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).digest() != sha1:
        raise ValueError(f"payload of {named['WARC-Record-ID']} does not match its digest")
    page, target = named.get("X-Page-Id", "").strip(), named.get("X-Refers-To-Page-Id")
    return {"page_id": int(page) if page else None, "payload_bytes": int(fields["Content-Length"]), "payload_digest": sha1.hex(), "record_type": named["WARC-Type"], "refers_to": int(target) if revisit else None, "target_uri": named.get("WARC-Target-URI", ""), "payload": None if revisit else payload}


def marked(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (bytes) and, for revisits, the page they refer to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    # equal payloads: SHA-1 alone can be made to collide, so SHA-256 goes with it
    keyed = source.withColumn("key", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    order = F.coalesce("page_id", F.lit(NO_ID))
    groups = keyed.filter("key is not null").groupBy("key").agg(F.max(order).alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("key", "refers_to")
    return keyed.join(settled(groups, "repeated"), "key", "left").select("page_id", "url", "html", F.when(order != F.col("refers_to"), F.col("refers_to")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below `folder` (a URI of a shared file system) and return their manifest: archive, n_records, n_bytes."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            raw = write_archive(held)
            name = f"part-{hashlib.sha256(raw).hexdigest()[:24]}-{uuid.uuid4().hex[:8]}.warc.zst"
            temporary = f"{base}/.{name}.tmp"
            with store.open_output_stream(temporary, compression=None) as out:
                out.write(raw)
            store.move(temporary, f"{base}/{name}")
            row = pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(raw)], pa.int64())], names=["archive", "n_records", "n_bytes"])
            held, size = [], 0
            return row

        for batch in batches:
            for page, url, html, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), batch.column("refers_to").to_pylist(), strict=True):
                payload = html.as_py()
                held.append(build_record(page, url, payload, hashlib.sha1(payload).digest(), refers, refers is not None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return settled(marked(pages, least).mapInArrow(run, "archive string, n_records long, n_bytes long"), "manifest")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that a manifest lists."""
    ship(spark)
    schema = READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in rows], kinds[i]) for i, n in enumerate(names)], names=names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    raw = f.read()
                rows = []
                for at, record in read_archive(raw):
                    rows.append(parse_record(record) | {"archive": name, "record_offset": at})
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    # archives are dealt out to as many tasks as a shuffle has, or one each if they are fewer
    n = max(1, min(manifest.count(), shuffle_partitions(spark)))
    return manifest.select("archive").repartition(n).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write all pages as archives and read them back: one row per record."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    return read_warc(spark, folder, write_warc(pages, folder, least))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
