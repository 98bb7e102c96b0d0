"""Exact dedup by a log-structured merge index over text digests.

Texts are equal when identical after deleting every character of
`[\\x20\\x09-\\x0D]`. Each task fills a memtable (digest to best entry); when it is
full, or the task ends, it is flushed as a sorted run, cut by digest range into
buckets, each cut with a Bloom filter over its digests. Compaction merges the runs
of a bucket, level by level: a digest that the filter of another run may hold is
looked up there by binary search, hits receive byte verification (the normalised
bytes travel compressed with the run), and the entry that wins - most code points
in the original text, then smallest doc_id - is kept, with the summed count. The
compacted index is joined back to the documents by the full SHA-256.

Index digests are a prefix of the SHA-256 (`digest_bytes`); verification makes the
result exact whatever their length. Two different texts with one SHA-256 raise an
error in compaction.

Skew: a memtable holds one entry for each digest, so a group of copies that fills
a third of all rows costs compaction one entry a run. The join back is a sort-merge
join that adaptive execution splits at hot digests; only groups of two or more
rows are joined.

Defined cases: null text counts as empty, and empty texts are equal to each other;
a null doc_id loses every tie and is reported as null; rows that repeat both
doc_id and text tie, so the report marks each of them kept if their id wins, while
kept_documents() keeps one; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterglass.llm.common import SPACES, buffers, lean, turn_to
from meterglass.runtime import ship, shuffle_partitions

MEMTABLE_BYTES = 8 << 20
MEMTABLE_ROWS = 200_000
DIGEST_BYTES = 8
FILTER_BITS, FILTER_HASHES = 10, 4
NO_ID = np.iinfo(np.int64).max


class Bloom:
    """A Bloom filter over digests; positions come from the digest by double hashing."""

    def __init__(self, digests: np.ndarray, bits: np.ndarray | None = None):
        size = max(64, FILTER_BITS * digests.size)
        self.bits = np.zeros((size + 7) // 8 * 8, bool) if bits is None else bits
        if bits is None:
            for at in self.places(digests):
                self.bits[at] = True

    def places(self, digests: np.ndarray) -> Iterator[np.ndarray]:
        a = digests
        b = (digests >> np.uint64(29)) | np.uint64(1)
        for i in range(FILTER_HASHES):
            yield ((a + np.uint64(i) * b) % np.uint64(self.bits.size)).astype(np.int64)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(digests.size, bool)
        for at in self.places(digests):
            out &= self.bits[at]
        return out

    def dump(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Bloom:
        return cls(np.zeros(0, np.uint64), np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool))


class Run:
    """A sorted run: digest, code points, doc_id and count of each entry, full digests, compressed bytes, and a filter."""

    def __init__(self, digest: np.ndarray, points: np.ndarray, ids: np.ndarray, count: np.ndarray, sha: list[bytes], packed: list[bytes], bloom: Bloom | None = None):
        self.digest, self.points, self.ids, self.count, self.sha, self.packed = digest, points, ids, count, sha, packed
        self.bloom = bloom or Bloom(digest)

    def __len__(self) -> int:
        return self.digest.size

    def dump(self) -> bytes:
        body, bloom = b"".join(self.packed), self.bloom.dump()
        sizes = np.array([len(x) for x in self.packed], np.int64)
        return struct.pack("<qqq", len(self), len(bloom), len(body)) + b"".join(x.tobytes() for x in (self.digest, self.points, self.ids, self.count, sizes)) + b"".join(self.sha) + bloom + body

    @classmethod
    def load(cls, raw: bytes) -> Run:
        n, blooms, _ = struct.unpack_from("<qqq", raw)
        columns = [np.frombuffer(raw, kind, n, 24 + 8 * n * i) for i, kind in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64))]
        at = 24 + 40 * n
        sha = [raw[at + 32 * i : at + 32 * i + 32] for i in range(n)]
        at += 32 * n
        bloom = Bloom.load(raw[at : at + blooms])
        ends = at + blooms + np.cumsum(columns[4])
        packed = [raw[e - s : e] for e, s in zip(ends.tolist(), columns[4].tolist(), strict=True)]
        return cls(*columns[:4], sha, packed, bloom)


def digest_of(sha: bytes, digest_bytes: int) -> int:
    return int.from_bytes(sha[:digest_bytes].ljust(8, b"\0"), "big")


def better(points: int, doc: int, than_points: int, than_doc: int) -> bool:
    return (-points, doc) < (-than_points, than_doc)


class Memtable:
    """Entries by digest; a digest has several entries only where different texts share it."""

    def __init__(self, digest_bytes: int):
        self.digest_bytes, self.entries, self.size = digest_bytes, {}, 0

    def add(self, text: bytes, sha: bytes, points: int, doc: int) -> None:
        held = self.entries.setdefault(digest_of(sha, self.digest_bytes), [])
        for e in held:
            if e[0] == text:  # byte verification
                e[4] += 1
                if better(points, doc, e[2], e[3]):
                    e[2], e[3] = points, doc
                return
            if e[1] == sha:
                raise ValueError("two different texts have one SHA-256")
        held.append([text, sha, points, doc, 1])
        self.size += len(text) + 200

    def flush(self) -> Run:
        """The sorted run of all entries; the memtable is empty afterwards."""
        rows = sorted(((d, e) for d, held in self.entries.items() for e in held), key=lambda x: (x[0], x[1][1]))
        pack = zstandard.ZstdCompressor(level=3).compress
        self.entries, self.size = {}, 0
        column = lambda i: np.array([e[i] for _, e in rows], np.int64)
        return Run(np.array([d for d, _ in rows], np.uint64), column(2), column(3), column(4), [e[1] for _, e in rows], [pack(e[0]) for _, e in rows])


def cut(run: Run, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The run by digest range, one sorted run a bucket."""
    width = (1 << 64) // buckets + 1
    at = np.searchsorted(run.digest, np.array([min(i * width, (1 << 64) - 1) for i in range(buckets)], np.uint64), "left").tolist() + [len(run)]
    for b in range(buckets):
        x, y = at[b], at[b + 1]
        if y > x:
            yield b, Run(run.digest[x:y], run.points[x:y], run.ids[x:y], run.count[x:y], run.sha[x:y], run.packed[x:y]).dump()


def compact(older: Run, newer: Run) -> Run:
    """Merge two runs; verified equals become one entry with the smallest identifier."""
    unpack = zstandard.ZstdDecompressor().decompress
    points, ids, count = older.points.copy(), older.ids.copy(), older.count.copy()
    fresh = np.ones(len(newer), bool)
    maybe = np.flatnonzero(older.bloom.may_hold(newer.digest))
    at = np.searchsorted(older.digest, newer.digest[maybe], "left")
    hit = at < len(older)
    hit[hit] = older.digest[at[hit]] == newer.digest[maybe][hit]
    for i, first in zip(maybe[hit].tolist(), at[hit].tolist(), strict=True):
        j = first
        while j < len(older) and older.digest[j] == newer.digest[i]:
            if older.packed[j] == newer.packed[i] or unpack(older.packed[j]) == unpack(newer.packed[i]):
                count[j] += newer.count[i]
                if better(newer.points[i], newer.ids[i], points[j], ids[j]):
                    points[j], ids[j] = newer.points[i], newer.ids[i]
                fresh[i] = False
                break
            if older.sha[j] == newer.sha[i]:
                raise ValueError("two different texts have one SHA-256")
            j += 1
    new = np.flatnonzero(fresh)
    digest = np.concatenate((older.digest, newer.digest[new]))
    order = np.argsort(digest, kind="stable")
    sha, packed = older.sha + [newer.sha[i] for i in new], older.packed + [newer.packed[i] for i in new]
    join = lambda a, b: np.concatenate((a, b[new]))[order]
    return Run(digest[order], join(points, newer.points), join(ids, newer.ids), join(count, newer.count), [sha[i] for i in order], [packed[i] for i in order])


class Levels:
    """Runs by level; two of one level merge into one of the next, so each entry is merged a logarithmic number of times."""

    def __init__(self) -> None:
        self.levels: dict[int, Run] = {}

    def add(self, run: Run) -> None:
        level = 0
        while level in self.levels:
            run = compact(self.levels.pop(level), run)
            level += 1
        self.levels[level] = run

    def close(self) -> Run | None:
        out = None
        for level in sorted(self.levels):
            out = self.levels[level] if out is None else compact(self.levels[level], out)
        return out


def build_index(docs: DataFrame, digest_bytes: int = DIGEST_BYTES, memtable_bytes: int = MEMTABLE_BYTES, buckets: int | None = None) -> DataFrame:
    """text_sha256, keep_id, keep_points and group_size of each distinct normalised text. docs: doc_id, text."""
    n = shuffle_partitions(docs.sparkSession)
    buckets = buckets or 2 * n

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("exact dedup")
        table = Memtable(digest_bytes)

        def flushed() -> pa.RecordBatch:
            rows = list(cut(table.flush(), buckets))
            return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "run"])

        for batch in lean(batches):
            data, offs = buffers(batch.column("text"))
            points = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]].tobytes().translate(None, SPACES)
                table.add(text, hashlib.sha256(text).digest(), int(points[i]), ids[i])
                if table.size > memtable_bytes or len(table.entries) >= MEMTABLE_ROWS:
                    yield flushed()
        if table.entries:
            yield flushed()

    def compaction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("exact dedup")
        levels, bucket = Levels(), None

        def closed() -> pa.RecordBatch:
            run = levels.close()
            ids = pa.array(run.ids, mask=run.ids == NO_ID)
            return pa.record_batch([pa.array([x.hex() for x in run.sha], pa.string()), ids, pa.array(run.points), pa.array(run.count)], names=["text_sha256", "keep_id", "keep_points", "group_size"])

        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket is not None and b != bucket:
                    yield closed()
                    levels = Levels()
                bucket = b
                levels.add(Run.load(raw.as_py()))
        if bucket is not None:
            yield closed()

    runs = docs.select("doc_id", "text").mapInArrow(memtables, "bucket int, run binary")
    return runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(compaction, "text_sha256 string, keep_id long, keep_points long, group_size long")


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the original text) and text_sha256 of each row. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            points = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            sha = [hashlib.sha256(data[a:b].tobytes().translate(None, SPACES)).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(points, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_points", "text_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_points long, text_sha256 string")


def exact_dedup(docs: DataFrame, digest_bytes: int = DIGEST_BYTES, memtable_bytes: int = MEMTABLE_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    docs = normalised(docs)
    groups = build_index(docs, digest_bytes, memtable_bytes, buckets).filter("group_size > 1")
    joined = digests(docs).join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that tie on doc_id and length, one."""
    ship(docs.sparkSession)
    own = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*own)
    by = dict(zip(docs.columns, own, strict=True))
    text, doc = F.coalesce(F.col(by["text"]).cast("string"), F.lit("")), F.col(by["doc_id"]).cast("long")
    spaces = "".join(chr(b) for b in SPACES)
    marked = source.withColumn("__sha", F.sha2(F.translate(text, spaces, ""), 256)).withColumn("__points", F.char_length(text))
    groups = build_index(normalised(docs)).filter("group_size > 1").withColumnRenamed("text_sha256", "__sha")
    stays = marked.join(groups, "__sha", "left").filter(F.col("group_size").isNull() | (doc.eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("keep_points"))))
    # equal rows under one doc_id: one of them; the groups are as small as the repetition of an id
    first = Window.partitionBy("__sha").orderBy(doc)
    single = stays.filter("group_size is null").select(*own)
    several = stays.filter("group_size is not null").withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select(*own)
    return single.unionByName(several).toDF(*docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
