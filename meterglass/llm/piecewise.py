"""Context-triggered piecewise hashing: fingerprints of texts that stay alike where parts of the texts do.

A rolling hash of the last 7 bytes of a text's UTF-8 ends a chunk after a byte where the hash + 1 is a multiple of the
block size 3 * 2^(k - 1) (k = 0: after every byte, in texts of less than 64 bytes), if this value comes for the first time in the text (so a text that repeats itself has the boundaries of
what it repeats, and not thousands or none); each chunk gives one of 64 characters, a hash of its bytes. Boundaries of a
block size are boundaries of its half too, so one pass finds all sizes. The block size of a text is the smallest at which it has
less than 64 boundaries: the whole text is covered, no chunk takes what is left. A fingerprint is `k:` and the characters at this and the next three
sizes, with colons between: texts whose halves differ much in length or variety still have a size in common.

Two fingerprints are compared at the smallest block size that they have in common (k apart by three at most): 1 - d / (sum of lengths),
with d the edit distance by insertions and deletions, and 0 unless they share a run of characters (a third of the shorter
signature, 7 at most): unrelated texts have characters in common by chance. Equal fingerprints give 1.

edited_likeness() puts each document beside the next one by descending doc_id (after the last: the first). Documents are
sorted by ranges of (doc_id, hash of the text) in one shuffle; each task compares neighbours as they stream by, and
puts out its first and its last row, of which a small second job makes the pairs that cross ranges (a row or two a task).

Defined cases: null text counts as empty; empty texts have the fingerprint `0::::`, and are like nothing but each other;
null doc_ids come last; rows that share a doc_id are ordered by a hash of their texts, and rows that repeat both follow
each other; the next of a single row is itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.llm.common import BYTE_CODES, MULT, inverse_powers, lean, mix, powers, turn_to
from meterglass.runtime import settled, ship, shuffle_partitions

WINDOW, LEAST_BLOCK, MOST_CHARACTERS, COMMON, SIZES = 7, 3, 64, 7, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
OUT_ROWS = 2048


def boundaries(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """k and, at its block size, where chunks end and the greatest k at which they would."""
    size = codes.size - WINDOW + 1
    rolled = codes[WINDOW - 1 :].copy()
    for i in range(WINDOW - 2, -1, -1):
        rolled *= MULT
        rolled += codes[i : i + size]
    h = (mix(rolled) >> np.uint64(32)).astype(np.int64) + 1
    ends = np.flatnonzero(h % LEAST_BLOCK == 0)
    h = h[ends]
    third = h // LEAST_BLOCK
    level = np.log2((third & -third).astype(float)).astype(np.int64)
    above = np.append(np.cumsum(np.bincount(level, minlength=1)[::-1])[::-1], 0)
    k = int(np.argmax(above < MOST_CHARACTERS))
    first = lambda at: at[np.sort(np.unique(h[at], return_index=True)[1])]
    found = first(np.flatnonzero(level >= k))
    while k and (lower := first(np.flatnonzero(level >= k - 1))).size < MOST_CHARACTERS:
        k, found = k - 1, lower
    return k, ends[found] + WINDOW - 1, level[found]


def signatures(codes: np.ndarray, each: list[np.ndarray]) -> str:
    """For each list of ends, a character for each chunk that ends there, and for what follows the last of them."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(codes.size))))
    back = inverse_powers(codes.size + 1)
    out = []
    for ends in each:
        cuts = np.concatenate(([0], ends + 1, [codes.size] * (not ends.size or int(ends[-1]) + 1 < codes.size))).astype(np.int64)
        size = np.diff(cuts)
        h = mix((total[cuts[1:]] - total[cuts[:-1]]) * back[cuts[:-1]] + size.astype(np.uint64))
        out.append(ALPHABET[(h & np.uint64(63)).astype(int)].tobytes().decode())
    return ":".join(out)


def fingerprint(text: str) -> str:
    codes = BYTE_CODES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if not codes.size:
        return "0" + ":" * SIZES
    k, ends, level = boundaries(codes) if codes.size >= WINDOW else (0, np.zeros(0, int), np.zeros(0, int))
    if codes.size < MOST_CHARACTERS:
        return "0:" + signatures(codes, [np.arange(codes.size), *(ends[level >= i] for i in range(SIZES - 1))])
    return f"{k + 1}:" + signatures(codes, [ends[level >= k + i] for i in range(SIZES)])


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """Of two signatures of one block size."""
    if a == b:
        return 1.0
    run = min(COMMON, max(1, min(len(a), len(b)) // 3))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    # the distance by insertions and deletions is both lengths less twice what is common
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    (i, *left), (j, *right) = a.split(":"), b.split(":")
    left, right = ({int(k) + n: s for n, s in enumerate(of) if s} for k, of in ((i, left), (j, right)))
    both = left.keys() & right.keys()
    return similarity(left[min(both)], right[min(both)]) if both else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("piecewise")
        for batch in lean(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([fingerprint(t.as_py() or "") for t in batch.column("text")], pa.string())], names=["doc_id", "fingerprint"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fingerprint string")


def like(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints; null where one is null."""
    return F.udf(lambda x, y: None if x is None or y is None else likeness(x, y), "double", useArrow=True)(a, b)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROW = "part int, kind int, text string, " + RESULT  # kind: 0 a result, 1 the first row of a range, 2 the last one


def edited(text: str, after: str) -> str:
    """The text with its second half as the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def result(doc_id: int | None, text: str, own: str, after: str, of_after: str) -> tuple:
    new = edited(text, after)
    of_new = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, of_new, likeness(own, of_new), likeness(own, of_after)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of a range in order: what each is beside the next one; the first row, and the last one."""
    turn_to("piecewise")
    part, out, before = TaskContext.get().partitionId(), [], None
    kinds = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in ROW.split(", "))])
    packed = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
    ends = lambda kind, doc_id, text: (part, kind, text, doc_id, *[None] * 6)
    for batch in lean(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            row = (doc_id, text.as_py() or "")
            row = (*row, before[2] if before and before[1] == row[1] else fingerprint(row[1]))
            out.append((part, 0, None, *result(*before, *row[1:])) if before else ends(1, *row[:2]))
            before = row
            if len(out) >= OUT_ROWS:
                yield packed(out)
                out = []
    if before:
        out.append(ends(2, *before[:2]))
        yield packed(out)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of rows (doc_id, text, after)."""
    turn_to("piecewise")
    for batch in lean(batches):
        rows = [result(d, t, fingerprint(t), a, fingerprint(a)) for d, t, a in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        if rows:
            yield pa.record_batch([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in RESULT.split(", ")])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next document."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    sorted_ = source.repartitionByRange(shuffle_partitions(spark) * 4, *order).sortWithinPartitions(*order)
    rows = settled(sorted_.mapInArrow(neighbours, ROW), "piecewise")
    # a first and a last row of each range that holds any: two rows a task
    first = rows.filter("kind = 1").select("part", F.col("text").alias("after"))
    parts = first.select("part").withColumn("_next", F.lead("part").over(Window.orderBy("part")))
    parts = parts.withColumn("_next", F.coalesce("_next", F.min("part").over(Window.partitionBy())))
    last = rows.filter("kind = 2").select("part", "doc_id", "text").join(parts, "part").join(first.select(F.col("part").alias("_next"), "after"), "_next")
    crossing = last.select("doc_id", "text", "after").mapInArrow(across, RESULT)
    return rows.filter("kind = 0").select(*(c.split()[0] for c in RESULT.split(", "))).unionByName(crossing)


BASE_ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, length(text) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2)) AS edited_sha256 FROM n"""
