"""Exact removal of repeated 20-word passages by super-k-mer partitioning.

Words are `[^\\x20\\x09-\\x0D]+`; a window is k consecutive words of one document.
A word goes if a window covers it whose word sequence also starts earlier (in a
document with a smaller doc_id, or earlier in the same document); windows are
judged on the input.

Defined cases: null text has no words; texts shorter than k words lose nothing; a
null doc_id counts as the largest; rows that share a doc_id are ordered by a hash
of their texts, and rows that repeat both doc_id and text are one document, whose
result each of them gets; an empty table gives an empty result; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm import superkmer as S
from meterglass.llm.common import Words, buffers, hash_runs, hash_words, merged, range_hashes, row_chunks
from meterglass.runtime import ship, shuffle_partitions

K, M = 20, 5
COLLAPSE_BYTES = 24 << 20


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the key (k1, k2) that stands for a document in the shuffles: its id and 31 bits of a hash of its text.

    Without an id, k1 is a hash of the text too (of another seed), and k2 is negative, which orders such documents last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    bits = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text)).alias("k1"), F.when(doc_id.isNull(), -bits - 1).otherwise(bits).alias("k2"))


def pack_words(data: np.ndarray, offs: np.ndarray, k1: np.ndarray, k2: np.ndarray, k: int, m: int) -> tuple[S.Packed, np.ndarray] | None:
    """The super-k-mers of some documents, and a hash of the words of each."""
    w = Words(data, offs)
    if len(w) < k:
        return None
    ids, distinct = w.encode()
    codes = hash_words(distinct)[ids]
    begin, last, mini = S.runs(hash_runs(codes, m), w.doc, k, m)
    if not begin.size:
        return None
    doc, a, end = w.doc[begin], w.starts[begin], last + k
    size = (w.ends[end - 1] - a).astype(np.int32)
    p = S.Packed(k1[doc], k2[doc], (begin - w.first[doc]).astype(np.int32), (end - begin).astype(np.int32), mini, np.zeros(begin.size, np.uint8), size, a, data)
    return p, range_hashes(codes, begin, end)


def later_windows(p: S.Packed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(super-k-mer, first word) of each window whose words also start earlier, among distinct super-k-mers of a bucket."""
    none = np.zeros(0, np.int64)
    w = Words(p.data, p.offs)
    windows = len(w) - k + 1
    if windows <= 0:
        return none, none
    ids, distinct = w.encode()
    valid = np.flatnonzero(w.doc[k - 1 :] == w.doc[:windows])
    h = hash_runs(hash_words(distinct)[ids], k)[valid]
    order = np.argsort(h, kind="stable")
    s = h[order]
    dup = np.zeros(s.size, bool)
    dup[1:] = s[1:] == s[:-1]
    if not dup.any():
        return none, none
    dup[:-1] |= dup[1:]
    at, hs = valid[order[dup]], s[dup]
    gone = []
    while at.size:
        own = w.doc[at]
        place = p.start[own] + (at - w.first[own])
        by = np.lexsort((place, p.k2[own], p.k1[own], p.k2[own] < 0, hs))
        at, hs = at[by], hs[by]
        head = np.ones(at.size, bool)
        head[1:] = hs[1:] != hs[:-1]
        where = np.maximum.accumulate(np.where(head, np.arange(at.size), 0))
        first, own, place = at[where], own[by], place[by]
        same = np.ones(at.size, bool)
        for j in range(k):
            same &= ids[first + j] == ids[at + j]
        # the same place of a repeated row is no earlier start
        again = (p.k1[own] == p.k1[own[where]]) & (p.k2[own] == p.k2[own[where]]) & (place == place[where])
        gone.append(at[same & ~again])
        at, hs = at[~same], hs[~same]  # other words under the same hash: judged among themselves
    at = np.concatenate(gone)
    own = w.doc[at]
    return own, at - w.first[own]


def removed_intervals(docs: DataFrame, k: int = K, m: int = M, buckets: int | None = None) -> DataFrame:
    """Word ranges [a, b) of each document (k1, k2) that are to go; ranges may overlap."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    buckets = buckets or 3 * n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for x, y in row_chunks(offs):
                packed = pack_words(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], k1[x:y], k2[x:y], k, m)
                if packed is None:
                    continue
                p, others = S.collapse(*packed, repeats_are_one=True)
                rows = list(S.blobs(p, buckets))
                if others is not None:
                    rows.append((-1 - int(k1[x] % n), S.dump_removed(others)))
                yield S.shuffled_batch(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in S.by_bucket(batches):
            if bucket < 0:
                for blob in parts:
                    yield S.interval_batch(*S.load_intervals(blob))
                continue
            held, size, limit = [], 0, COLLAPSE_BYTES
            for blob in parts:
                held.append(S.Packed.load(blob))
                size += held[-1].data.size
                if size > limit:
                    p, others = S.collapse(S.Packed.joined(held), repeats_are_one=True)
                    if others is not None:
                        yield S.interval_batch(*S.load_intervals(S.dump_removed(others)))
                    held, size = [p.compact()], int(p.size.sum())
                    limit = max(COLLAPSE_BYTES, 2 * size)
            p = S.Packed.joined(held)
            own, place = later_windows(p, k)
            if own.size:
                a = p.start[own] + place
                a, b, own = merged(a, a + k, own)
                yield S.interval_batch(p.k1[own], p.k2[own], a, b)

    packed = keyed(docs).select("k1", "k2", "text").mapInArrow(pack, S.SHUFFLED)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, S.INTERVALS)


def substring_dedup(docs: DataFrame, k: int = K, m: int = M, with_text: bool = False, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    ship(docs.sparkSession)
    spans = removed_intervals(docs, k, m, buckets).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            texts = batch.column("text").cast(pa.binary())
            total, removed, digest, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = texts[i].as_py().split()
                n = len(words)
                if lists[i].is_valid:
                    flat = lists[i].values
                    keep = np.zeros(n + 1, np.int32)
                    np.add.at(keep, flat.field("a").to_numpy(), 1)
                    np.add.at(keep, flat.field("b").to_numpy(), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(keep)[:n] == 0)]
                out = b" ".join(words)
                total.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode())
            columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names=names)

    return keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)
