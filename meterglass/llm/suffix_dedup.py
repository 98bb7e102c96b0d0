"""Removal of repeated 200-byte strings by a distributed difference-cover suffix sort.

Every text is a string of UTF-8 bytes. The 200-byte windows of all texts are dealt
to buckets by minimiser as packed strings (superkmer.py), so that equal windows
meet; strings whose minimiser stands alone can hold no repeat and need no sort.
Within a bucket the difference-cover algorithm sorts the suffixes of the strings
left: the triples at positions 1 and 2 modulo 3 are sorted and named, the names
are sorted by recursion, the suffixes at positions 0 modulo 3 are ordered through
them, both parts are merged, and neighbours in the order are compared on their
200-byte prefixes. Recursion ends once names stand for the whole prefix.

A byte goes if it is covered by a 200-byte string that also starts anywhere else.

Defined cases: null text is empty; shorter texts lose nothing; matches never cross
documents; rows that repeat doc_id and text are separate documents, so both lose
what they share; a null doc_id is kept as null; an empty table gives an empty
result; columns other than doc_id and text are ignored, whatever their names.
What is left may cut a character; the digest is of bytes, and kept text replaces
a cut character by U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm import superkmer as S
from meterglass.llm.common import BYTE_CODES, buffers, hash_slices, inverse_powers, merged, mix, powers, range_hashes
from meterglass.llm.substring_dedup import keyed
from meterglass.runtime import ship, shuffle_partitions

K, M = 200, 32
PIECE = 2 << 20  # bytes that are handled at a time; longer texts go in overlapping pieces
SORT_BYTES = 1 << 20  # strings of several minimisers are sorted together up to this


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m bytes from each byte on."""
    n = data.size
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(n), out=total[1:])
    return mix((total[m:] - total[:-m]) * inverse_powers(n + 1)[: n - m + 1])


def pack_bytes(data: np.ndarray, offs: np.ndarray, k1: np.ndarray, k2: np.ndarray, shift: np.ndarray, k: int, m: int) -> tuple[S.Packed, np.ndarray] | None:
    """The super-k-mers of some texts, and a hash of the bytes of each. shift: where in its document each text starts."""
    if data.size < k:
        return None
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    begin, last, mini = S.runs(gram_hashes(data, m), doc, k, m)
    if not begin.size:
        return None
    d, size = doc[begin], (last - begin + k).astype(np.int32)
    p = S.Packed(k1[d], k2[d], (begin - offs[d] + shift[d]).astype(np.int32), size, mini, np.zeros(begin.size, np.uint8), size, begin, data)
    return p, range_hashes(BYTE_CODES[data], begin, begin + size)


def pieces(offs: np.ndarray, k: int, limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, to) of about `limit` bytes; a longer row is cut so that each window is in one piece."""
    held: list[tuple[int, int, int]] = []
    size = 0
    for row in range(len(offs) - 1):
        at, end = int(offs[row]), int(offs[row + 1])
        while True:
            to = min(end, at + limit)
            held.append((row, at, to))
            size += to - at
            if size >= limit:
                yield held
                held, size = [], 0
            if to == end:
                break
            at = to - (k - 1)
    if held:
        yield held


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The dense rank of each key, from 1, and how many there are."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(s.size, np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(s.size, np.int64)
    names = np.cumsum(new)
    out[order] = names
    return out, int(names[-1]) if s.size else 0


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer that sorts as (a, b); both are below 2^31."""
    return (a << 32) | b


def triple_names(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of the three symbols from each place on, by one sort where they fit into an integer."""
    if t.max() < 1 << 21:
        return ranks_of((t[at] << 42) | (t[at + 1] << 21) | t[at + 2])
    first, _ = ranks_of(pair(t[at], t[at + 1]))
    return ranks_of(pair(first, t[at + 2]))


def difference_cover_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix of s (symbols from 1, below 2^31), right for prefixes of `depth` symbols at least; longer ties may stay equal."""
    n = s.size
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate((s, np.zeros(5, np.int64)))
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    sample = np.concatenate((one, two))
    # sort the sampled triples
    names, distinct = triple_names(t, sample)
    if distinct < sample.size and depth > 3:
        # the suffixes of the names' string are those of the sample: recurse on names
        got = difference_cover_ranks(np.concatenate((names[: one.size] + 1, [1], names[one.size :] + 1)), -(-depth // 3))
        names = np.concatenate((got[: one.size], got[one.size + 1 :]))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    # the remaining suffixes, by their first symbol and the rank of what follows
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(pair(t[zero], rank[zero + 1]))]
    # merge: a suffix at 0 modulo 3 is compared with one at 1 by (symbol, rank) and with one at 2 by (two symbols, rank)
    one, two = one[one < n], two[two < n]
    by_one = np.sort(pair(t[one], rank[one + 1]))
    zero_one = pair(t[zero], rank[zero + 1])
    big = int(t.max()) >= 1 << 15
    both = np.concatenate((two, zero))
    heads = ranks_of(pair(t[both], t[both + 1]))[0] if big else (t[both] << 15) | t[both + 1]
    by_two = np.sort(pair(heads[: two.size], rank[two + 2]))
    zero_two = pair(heads[two.size :], rank[zero + 2])
    before = np.searchsorted(by_one, zero_one) + np.searchsorted(by_two, zero_two)
    # equal to a sampled suffix: then they share a place
    i, j = np.searchsorted(by_one, zero_one, "right"), np.searchsorted(by_two, zero_two, "right")
    equal = i + j > before
    # places: sampled suffixes by name, the others before the first sampled one that is not less
    sampled = np.concatenate((one, two))
    by_name = np.bincount(rank[sampled], minlength=int(rank.max()) + 2)
    below = np.cumsum(by_name) - by_name
    new = np.ones(zero.size, np.int64)
    new[1:] = zero_one[1:] != zero_one[:-1]
    nth = np.cumsum(new)
    line = np.empty(n, np.int64)
    line[sampled] = pair(below[rank[sampled]], np.int64(n + 1))
    line[zero] = pair(before, np.where(equal, n + 1, nth))
    # a rank need not be dense: the number of places before it does
    order_sampled = below[rank[sampled]]
    lesser = np.searchsorted(before, order_sampled, "right") if not equal.any() else None
    if lesser is None:
        return ranks_of(line)[0]
    out = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    out[zero] = before + np.repeat(head, np.diff(np.append(head, zero.size))) + 1
    out[sampled] = order_sampled + lesser + 1
    return out


def repeated_windows(data: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """For each byte: whether a k-byte window starts there whose bytes start a window elsewhere too."""
    n = data.size
    out = np.zeros(n, bool)
    size = np.diff(offs)
    room = np.repeat(offs[1:], size) - np.arange(n)
    # one closing symbol after each string; a window never reaches it
    place = np.arange(n) + np.repeat(np.arange(size.size), size)
    s = np.ones(n + size.size, np.int64)
    s[place] = data.astype(np.int64) + 2
    rank = difference_cover_ranks(s, k)[place]
    fit = np.flatnonzero(room >= k)
    order = fit[np.argsort(rank[fit])]
    a, b = order[:-1], order[1:]
    # neighbours in the order: equal on the first k bytes?
    alive = np.arange(a.size)
    words = np.zeros(n + 8, np.uint64)
    for j in range(8):
        words[: n - j] |= data[j:].astype(np.uint64) << np.uint64(8 * j)
    for j in [*range(0, k - 7, 8), *([k - 8] if k % 8 and k > 8 else [])]:
        alive = alive[words[a[alive] + j] == words[b[alive] + j]]
    if k < 8:
        for j in range(k):
            alive = alive[data[a[alive] + j] == data[b[alive] + j]]
    out[a[alive]] = True
    out[b[alive]] = True
    return out


def judge_bucket(p: S.Packed, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Byte ranges that go, from the distinct super-k-mers of a bucket."""
    order = np.argsort(p.mini, kind="stable")
    s = p.mini[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if s.size else np.zeros(0, np.int64)
    count = np.diff(np.append(head, s.size))
    # all windows of a collapsed string are repeated
    whole = np.flatnonzero(p.twice)
    if whole.size:
        yield p.k1[whole], p.k2[whole], p.start[whole].astype(np.int64), p.start[whole].astype(np.int64) + p.n[whole]
    # a minimiser may stand twice in one string only if the string itself holds a window twice: such strings have over 2k - m symbols
    group = np.repeat(np.arange(head.size), count)
    need = count[group] > 1
    chosen, of = order[need], group[need]
    if not chosen.size:
        return
    size = p.size[chosen].astype(np.int64)
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
    at, total = 0, np.concatenate(([0], np.cumsum(size)))
    while at < chosen.size:
        cut = ends[min(ends.size - 1, max(np.searchsorted(ends, at, "right"), np.searchsorted(total[ends], total[at] + SORT_BYTES, "right") - 1))]
        part = p.take(chosen[at:cut])
        at = int(cut)
        offs = part.offs
        starts = np.flatnonzero(repeated_windows(part.bytes(), offs, k))
        if starts.size:
            own = np.searchsorted(offs, starts, "right") - 1
            a = part.start[own] + starts - offs[own]
            a, b, own = merged(a, a + k, own)
            yield part.k1[own], part.k2[own], a, b


def removed_intervals(docs: DataFrame, k: int = K, m: int = M, buckets: int | None = None) -> DataFrame:
    """Byte ranges [a, b) of each document (k1, k2) that are to go; ranges may overlap."""
    n = shuffle_partitions(docs.sparkSession)
    buckets = buckets or 2 * n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for part in pieces(offs, k, PIECE):
                rows = np.array([r for r, _, _ in part])
                lens = np.array([y - x for _, x, y in part])
                at = np.array([x for _, x, _ in part])
                own = data[at[0] : part[-1][2]] if len(part) > 1 or lens.size else data[:0]
                got = pack_bytes(own, np.concatenate((at - at[0], [part[-1][2] - at[0]])), k1[rows], k2[rows], at - offs[rows], k, m)
                if got is None:
                    continue
                p, others = S.collapse(*got)
                out = list(S.blobs(p, buckets, grouped=True))
                if others is not None:
                    out.append((-1 - int(k1[rows[0]] % n), S.dump_removed(others)))
                yield S.shuffled_batch(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in S.by_bucket(batches):
            if bucket < 0:
                for blob in parts:
                    yield S.interval_batch(*S.load_intervals(blob))
                continue
            held, size, limit = [], 0, 16 << 20
            for blob in parts:
                held.append(S.Packed.load(blob))
                size += held[-1].data.size
                if size > limit:
                    p, others = S.collapse(S.Packed.joined(held))
                    if others is not None:
                        yield S.interval_batch(*S.load_intervals(S.dump_removed(others)))
                    held, size = [p.compact()], int(p.size.sum())
                    limit = max(16 << 20, 2 * size)
            p, others = collapse_shared(S.Packed.joined(held))
            if others is not None:
                yield S.interval_batch(*S.load_intervals(S.dump_removed(others)))
            for found in judge_bucket(p, k):
                yield S.interval_batch(*found)

    packed = keyed(docs).select("k1", "k2", "text").mapInArrow(pack, S.SHUFFLED)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, S.INTERVALS)


def collapse_shared(p: S.Packed) -> tuple[S.Packed, S.Packed | None]:
    """Drop strings whose minimiser stands alone, then collapse equal ones."""
    order = np.argsort(p.mini, kind="stable")
    s = p.mini[order]
    same = np.zeros(s.size, bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    keep = np.sort(order[same])
    lone = p.twice.astype(bool).copy()
    lone[keep] = True
    p = p.take(np.flatnonzero(lone)).compact()
    return S.collapse(p, hash_slices(p.data, p.offs))


def suffix_dedup(docs: DataFrame, k: int = K, m: int = M, with_text: bool = False, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text."""
    ship(docs.sparkSession)
    # rows that repeat doc_id and text are told apart by their number: all their windows are repeated
    source = keyed(docs)
    spans = removed_intervals(docs, k, m, buckets).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            data, offs = buffers(batch.column("text"))
            removed, spans, digest, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[offs[i] : offs[i + 1]]
                gone = count = 0
                if lists[i].is_valid:
                    flat = lists[i].values
                    a, b, _ = merged(flat.field("a").to_numpy(), flat.field("b").to_numpy(), np.zeros(len(flat), np.int64))
                    keep = np.ones(own.size + 1, np.int8)
                    for x, y in zip(a, b, strict=True):
                        keep[x:y] = 0
                    gone, count = int((b - a).sum()), a.size
                    own = own[keep[:-1].astype(bool)]
                out = own.tobytes()
                removed.append(gone)
                spans.append(count)
                digest.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names=names)

    return source.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)
