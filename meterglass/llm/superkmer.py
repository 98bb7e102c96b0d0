"""Super-k-mer partitioning: windows of k symbols, grouped by the minimiser of each.

A window's minimiser is its m-symbol string with the least hash (leftmost among
equals), so equal windows have equal minimisers and meet in one bucket.
Consecutive windows that share one minimiser travel as one packed string, a
super-k-mer, instead of as many overlapping windows. Each window is in exactly
one super-k-mer.

Skew: equal super-k-mers of a chunk collapse to one before the shuffle, and those
of a bucket collapse again as they arrive, so a passage that a third of all rows
hold costs a bucket one string for each chunk read, not one for each row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from meterglass.llm.common import gather, hash_slices, merged, sliding_min

HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SHUFFLED = "bucket int, blob binary"
INTERVALS = "k1 long, k2 int, a long, b long"
ARROW_SHUFFLED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
ARROW_INTERVALS = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


@dataclass
class Packed:
    """Super-k-mers: the document (k1, k2), first symbol, number of symbols, minimiser, whether copies of it were collapsed, and where in `data` the bytes are."""

    k1: np.ndarray
    k2: np.ndarray
    start: np.ndarray
    n: np.ndarray
    mini: np.ndarray
    twice: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    data: np.ndarray

    TYPES = (("k1", np.int64), ("k2", np.int32), ("start", np.int32), ("n", np.int32), ("mini", np.uint32), ("twice", np.uint8), ("size", np.int32))

    def __len__(self) -> int:
        return self.k1.size

    @property
    def offs(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))

    def take(self, at: np.ndarray) -> Packed:
        return Packed(*(getattr(self, name)[at] for name, _ in self.TYPES), self.begin[at], self.data)

    def bytes(self) -> np.ndarray:
        return gather(self.data, self.begin, self.size)

    def compact(self) -> Packed:
        return Packed(*(getattr(self, name) for name, _ in self.TYPES), self.offs[:-1], self.bytes())

    @classmethod
    def joined(cls, parts: list[Packed]) -> Packed:
        """Several blobs as one; their bytes are already compact."""
        if len(parts) == 1:
            return parts[0]
        out = [np.concatenate([getattr(p, name) for p in parts]) for name, _ in cls.TYPES]
        size = np.concatenate([p.size for p in parts])
        return cls(*out, np.concatenate(([0], np.cumsum(size, dtype=np.int64)[:-1])), np.concatenate([p.data for p in parts]))

    def dump(self, level: int) -> bytes:
        data = self.bytes()
        raw = struct.pack("<qq", len(self), data.size) + b"".join(getattr(self, name).astype(kind, copy=False).tobytes() for name, kind in self.TYPES) + data.tobytes()
        return zstandard.ZstdCompressor(level=level).compress(raw)

    @classmethod
    def load(cls, blob: bytes) -> Packed:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        rows, total = struct.unpack_from("<qq", raw)
        at, out = 16, []
        for _, kind in cls.TYPES:
            out.append(np.frombuffer(raw, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
        p = cls(*out, np.zeros(0, np.int64), np.frombuffer(raw, np.uint8, total, at))
        p.begin = p.offs[:-1]
        return p


def runs(grams: np.ndarray, doc: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window (by first symbol) of each super-k-mer, and its minimiser.

    grams: hash of the m symbols from each symbol on; doc: document of each symbol."""
    windows = doc.size - k + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, np.zeros(0, np.uint64)
    valid = doc[k - 1 :] == doc[:windows]
    if not valid.any():
        return none, none, np.zeros(0, np.uint64)
    ranked = (grams & HIGH) | np.arange(grams.size, dtype=np.uint64)
    at = (sliding_min(ranked, k - m + 1)[:windows] & LOW).astype(np.int64)
    own = np.flatnonzero(valid)
    of = at[own]
    new = np.ones(own.size, bool)
    new[1:] = of[1:] != of[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], own.size) - 1
    return own[begin], own[last], grams[of[begin]]


def equal_to_first(p: Packed, first: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes of `other` equal those of `first`; both are row numbers."""
    same = (p.size[first] == p.size[other]) & (p.n[first] == p.n[other])
    f, o = first[same], other[same]
    if f.size:
        size = p.size[f].astype(np.int64)
        differ = gather(p.data, p.begin[f], size) != gather(p.data, p.begin[o], size)
        if differ.any():
            wrong = np.add.reduceat(differ, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64) > 0
            same[np.flatnonzero(same)[wrong]] = False
    return same


def collapse(p: Packed, h: np.ndarray | None = None, repeats_are_one: bool = False) -> tuple[Packed, Packed | None]:
    """Equal super-k-mers become one, the earliest; the others are returned too. h: a hash of the content of each.

    repeats_are_one: what has the earliest's document and place is the same string of a repeated row, and is not returned."""
    if len(p) < 2:
        return p, None
    if h is None:
        p = p.compact()
        h = hash_slices(p.data, p.offs)
    h = h ^ p.mini
    order = np.argsort(h, kind="stable")
    s = h[order]
    dup = np.zeros(s.size, bool)
    dup[1:] = s[1:] == s[:-1]
    if not dup.any():
        return p, None
    dup[:-1] |= dup[1:]
    some = order[dup]
    some = some[np.lexsort((p.start[some], p.k2[some], p.k1[some], p.k2[some] < 0, h[some]))]
    hs = h[some]
    head = np.ones(hs.size, bool)
    head[1:] = hs[1:] != hs[:-1]
    first = some[np.maximum.accumulate(np.where(head, np.arange(hs.size), 0))]
    gone = ~head
    gone[gone] = equal_to_first(p, first[gone], some[gone])
    lost, kept = some[gone], first[gone]
    if not lost.size:
        return p, None
    other = lost
    if repeats_are_one:
        other = lost[(p.k1[lost] != p.k1[kept]) | (p.k2[lost] != p.k2[kept]) | (p.start[lost] != p.start[kept])]
    p.twice = p.twice.copy()
    p.twice[first[gone]] = 1
    keep = np.ones(len(p), bool)
    keep[lost] = False
    return p.take(np.flatnonzero(keep)), p.take(other) if other.size else None


def blobs(p: Packed, buckets: int, grouped: bool = False, level: int = 5) -> Iterator[tuple[int, bytes]]:
    """One compressed blob for each bucket that has super-k-mers. grouped: send 32 bits of each minimiser along."""
    if not len(p):
        return
    bucket = ((p.mini >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    if not grouped:
        p.mini = np.zeros(len(p), np.uint32)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    begin = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    for x, y in zip(begin, np.append(begin[1:], b.size), strict=True):
        yield int(b[x]), p.take(order[x:y]).dump(level)


def interval_batch(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], schema=ARROW_INTERVALS)


def dump_intervals(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    raw = struct.pack("<q", k1.size) + k1.astype(np.int64).tobytes() + k2.astype(np.int32).tobytes() + a.astype(np.int64).tobytes() + b.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def dump_removed(p: Packed) -> bytes:
    """All symbols of these super-k-mers, as intervals."""
    order = np.lexsort((p.k2, p.k1))
    k1, k2, a = p.k1[order], p.k2[order], p.start[order].astype(np.int64)
    doc = np.cumsum(np.concatenate(([0], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    a, b, g = merged(a, a + p.n[order], doc)
    return dump_intervals(k1[head][g], k2[head][g], a, b)


def load_intervals(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, np.int64, n, 8 + 12 * n), np.frombuffer(raw, np.int64, n, 8 + 20 * n)


def shuffled_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=ARROW_SHUFFLED)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Buckets in turn, each with its blobs as they arrive; rows come sorted by bucket."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield b, blob.as_py()

    source = rows()
    head = next(source, None)
    while head is not None:
        current = head[0]

        def own(current: int = current) -> Iterator[bytes]:
            nonlocal head
            while head is not None and head[0] == current:
                yield head[1]
                head = next(source, None)

        part = own()
        yield current, part
        for _ in part:  # whatever the reader left
            pass
