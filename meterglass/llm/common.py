"""Vectorised text handling that the corpus operators share.

Texts arrive as Arrow columns and are handled as one UTF-8 byte buffer with
offsets; all word and hash work is numpy over that buffer, in chunks of bounded
size, so memory does not depend on the size of a partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
CHUNK_BYTES = 4 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}
_INVERSES: dict[int, np.ndarray] = {}
_TURN: dict[str, Callable[[], None] | None] = {}
BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def turn_to(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Called by each task in a Python worker. Spark reuses workers: one that turns to another operator first
    gives back what the last one cached (clear), so a chain of operators needs the memory of one of them."""
    if operator in _TURN:
        return
    for held in _TURN.values():
        if held is not None:
            held()
    _TURN.clear()
    _TURN[operator] = clear
    _POWERS.clear()
    _INVERSES.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: numpy's temporaries otherwise stay with the process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what the work on each has freed is given back before the next."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """MULT to the powers 0..n-1, modulo 2^64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        p = np.full(size, MULT, dtype=np.uint64)
        p[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(p)
    return _POWERS[size][:n]


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of powers(n)."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _INVERSES:
        p = np.full(size, pow(int(MULT), -1, 1 << 64), dtype=np.uint64)
        p[0] = 1
        _INVERSES.clear()
        _INVERSES[size] = np.cumprod(p)
    return _INVERSES[size][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_large_string(column.type) else column.type)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """The words of some documents, `[^\\x20\\x09-\\x0D]+` or the runs of bytes that are not `between`: byte range and document of each."""

    __slots__ = ("data", "offs", "inside", "starts", "ends", "doc", "counts", "first")

    def __init__(self, data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE):
        self.data, self.offs = data, offs
        rows = len(offs) - 1
        inside = ~between[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        firsts = offs[:-1][offs[:-1] < offs[1:]]
        begin[firsts] = inside[firsts]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        lasts = offs[1:][offs[:-1] < offs[1:]] - 1
        finish[lasts] = inside[lasts]
        self.inside = inside
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows, dtype=np.int64), self.counts)

    def __len__(self) -> int:
        return self.starts.size

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """An exact integer for each word, and the distinct words by that integer."""
        offs = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        compact = self.data[self.inside]
        words = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offs), pa.py_buffer(compact)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_slices(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of data[offs[i]:offs[i+1]], alike on every machine."""
    lens = np.diff(offs)
    if not lens.size:
        return np.zeros(0, np.uint64)
    at = np.arange(data.size, dtype=np.int64) - np.repeat(offs[:-1], lens)
    codes = BYTE_CODES[data] * powers(int(lens.max()) + 1)[at]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes)))
    return mix(total[offs[1:]] - total[offs[:-1]] + lens.astype(np.uint64) * MULT)


def hash_words(words: pa.Array) -> np.ndarray:
    data, offs = buffers(words)
    return hash_slices(data, offs)


def hash_runs(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive codes; entry i belongs to codes[i:i+n]."""
    size = codes.size - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    p = powers(n)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += codes[j : j + size] * p[j]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many slices, which may overlap, one after another."""
    if not begin.size:
        return np.zeros(0, np.uint8)
    views = pa.LargeListViewArray.from_arrays(pa.array(begin.astype(np.int64, copy=False)), pa.array(length.astype(np.int64, copy=False)), pa.array(data))
    return views.flatten().to_numpy()


def range_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of codes[begin:end] for many ranges, alike wherever the same codes stand."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(codes.size))))
    return mix((total[end] - total[begin]) * inverse_powers(codes.size + 1)[begin] + (end - begin).astype(np.uint64))


def merged(begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals within each group; touching ones join."""
    if not begin.size:
        return begin, end, group
    order = np.lexsort((begin, group))
    b, e, g = begin[order], end[order], group[order]
    # a running maximum that starts anew in each group
    span = int(e.max()) + 1
    dense = np.cumsum(np.concatenate(([0], (g[1:] != g[:-1]).astype(np.int64))))
    reach = np.maximum.accumulate(e + dense * span) - dense * span
    new = np.ones(b.size, bool)
    new[1:] = (g[1:] != g[:-1]) | (b[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return b[at], np.maximum.reduceat(e, at), g[at]
