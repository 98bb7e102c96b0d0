"""Secret scan with a recursive decoding worklist.

Each text is scanned as it is (base spans), then unwrapped: percent escapes, Unicode
escapes (\\uXXXX, \\UXXXXXXXX, \\xXX, &#N;), base64 tokens, and gzip, zlib, bzip2, xz or
Zstandard data anywhere in the bytes that base64, percent or \\x escapes give, or in
other such data. A base64 run is read at all four alignments, so a payload may start
anywhere in it, and runs that are separated by single line breaks are read as one too.
Every layer that a decoder gives is scanned and followed in turn, until nothing new
comes; a layer that was seen before (same text from the same place) is not followed
again, which ends cycles. Each layer carries, for each of its characters, the code
points of the original text it came from, so found secrets are reported as spans of the
original. Decoded bytes need not be text: those that are not UTF-8 are replaced, and
ASCII in 16-bit units is read as well.

Data that unpacks to more than `most_unpacked` bytes is scanned in windows of that size
that overlap, and counted in n_oversized. Oversized data inside oversized data is read in such
windows too, up to NESTED times as many bytes in all for a document, as nested bombs have
no bound; n_unread says how many streams were left beyond that budget.

Kinds, in this order: assign, access, hex (patterns below).

Defined cases: null text is empty; empty texts give no spans and the digest of the
empty string; a null doc_id and repeated rows pass through; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.runtime import ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no match of their own
HINTS = ("passw", "secret", "token", "api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:" + BREAK.pattern + r"[A-Za-z0-9+/_-]++)++={0,2}")
STANDARD = str.maketrans("-_", "+/")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.DOTALL)
PERCENT_DATA = re.compile(r"[!-~]+")
ESCAPED_DATA = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2})(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[\x20-\x5b\x5d-\x7e])*""")
ESCAPED_BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])""")
NAMED = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
FEED, OVERLAP = 256, 1 << 16
STRAY = re.compile("[\udc80-\udcff]")
WIDE = re.compile(rb"(?:[\x01-\x7f]\x00){4,}|(?:\x00[\x01-\x7f]){4,}")  # ASCII in UTF-16 of either order
MOST_UNPACKED, NESTED = 64 << 20, 8


class Seen(set):
    """The layers of a document that were followed, how many bytes of nested oversized data may still be, and the streams that were left."""

    def __init__(self, items: set, left: int):
        super().__init__(items)
        self.left, self.unread = left, 0


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns in a text."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text, and for each of its characters the range of the original it came from."""

    __slots__ = ("text", "start", "end", "large")

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, large: bool = False):
        self.text, self.start, self.end, self.large = text, start, end, large  # large: whether it comes from oversized data

    @property
    def one_place(self) -> bool:
        """Whether all characters come from one place; the ranges are then views of one number."""
        return self.start.strides == (0,)

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.one_place:
            return int(self.start[0]), int(self.end[0])
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def same(x: int, n: int) -> np.ndarray:
    return np.broadcast_to(np.int64(x), (n,))


def mapped_bytes(raw: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[Layer]:
    """The layer of some bytes, with the origin of each, and a second one if they hold ASCII in 16-bit units.

    Bytes are read as UTF-8; each that is no part of it becomes a U+FFFD of its own."""
    text = raw.decode("utf-8", "surrogateescape")
    if not text:
        return
    if start.strides == (0,):
        clean = STRAY.sub("\ufffd", text)
        yield Layer(clean, same(start[0], len(clean)), same(end[0], len(clean)))
    elif text.isascii():
        yield Layer(text, start, end)
    else:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        alone = (code >= 0xDC80) & (code < 0xDD00)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        last = np.cumsum(np.where(alone, 1, size))
        yield Layer(STRAY.sub("\ufffd", text), start[np.append(0, last[:-1])], end[last - 1])
    if b"\0" in raw:
        drop = np.zeros(len(raw), bool)
        for m in WIDE.finditer(raw):
            drop[m.start() + (raw[m.start()] != 0) : m.end() : 2] = True
        if drop.any():
            narrow = np.frombuffer(raw, np.uint8)[~drop].tobytes()
            whole = start.strides == (0,)
            own = (same(start[0], len(narrow)), same(end[0], len(narrow))) if whole else (start[~drop], end[~drop])
            yield from mapped_bytes(narrow.replace(b"\0", b" "), *own)


def replaced(layer: Layer, pattern: re.Pattern, put) -> Layer | None:
    """The layer with each match replaced by the characters put(match) gives, each from the whole match or from its own bytes."""
    if layer.one_place:
        text = pattern.sub(lambda m: m.group() if (got := put(m)) is None else "".join(c for c, _, _ in got), layer.text)
        return Layer(text, same(layer.start[0], len(text)), same(layer.end[0], len(text)), layer.large) if text != layer.text else None
    texts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = put(m)
        if got is None:
            continue
        texts.append(layer.text[at : m.start()])
        starts.append(layer.start[at : m.start()])
        ends.append(layer.end[at : m.start()])
        for char, a, b in got:
            texts.append(char)
            x, y = layer.span(a, b)
            starts.append(np.array([x]))
            ends.append(np.array([y]))
        at = m.end()
    if not at:
        return None
    texts.append(layer.text[at:])
    starts.append(layer.start[at:])
    ends.append(layer.end[at:])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends), layer.large)


def percent(m: re.Match) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(m.group().replace("%", ""))
    out, at = [], 0
    for char in raw.decode("utf-8", "surrogateescape"):
        size = len(char.encode("utf-8", "surrogateescape"))
        out.append(("�" if "\udc80" <= char <= "\udcff" else char, m.start() + 3 * at, m.start() + 3 * (at + size)))
        at += size
    return out


def escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), m.start(), m.end())]


def opened(magic: bytes):
    if magic[:1] in (b"\x1f", b"\x78"):
        return zlib.decompressobj(47)
    if magic[:1] == b"B":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if magic[:1] == b"\xfd" else zstandard.ZstdDecompressor().decompressobj()


def streams(raw: bytes, most: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, data, whether the stream is oversized) of the compressed streams in some bytes.

    Members that follow one another are one stream. What precedes an error counts. An oversized stream
    comes in windows of `most` bytes that overlap. Input is fed in small pieces, which bounds each output."""
    view, at = memoryview(raw), 0
    while found := MAGIC.search(raw, at):
        first, held, large = found.start(), bytearray(), False
        at = first + 1
        while found:
            d, pos = opened(found.group()), found.start()
            try:
                while pos < len(raw) and not d.eof:
                    held += d.decompress(view[pos : pos + FEED])
                    pos = min(pos + FEED, len(raw))
                    while len(held) > most:
                        large = True
                        yield first, len(raw), bytes(held[:most]), True
                        del held[: most - min(OVERLAP, most // 2)]
            except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
                break
            at = pos - len(d.unused_data)
            more = at
            while more < len(raw) and not raw[more]:
                more += 1
            found = MAGIC.match(raw, more)
        if held:
            yield first, max(at, first + 1) if at > first + 1 else len(raw), bytes(held), large


def contents(raw: bytes, start: np.ndarray, end: np.ndarray, most: int, inside: bool, seen: set, text: bool = True) -> Iterator[Layer | None]:
    """The layers of some bytes and of compressed data in them; None for a stream that is too large. inside: whether they come from one."""
    if text:
        for got in mapped_bytes(raw, start, end):
            got.large = inside
            yield got
    last = -1
    for a, b, data, large in streams(raw, most):
        if large and a != last:
            last = a
            yield None
        if large and inside:
            seen.left -= len(data)
            if seen.left < 0:
                seen.unread += 1
                return
        x, y = (int(start[0]), int(end[0])) if start.strides == (0,) else (int(start[a:b].min()), int(end[a:b].max()))
        mark = ("data", hashlib.sha256(data).digest(), x, y)
        if mark not in seen:
            seen.add(mark)
            yield from contents(data, same(x, len(data)), same(y, len(data)), most, inside or large, seen)


def tokens(layer: Layer, most: int, seen: set) -> Iterator[Layer | None]:
    """The layers inside base64 tokens; None for data that is too large."""
    runs = [(m.start(), m.end(), None) for m in TOKEN.finditer(layer.text)]
    if "\n" in layer.text or "\\n" in layer.text:
        runs += [(m.start(), m.end(), [x.span() for x in BREAK.finditer(layer.text, m.start(), m.end())]) for m in WRAPPED.finditer(layer.text)]
    for x, y, breaks in runs:
        if breaks:
            edges = [x, *(e for s in breaks for e in s), y]
            parts = list(zip(edges[::2], edges[1::2], strict=True))
            token = "".join(layer.text[a:b] for a, b in parts).rstrip("=").translate(STANDARD)
            if len(token) < 16:
                continue
            place = np.concatenate([np.arange(a, b) for a, b in parts])
        else:
            token = layer.text[x:y].rstrip("=").translate(STANDARD)
            place = None
        for shift in range(4):
            own = token[shift : len(token) - ((len(token) - shift) % 4 == 1)]
            raw = binascii.a2b_base64(own + "=" * (-len(own) % 4))
            if not (worth(raw) or MAGIC.search(raw)):
                continue
            if layer.one_place:
                start, end = same(layer.start[0], len(raw)), same(layer.end[0], len(raw))
            else:
                # decoded byte i comes from the characters that hold its bits
                i = np.arange(len(raw))
                a, b = shift + i * 8 // 6, shift + (i * 8 + 7) // 6
                a, b = (a + x, b + x) if place is None else (place[a], place[b])
                start, end = layer.start[a], layer.end[b].copy()
                # padding belongs to the last byte
                end[-1] = layer.end[y - 1]
            yield from contents(raw, start, end, most, layer.large, seen)


def escaped_data(layer: Layer, most: int, seen: set) -> Iterator[Layer | None]:
    """The layers inside compressed data that is written in percent or \\x escapes (their text is read elsewhere)."""
    found = []
    if "%" in layer.text:
        for m in PERCENT_DATA.finditer(layer.text):
            if not PERCENT.search(m.group()):
                continue
            parts = re.finditer("%([0-9A-Fa-f]{2})|.", m.group())
            found.append([(int(p[1], 16) if p[1] else ord(p[0]), m.start() + p.start(), m.start() + p.end()) for p in parts])
            if "+" in m.group():  # spaces of form encoding
                found.append([(32 if c == 43 and b - a == 1 else c, a, b) for c, a, b in found[-1]])
    if "\\x" in layer.text or "\\u00" in layer.text:
        for m in ESCAPED_DATA.finditer(layer.text):
            parts = re.finditer(ESCAPED_BYTE.pattern + "|.", m.group())
            found.append([(int(p[1] or p[2], 16) if p[1] or p[2] else NAMED.get(p[3], ord(p[3])) if p[3] else ord(p[0]), m.start() + p.start(), m.start() + p.end()) for p in parts])
    for cells in found:
        raw = bytes(c for c, _, _ in cells)
        if MAGIC.search(raw):
            if layer.one_place:
                start, end = same(layer.start[0], len(raw)), same(layer.end[0], len(raw))
            else:
                start, end = layer.start[[a for _, a, _ in cells]], layer.end[[b - 1 for _, _, b in cells]]
            yield from contents(raw, start, end, most, layer.large, seen, text=False)


def marked(text: str) -> bool:
    """Whether a decoder finds something in a text."""
    escapes = "%" in text and PERCENT.search(text) or ("\\" in text or "&#" in text) and ESCAPE.search(text)
    return bool(escapes or TOKEN.search(text) or ("\n" in text or "\\n" in text) and WRAPPED.search(text))


def worth(raw: bytes) -> bool:
    """Whether the layer of some bytes has a secret or something to decode; others need not be built."""
    if b"\0" in raw and WIDE.search(raw):
        return True
    text = raw.decode("utf-8", "replace")
    return bool(scan(text)) or marked(text)


def inner_layers(layer: Layer, most: int, seen: set) -> Iterator[Layer | None]:
    if "%" in layer.text:
        yield replaced(layer, PERCENT, percent) or Layer("", layer.start, layer.end)
    if "\\" in layer.text or "&#" in layer.text:
        yield replaced(layer, ESCAPE, escape) or Layer("", layer.start, layer.end)
    yield from escaped_data(layer, most, seen)
    yield from tokens(layer, most, seen)


def find(text: str, most: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both as start, kind, end), and how many streams were oversized."""
    return followed(text, most)[:3]


def followed(text: str, most: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """The same, and how many streams were left unread."""
    base = scan(text)
    if not marked(text):
        return base, base, 0, 0
    found, bombs = set(base), 0
    place = np.arange(len(text))
    mark = lambda layer: (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.start[0]), int(layer.end[-1]))
    whole = Layer(text, place, place + 1)
    seen = Seen({mark(whole)}, NESTED * most)
    # depth first, so that few layers are held at a time
    work = [inner_layers(whole, most, seen)]
    while work:
        for got in work[-1]:
            if got is None:
                bombs += 1
                continue
            if not got.text or mark(got) in seen:
                continue
            seen.add(mark(got))
            for a, kind, b in scan(got.text):
                x, y = got.span(a, b)
                found.add((x, kind, y))
            if marked(got.text):
                work.append(inner_layers(got, most, seen))
                break
        else:
            work.pop()
    return base, sorted(found), bombs, seen.unread


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, most_unpacked: int = MOST_UNPACKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_oversized, n_unread."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans, large, left = [[], [], []], [], [], [], []
            for text in batch.column("text"):
                base, every, bombs, unread = followed(text.as_py() or "", most_unpacked)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                large.append(bombs)
                left.append(unread)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(large, pa.int64()), pa.array(left, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_oversized", "n_unread"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_oversized long, n_unread long")


# Each pattern's matches, and the pieces between them, give the places; group 2 of assign has 8 characters or more.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
BASE_ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32)) AS v(kind, name, least)),
a AS (SELECT doc_id, 0 AS kind, regexp_extract_all(x, '{_ASSIGN}') AS hits, regexp_extract_all(x, '{_ASSIGN}', 2) AS parts, regexp_split_to_array(x, '{_ASSIGN}') AS gaps FROM t
UNION ALL SELECT doc_id, 1, regexp_extract_all(x, 'AKIA[A-Z0-9]+'), regexp_extract_all(x, 'AKIA[A-Z0-9]+'), regexp_split_to_array(x, 'AKIA[A-Z0-9]+') FROM t
UNION ALL SELECT doc_id, 2, regexp_extract_all(x, '[0-9a-f]+'), regexp_extract_all(x, '[0-9a-f]+'), regexp_split_to_array(x, '[0-9a-f]+') FROM t),
u AS (SELECT doc_id, kind, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS pos FROM a),
p AS (SELECT doc_id, kind, length(hit) AS size, length(part) AS own, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM u),
s AS (SELECT p.doc_id, p.kind, name, CAST(stop - size AS BIGINT) AS a, CAST(stop AS BIGINT) AS b FROM p JOIN k USING (kind) WHERE own >= least),
g AS (SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans FROM s GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN g USING (doc_id)
"""
