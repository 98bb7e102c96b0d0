"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

One automaton holds all pieces. A text is read once; at each position the output
links give every piece that ends there, and each is used to relax the best
segmentation of the prefix:

* unigram models: the best score of a prefix is the greatest of (best score of the
  shorter prefix + score of the piece) - the Viterbi recurrence; on ties the longer
  piece stays;
* BPE models: scores are merge ranks, and their sum does not select the merges. The
  pass is the same, but a piece may relax a position only if it is stable after the
  last piece of the shorter prefix, that is, if merging the two pieces' characters by
  rank gives these two pieces again. Exactly one piece passes at each position that a
  merge sequence reaches, so one pass gives the segmentation that merging gives.

No piece holds a space mark after another character, or a line break, so texts are
cut there and each distinct chunk is encoded once per worker (bounded cache).
Chunks that begin with several space marks are merged directly: the pieces that
stand for runs of marks share one score, so their order is by place.

Characters that no piece covers become byte pieces where the model has byte
fallback, else one unknown id for each run of them. Decoding joins pieces, turns
byte pieces into bytes, and drops the mark in front; U+2581 in a text becomes a
space, as the format has it.

Defined cases: null text encodes as no ids and decodes as empty; empty text
likewise; a null doc_id and repeated rows pass through; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import lean, turn_to
from meterglass.runtime import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CHUNK = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
CACHED, CACHED_LENGTH = 250_000, 48
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """A SentencePiece model file: pieces, scores, types, and the settings that matter here."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.prefix, charsmap, extra = UNIGRAM, False, True, b"", True
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 2:
                settings = dict(fields(value))
                self.kind, self.byte_fallback = settings.get(3, UNIGRAM), bool(settings.get(35, 0))
            elif number == 3:
                settings = dict(fields(value))
                charsmap, self.prefix, extra = settings.get(2, b""), bool(settings.get(3, 1)), bool(settings.get(4, 1))
        if charsmap or extra:
            raise ValueError("only models with identity normalisation are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")


class Codec:
    def __init__(self, raw: bytes):
        m = self.model = Model(raw)
        self.unknown = m.types.index(UNKNOWN)
        self.bytes_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.types, strict=True)) if k == BYTE}
        own = [i for i, k in enumerate(m.types) if k in (NORMAL, USER)]
        if any(MARK in m.pieces[i].lstrip(MARK) or "\n" in m.pieces[i] for i in own):
            raise ValueError("a piece holds a space mark or line break inside")
        self.id = {m.pieces[i]: i for i in own}
        self.score = {m.pieces[i]: m.scores[i] for i in own}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i, m.scores[i]))
        self.automaton.make_automaton()
        self.unknown_score = min((m.scores[i] for i in own), default=0.0) - UNKNOWN_PENALTY
        self.stable: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        table = [p.replace(MARK, " ").encode() for p in m.pieces]
        for b, i in self.bytes_id.items():
            table[i] = bytes([b])
        for i, k in enumerate(m.types):
            if k == CONTROL:
                table[i] = b""
            elif k == UNKNOWN:
                table[i] = " ⁇ ".encode()
        self.table = table

    def merged(self, text: str) -> list[str]:
        """BPE by definition: merge the neighbours whose piece has the greatest score, leftmost on ties."""
        parts: list[str] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves piece b after piece a."""
        out = self.stable.get((a, b))
        if out is None:
            x, y = self.model.pieces[a], self.model.pieces[b]
            out = self.merged(x + y) == [x, y]
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            self.stable[a, b] = out
        return out

    def single_pass(self, text: str) -> list[tuple[int, int]]:
        """(id, length) of the pieces of a chunk; id -1 for a character that no piece covers."""
        n = len(text)
        length, last = [0] * (n + 1), [-1] * (n + 1)
        if self.model.kind == BPE:
            # last[i]: the last piece of the prefix of i characters; length 0: no merge sequence ends there
            for end, (size, piece, _) in self.automaton.iter(text):
                to = end + 1
                start = to - size
                if length[to]:
                    continue
                if start and not length[start]:
                    if text[start - 1] in self.id:
                        continue
                    length[start], last[start] = 1, -1  # an uncovered character stands alone
                before = last[start]
                if before < 0:
                    if size == 1 or self.merged_alone(piece):
                        length[to], last[to] = size, piece
                elif self.follows(before, piece):
                    length[to], last[to] = size, piece
            at, out = n, []
            while at:
                size = length[at] or 1
                out.append((last[at] if length[at] else -1, size))
                at -= size
            return out[::-1]
        best = [0.0] + [-np.inf] * n
        reached = 0

        def unknowns(to: int) -> None:
            # a position that only an uncovered character reaches
            nonlocal reached
            while reached < to:
                if length[reached + 1] != 1 or last[reached + 1] < 0:
                    score = best[reached] + self.unknown_score
                    if text[reached] not in self.id and score > best[reached + 1]:
                        best[reached + 1], length[reached + 1], last[reached + 1] = score, 1, -1
                reached += 1

        for end, (size, piece, score) in self.automaton.iter(text):
            unknowns(end)
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], length[end + 1], last[end + 1] = total, size, piece
        unknowns(n)
        at, out = n, []
        while at:
            out.append((last[at], length[at]))
            at -= length[at]
        return out[::-1]

    def merged_alone(self, piece: int) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        out = self.stable.get((-1, piece))
        if out is None:
            text = self.model.pieces[piece]
            out = self.stable[-1, piece] = self.merged(text) == [text]
        return out

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk as int32 bytes; uncovered characters as bytes or as -1."""
        held = self.older.get(text)
        if held is not None:
            return self.keep(text, held)
        if self.model.kind == BPE and text.startswith(MARK + MARK):
            parts = [(self.id.get(p, -1), len(p)) for p in self.merged(text)]
        else:
            parts = self.single_pass(text)
        ids, at = [], 0
        for i, size in parts:
            if i >= 0:
                ids.append(i)
            elif self.model.byte_fallback:
                ids.extend(self.bytes_id[b] for b in text[at : at + size].encode())
            else:
                ids.append(-1)
            at += size
        return self.keep(text, struct.pack(f"<{len(ids)}i", *ids))

    def keep(self, text: str, ids: bytes) -> bytes:
        """Put a chunk into the cache; a full cache becomes the older one, whose chunks move back as they are met."""
        if len(text) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED:
                self.older, self.cache = self.cache, {}
            self.cache[text] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = text.replace(" ", MARK)
        if self.model.prefix:
            marked = MARK + marked
        get, chunk = self.cache.get, self.chunk
        ids = np.frombuffer(b"".join([get(c) or chunk(c) for c in CHUNK.findall(marked)]), np.int32)
        if not self.model.byte_fallback and (ids < 0).any():
            keep = np.ones(ids.size, bool)
            keep[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0)
            ids = np.where(ids < 0, self.unknown, ids)[keep].astype(np.int32)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        table = self.table
        out = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if self.model.prefix and out.startswith(" ") else out


@lru_cache(maxsize=4)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def load(path: str = DEFAULT_MODEL) -> bytes:
    """The model file, read by the driver; executors get its bytes (half a megabyte, whatever the input)."""
    with open(path, "rb") as f:
        return f.read()


def sentencepiece_encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, n_pieces, n_byte_pieces, ids, and whether decoding gives the text again."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("sentencepiece", codec.cache_clear)
        c = codec(held.value)
        byte_piece = np.array([k == BYTE for k in c.model.types])
        for batch in lean(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                coded = [c.encode(t) for t in texts]
                sizes = np.array([x.size for x in coded], np.int64)
                flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                total = np.concatenate(([0], np.cumsum(byte_piece[flat])))
                offs = np.concatenate(([0], np.cumsum(sizes)))
                same = [c.decode(x) == (t or "") for x, t in zip(coded, texts, strict=True)]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(t or "") for t in texts], pa.int64()),
                        pa.array(sizes),
                        pa.array(total[offs[1:]] - total[offs[:-1]], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "n_chars", "n_pieces", "n_byte_pieces", "ids", "round_trip"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids array<int>, round_trip boolean")


def sentencepiece_decode(coded: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id and the text that its ids stand for."""
    spark = coded.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("sentencepiece", codec.cache_clear)
        c = codec(held.value)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
