"""Near-duplicate classes by BagMinHash over weighted five-word shingles.

A document is the multiset of its five-word shingles (words `[^\\x20\\x09-\\x0D]+`).

Signatures. Weights are discretised into dyadic intervals of levels: [1,2), [2,4),
[4,8), ... Each (shingle, interval) has a Poisson process of points in time, of rate
2^j for interval j, and each point has a level within the interval and a signature
place. A document sees the points whose level its weight covers; a signature place
holds the earliest time seen there. Two documents agree in a place with the
probability of their weighted Jaccard similarity. Processes are drawn in time order
and end once they pass the latest time in the signature, so a document costs about
one point for each shingle and a few hundred more.

Classes. Signatures are cut into bands; documents that agree in a band are
candidates, and a candidate pair counts as a link if the exact overlap of the two
multisets is 0.8 or more. Links are found without emitting all pairs of a band:
1. equal word sequences become one node;
2. in each band bucket all nodes are compared with two hubs (linear in the bucket);
3. links give components (hash-min with pointer jumping, no collect);
4. buckets that still hold several components get the rest exactly. A node is known by
   the shingles in which it differs from the bucket's hub, which give the overlap of any
   two nodes. Buckets with one hub are taken together and dealt in blocks of bounded bytes; each pair of its blocks is
   compared in one place, which puts out only links that join two of its components
   (spanning_links): fewer than it has nodes. Where two nodes are in one
   component already, a further link between them says nothing new about classes.
   So no link that joins classes is lost, whatever the size of a bucket, and what is
   put out grows with the nodes, not with their pairs.

Defined cases: null text and texts of under five words have no shingles and are
classes of their own; a null doc_id counts as the largest, and is reported as null;
repeated rows are one node and each gets its row; of rows that share the least doc_id
of a class, those of its least node are kept, and kept_documents keeps one row of
them; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import Words, buffers, hash_runs, hash_words, lean, mix, row_chunks, turn_to
from meterglass.runtime import discard, settled, ship, shuffle_partitions

WORDS, BANDS, ROWS, SIMILARITY = 5, 25, 5, 0.8
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES, BLOCK_NODES = 8 << 20, 1024
SIGNED_BYTES = 1 << 20  # texts that get signatures at a time
HELD_SHINGLES = 100_000
BLOCKS = [1, 1, 2, 4, 8, 16, 32, 64]


def points(key: np.ndarray, ordinal: int, salt: int) -> np.ndarray:
    return mix(key + np.uint64((ordinal * 4 + salt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def bag_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, rows: int, places: int) -> np.ndarray:
    """rows x places earliest times. element: a hash of each distinct element of a document, with its count as weight."""
    signature = np.full(rows * places, np.inf)
    key, of, rate, cover = [], [], [], []
    j = 0
    left = np.arange(element.size)
    while left.size:
        low = 1 << j
        key.append(mix(element[left] ^ np.uint64(0xA0761D6478BD642F * (j + 1) & 0xFFFFFFFFFFFFFFFF)))
        of.append(doc[left])
        rate.append(np.full(left.size, float(low)))
        cover.append(np.minimum(weight[left], 2 * low - 1) - low + 1)
        j += 1
        left = left[weight[left] >= 2 * low]
    if not key:
        return signature.reshape(rows, places)
    key, of, rate, cover = np.concatenate(key), np.concatenate(of), np.concatenate(rate), np.concatenate(cover)
    time = np.zeros(key.size)
    ordinal = step = 0
    while key.size:
        for _ in range(BLOCKS[min(step, len(BLOCKS) - 1)]):
            u = (points(key, ordinal, 0) >> np.uint64(11)).astype(float) + 0.5
            time = time - np.log(u * 2.0**-53) / rate
            level = (points(key, ordinal, 1) % rate.astype(np.uint64)).astype(np.int64)
            seen = level < cover
            place = (points(key, ordinal, 2) % np.uint64(places)).astype(np.int64)
            np.minimum.at(signature, (of * places + place)[seen], time[seen])
            ordinal += 1
        step += 1
        latest = signature.reshape(rows, places).max(axis=1)
        alive = np.flatnonzero(time <= latest[of])
        key, of, rate, cover, time = key[alive], of[alive], rate[alive], cover[alive], time[alive]
    return signature.reshape(rows, places)


def band_keys(data: np.ndarray, offs: np.ndarray, bands: int = BANDS, rows_of_band: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands, int64) of some texts, and whether each has a shingle."""
    rows = len(offs) - 1
    w = Words(data, offs)
    has = w.counts >= WORDS
    keys = np.zeros((rows, bands), np.int64)
    if not has.any():
        return keys, has
    ids, distinct = w.encode()
    codes = hash_runs(hash_words(distinct)[ids], WORDS)
    at = np.flatnonzero(w.doc[WORDS - 1 :] == w.doc[: codes.size])
    shingle, doc = codes[at], w.doc[at]
    both = mix(shingle + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(both)
    s = both[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    weight = np.diff(np.append(head, s.size))
    first = order[head]
    signature = bag_signatures(shingle[first], doc[first], weight, rows, bands * rows_of_band)
    bits = signature.view(np.uint64).reshape(rows, bands, rows_of_band)
    total = np.zeros((rows, bands), np.uint64)
    for i in range(rows_of_band):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    keys = mix(total + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
    return keys, has


class Shingles:
    """The multiset of shingles of packed words; the last ones are kept, up to a bound of shingles in all."""

    def __init__(self) -> None:
        self.held: dict[bytes, Counter] = {}
        self.size = 0

    def __call__(self, packed: bytes) -> Counter:
        found = self.held.pop(packed, None)
        if found is None:
            words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
            found = Counter(zip(*(words[i:] for i in range(WORDS)), strict=False))
            self.size += len(found)
            while self.held and self.size > HELD_SHINGLES:
                self.size -= len(self.held.pop(next(iter(self.held))))
        self.held[packed] = found
        return found

    def cache_clear(self) -> None:
        self.__init__()


shingles = Shingles()


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(min(n, large[s]) for s, n in small.items() if s in large)
    return common / (a.total() + b.total() - common)


def nodes_of(docs: DataFrame, bands: int, rows_of_band: int) -> DataFrame:
    """doc_id, node (digest of the word sequence, null without shingles), band keys and packed words (for one row of a node in each chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bagminhash", shingles.cache_clear)
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in lean(batches):
            data, offs = buffers(batch.column("text"))
            for x, y in row_chunks(offs, SIGNED_BYTES):
                texts = [b" ".join(data[offs[i] : offs[i + 1]].tobytes().split()) for i in range(x, y)]
                node = [hashlib.sha256(t).digest()[:16] for t in texts]
                first: dict[bytes, int] = {}
                for i, n in enumerate(node):
                    first.setdefault(n, i)
                own = np.array(sorted(first.values()))
                joined = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
                keys, has = band_keys(joined, np.concatenate(([0], np.cumsum([len(texts[i]) for i in own]))), bands, rows_of_band)
                place = {int(i): j for j, i in enumerate(own)}
                shingled = [has[place[first[n]]] for n in node]
                lead = [bool(first[n] == i and s) for i, (n, s) in enumerate(zip(node, shingled, strict=True))]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(x, y - x),
                        pa.array([n if s else None for n, s in zip(node, shingled, strict=True)], pa.binary()),
                        pa.array([keys[place[i]].tolist() if lead[i] else None for i in range(y - x)], pa.list_(pa.int64())),
                        pa.array([pack(texts[i]) if lead[i] else None for i in range(y - x)], pa.binary()),
                    ],
                    names=["doc_id", "node", "bands", "packed"],
                )

    return docs.mapInArrow(run, "doc_id long, node binary, bands array<long>, packed binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and the exact similarity of each pair. texts: node, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bagminhash", shingles.cache_clear)
        for batch in lean(batches):
            a, b = batch.column("packed_a"), batch.column("packed_b")
            sim = [overlap(shingles(a[i].as_py()), shingles(b[i].as_py())) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    of_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    both = of_b.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    return both.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a binary, b binary, sim double")


def differences(a: Counter, hub: Counter) -> np.ndarray:
    """64-bit hashes of the single occurrences of shingles in which a node and its hub differ."""
    out = []
    for s in a.keys() | hub.keys():
        x, y = a.get(s, 0), hub.get(s, 0)
        if x != y:
            joined = b" ".join(s)
            out.extend(xxhash.xxh3_64_intdigest(joined, k) for k in range(min(x, y), max(x, y)))
    return np.array(out, np.uint64).view(np.int64)


def against_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """hub, node, the sizes of both multisets, how many occurrences they share, and those in which they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bagminhash", shingles.cache_clear)
        for batch in lean(batches):
            hub, own = batch.column("packed_hub"), batch.column("packed")
            for at in range(0, batch.num_rows, 256):
                part = range(at, min(at + 256, batch.num_rows))
                sides = [(shingles(own[i].as_py()), shingles(hub[i].as_py())) for i in part]
                differs = [differences(*x) for x in sides]
                size, of_hub = [a.total() for a, _ in sides], [h.total() for _, h in sides]
                shared = [(x + y - len(d)) // 2 for x, y, d in zip(size, of_hub, differs, strict=True)]
                columns = [pa.array(c, pa.int64()) for c in (of_hub, size, shared)]
                yield pa.record_batch([batch.column("hub").slice(at, len(part)), batch.column("node").slice(at, len(part)), *columns, pa.array(differs, pa.list_(pa.int64()))], names=["hub", "node", "hub_size", "size", "shared", "differs"])

    both = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("packed").alias("packed_hub")), "hub")
    return both.select("hub", "node", "packed_hub", "packed").mapInArrow(run, "hub binary, node binary, hub_size long, size long, shared long, differs array<long>")


def joining_links(size: np.ndarray, shared: np.ndarray, hub_size: int, begin: np.ndarray, differs: np.ndarray, label: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join components among nodes that are known by their differences from one hub.

    size, shared (with the hub) and label (component) of each node; differs[begin[i]:begin[i + 1]] are its
    differences. side: nodes of side 1 are compared with those of side 0 only; if all are of side 0, with each other.

    Two nodes share |l and hub| + |r and hub| - |hub| + |differences of both| occurrences."""
    n, out = size.size, []
    names, code, times = np.unique(differs, return_inverse=True, return_counts=True)
    # a difference that one node has alone is shared with none
    common = np.cumsum(times > 1) - 1
    often = times[code] > 1
    owner, code = np.repeat(np.arange(n), np.diff(begin))[often], common[code[often]]
    label = np.unique(label, return_inverse=True)[1]
    share = similarity / (1 + similarity)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    columns, strip = int(common[-1]) + 1 if common.size else 0, 256
    for top in range(0, right.size, strip):
        rows = right[top : top + strip]
        both = np.zeros((rows.size, left.size), np.float32)
        # counts of shared differences as products of 0/1 matrices, a bounded number of columns at a time
        for at in range(0, columns, 4096):
            inside = (code >= at) & (code < at + 4096)
            held = np.zeros((n, min(4096, columns - at)), np.float32)
            held[owner[inside], code[inside] - at] = 1
            both += held[rows] @ held[left].T
        enough = shared[rows][:, None] + shared[left] - hub_size + both >= share * (size[rows][:, None] + size[left]) - 1e-6
        enough &= label[rows][:, None] != label[left]
        for i, j in zip(*np.nonzero(enough), strict=True):
            x, y = int(left[j]), int(rows[i])
            if label[x] != label[y]:
                label[label == label[x]] = label[y]
                out.append((x, y))
    return out


def spanning_links(rest: DataFrame, similarity: float, block_bytes: int = BLOCK_BYTES, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """a, b: links that join components among the nodes that met one hub. rest: hub, node, comp, hub_size, size, shared, differs."""
    n = shuffle_partitions(rest.sparkSession)
    shapes = rest.groupBy("hub").agg(F.count("*").alias("nodes"), F.sum(16 + 8 * F.size("differs")).alias("bytes"))
    blocks = shapes.select("hub", F.ceil(F.greatest(F.col("nodes") / block_nodes, F.col("bytes") / block_bytes)).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rest.join(blocks, "hub").withColumn("block", at)
    # block x meets blocks y >= x in the place (x, y)
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    dealt = placed.select("hub", F.explode(places).alias("place"), "block", "node", "comp", "hub_size", "size", "shared", "differs")
    dealt = dealt.select("hub", F.col("place.x").alias("x"), F.col("place.y").alias("y"), (F.col("block") != F.col("place.x")).cast("int").alias("side"), "node", "comp", "hub_size", "size", "shared", "differs")

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).to_numpy()
        lists = rows.column("differs").combine_chunks()
        begin = lists.offsets.to_numpy()
        comps = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        found = joining_links(column("size"), column("shared"), int(column("hub_size")[0]), begin - begin[0], lists.flatten().to_numpy(), comps, column("side"), similarity)
        if found:
            nodes = rows.column("node").combine_chunks()
            a, b = nodes.take(pa.array([i for i, _ in found])), nodes.take(pa.array([j for _, j in found]))
            yield pa.record_batch([a, b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("bagminhash", shingles.cache_clear)
        held, place = [], None
        for batch in batches:
            at, x, y = 0, batch.column("x").to_numpy(), batch.column("y").to_numpy()
            hub = batch.column("hub").dictionary_encode().indices.to_numpy()
            ends = np.flatnonzero((hub[1:] != hub[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for to in [*ends.tolist(), batch.num_rows]:
                if to == at:
                    continue
                here = (batch.column("hub")[at].as_py(), int(x[at]), int(y[at]))
                if here != place and held:
                    yield from links(pa.Table.from_batches(held))
                    held = []
                place = here
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield from links(pa.Table.from_batches(held))

    # nodes in order of their hash: a place gives the same links if it runs again
    dealt = dealt.repartition(n, "hub", "x", "y").sortWithinPartitions("hub", "x", "y", "node")
    return dealt.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp (least node of its component) for all nodes of the edges a, b."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    held = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        # pointer jumping: take over the label of one's label
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via", "left")
        new = settled(jump.select("node", "old", F.coalesce(F.least("via", "far"), "via").alias("comp")), "labels")
        ended = new.filter("old != comp").isEmpty()
        discard(held)
        labels, held = new.select("node", "comp"), new
        if ended:
            discard(both)
            return labels


def classified(docs: DataFrame, similarity: float, bands: int = BANDS, rows_of_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id (NO_ID for null), node, class_id, class_size, kept (whether it leads its class by doc_id, then node)."""
    ship(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settled(nodes_of(source, bands, rows_of_band), "nodes")
    lead = rows.filter("packed is not null")
    banded = lead.select("node", F.explode("bands").alias("band")).distinct()
    hub = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), hub(1).alias("h1"), hub(2).alias("h2")).filter("n > 1")
    members = settled(banded.join(buckets.select("band", F.col("h1.node").alias("hub"), F.col("h2.node").alias("hub2")), "band"), "members")
    wanted = members.select("node").distinct()
    texts = settled(lead.select("node", "packed").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed")), "texts")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = members.select(F.explode(F.array("hub", "hub2")).alias("h"), "node").filter("h != node").select(*ordered("h", "node")).distinct()
    judged = settled(verified(stars, texts), "judged")
    links = judged.filter(F.col("sim") >= similarity)
    comps = components(links)

    # buckets that still hold several components: the rest exactly
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("band")
    # once for each hub, however many bands its nodes share with it
    rest = settled(placed.join(mixed, "band", "left_semi").select("hub", "node", "comp").distinct(), "rest")
    known = settled(against_hubs(rest.select("hub", "node"), texts), "known")
    found = spanning_links(rest.join(known, ["hub", "node"]), similarity)
    # differences are compared by 64-bit hashes, links by their texts: where two different shingles have one hash, a link that is none goes
    more = settled(verified(found, texts).filter(F.col("sim") >= similarity), "more")
    if not more.isEmpty():
        comps = components(links.select("a", "b").union(more.select("a", "b")))

    # classes: nodes by component, rows by node
    sizes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    grouped = sizes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = grouped.groupBy("comp").agg(F.min(F.struct("least", "node")).alias("lead"), F.sum("n").alias("class_size")).filter("class_size > 1")
    classes = grouped.select("node", "comp").join(heads, "comp")
    classes = classes.select("node", F.col("lead.least").alias("class_id"), "class_size", (F.col("lead.node") == F.col("node")).alias("leads"))
    kept = F.coalesce(F.col("leads") & (F.col("doc_id") == F.col("class_id")), F.lit(True))
    size = F.coalesce("class_size", F.lit(1)).cast("long")
    return rows.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), size.alias("class_size"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows_of_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, kept."""
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = classified(docs, similarity, bands, rows_of_band, id_col, text_col)
    return out.select(given("doc_id").alias("doc_id"), given("class_id").alias("class_id"), "class_size", "kept")


def kept_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with all their columns, but of each class of near duplicates only one row: that of the least doc_id
    (null is the largest), then of the least node, then of the least text."""
    groups = classified(docs, similarity).filter("class_size > 1").groupBy("doc_id", "node").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    groups = settled(groups.filter("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "kept"), "gone")
    # columns by place, whatever their names
    own = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (F.col(own[docs.columns.index(c)]) for c in ("text", "doc_id"))
    words = F.array_join(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    wide = docs.toDF(*own).select(F.struct(*own).alias("row"), F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("__id"), F.unhex(F.substring(F.sha2(words, 256), 1, 32)).alias("__node"), text.cast("string").alias("__text"))
    out = wide.join(groups.select("__id", "__node"), ["__id", "__node"], "left_anti").select("row.*").toDF(*docs.columns)
    again = groups.filter("kept")
    if again.isEmpty():
        return out
    # rows of one doc_id and one word sequence that lead their class together
    one = wide.join(again.select("__id", "__node"), ["__id", "__node"], "left_semi").groupBy("__id", "__node").agg(F.min_by("row", "__text").alias("row"))
    return out.union(one.select("row.*"))
