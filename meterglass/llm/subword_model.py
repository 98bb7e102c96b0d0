"""Supervised subword embeddings: a text classifier over hashed word and character n-grams.

A document is the average of the learned vectors of its features - words, pairs of
neighbouring words, and the 3 to 5 character n-grams of each `<word>` - hashed into a
fixed table (a word that repeats the one before it, or the one before that, also gives
a pair that is the same for all words); a softmax layer over the average gives class probabilities. Training is
stochastic gradient descent in numpy, one document a step, on a bounded sample of
labelled rows (`sample_rows`, lowest hashes of doc_id first); features are extracted
on the executors, so texts do not reach the driver.

As the average is linear, vectors and softmax layer fold into one table of class
scores per feature (a megabyte or so, whatever the input), and scoring a document is
one lookup per feature: distinct words are scored once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import Words, buffers, give_back, hash_runs, hash_slices, lean, mix, powers, row_chunks, turn_to
from meterglass.runtime import settled, ship

BUCKETS, DIMENSION = 1 << 18, 16
GRAMS = (3, 4, 5)
SAMPLE_ROWS, EPOCHS, RATE, SEED = 3000, 6, 0.5, 11
REPEATED = mix(np.array([1, 2], np.uint64))  # the pairs of a word and itself, at a distance of one and of two
SAMPLE_FEATURES = 12_000_000  # 96 MB on the driver, where 3,000 documents of usual length have some 8 million
SCORED_BYTES = 1 << 20  # texts scored at a time: their n-grams take some hundred times as much as distinct words


@dataclass
class Model:
    """Folded scores: table[f] is the feature's share of the class scores, before averaging."""

    table: np.ndarray  # features x classes, float32
    bias: np.ndarray


def grams_of(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each n-gram, word it is in) for the distinct words of a chunk."""
    words = len(offs) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(begins)))[offs]
    size = np.diff(at) + 2
    first = np.concatenate(([0], np.cumsum(size)))
    marked = np.empty(int(first[-1]), np.uint64)
    inner = np.arange(points.size) + np.repeat(2 * np.arange(words) + 1, np.diff(at))
    marked[inner] = points
    marked[first[:-1]], marked[first[1:] - 1] = 0x110000, 0x110001
    codes = mix(marked + np.uint64(7))
    own = np.repeat(np.arange(words), size)
    for n in GRAMS:
        h = hash_runs(codes, n)
        inside = np.flatnonzero(own[n - 1 :] == own[: max(0, own.size - n + 1)])
        yield h[inside] + np.uint64(n), own[inside]


def folded(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def word_pairs(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words of a document and of its repeated words, and the document of each. codes: the hash of each word."""
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    found, of = [hash_runs(codes, 2)[inside]], [doc[inside]]
    for back in (1, 2):
        again = doc[back:][(codes[back:] == codes[:-back]) & (doc[back:] == doc[:-back])]
        found.append(np.full(again.size, REPEATED[back - 1]))
        of.append(again)
    return np.concatenate(found), np.concatenate(of)


def features(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text and the weight of each: its share of all features."""
    data = np.frombuffer(text, np.uint8)
    w = Words(data, np.array([0, data.size]))
    if not len(w):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, distinct = w.encode()
    raw, offs = buffers(distinct)
    count = np.bincount(ids, minlength=len(distinct)).astype(float)
    codes = hash_slices(raw, offs)
    at, weight = [folded(codes, buckets)], [count]
    pairs, _ = word_pairs(codes[ids], w.doc)
    at.append(folded(pairs, buckets))
    weight.append(np.ones(pairs.size))
    for h, own in grams_of(raw, offs):
        at.append(folded(h, buckets))
        weight.append(count[own])
    which, where = np.unique(np.concatenate(at), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(weight))
    return which.astype(np.int32), (total / total.sum()).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, buckets: int = BUCKETS, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (class, features, weights); without rows every class is equally likely."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (buckets, dimension)).astype(np.float32)
    layer, bias = np.zeros((classes, dimension), np.float32), np.zeros(classes, np.float32)
    rows = [r for r in rows if r[1].size]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, weight = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            own = vectors[at]
            mean = weight @ own
            score = layer @ mean + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            back = layer.T @ p
            layer -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            # each feature's step by its share of the document, on the scale of one feature
            vectors[at] = own - (step * np.sqrt(weight))[:, None] * back[None, :]
    return Model((vectors @ layer.T).astype(np.float32), bias)


def probabilities(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities (rows x classes) and word counts of some texts; empty texts have the bias alone."""
    rows, (buckets, classes) = len(offs) - 1, model.table.shape
    w = Words(data, offs)
    score = np.tile(model.bias.astype(float), (rows, 1))
    if len(w):
        ids, distinct = w.encode()
        raw, at = buffers(distinct)
        codes = hash_slices(raw, at)
        word = model.table[folded(codes, buckets)].astype(float)
        count = np.ones(len(distinct))
        for h, own in grams_of(raw, at):
            f = folded(h, buckets)
            for k in range(classes):
                word[:, k] += np.bincount(own, weights=model.table[f, k], minlength=len(distinct))
            count += np.bincount(own, minlength=len(distinct))
        pairs, of = word_pairs(codes[ids], w.doc)
        f = folded(pairs, buckets)
        total = np.maximum(1, np.bincount(w.doc, weights=count[ids], minlength=rows) + np.bincount(of, minlength=rows))
        for k in range(classes):
            sums = np.bincount(w.doc, weights=word[ids, k], minlength=rows) + np.bincount(of, weights=model.table[f, k], minlength=rows)
            score[:, k] += sums / total
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), w.counts


def fit(docs: DataFrame, labelled: DataFrame, classes: int, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Train on at most `sample_rows` labelled rows and, of these, on the first (by hash of doc_id) that hold at most
    `sample_features` features together. docs: doc_id, text; labelled: doc_id, label (0 to classes - 1).
    Of rows that share a doc_id the one with the least text counts."""
    spark = docs.sparkSession
    ship(spark)
    order = F.xxhash64("doc_id")
    chosen = labelled.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = chosen.orderBy(order, "doc_id").limit(sample_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("subword model")
        for batch in batches:
            # a row at a time: features of long texts take more than the texts
            for i, t in enumerate(batch.column("text")):
                at, weight = features((t.as_py() or "").encode(), buckets)
                own = batch.slice(i, 1)
                yield pa.record_batch([own.column("doc_id"), own.column("label"), pa.array([at], pa.list_(pa.int32())), pa.array([weight], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "weight"])

    # the sample has at most sample_rows short rows: a proven bound for the broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = settled(joined.mapInArrow(extract, "doc_id long, label int, at array<int>, weight array<float>"), "sample")
    # at most sample_rows rows
    sizes = [(r.doc_id, r.n) for r in sample.select("doc_id", F.size("at").alias("n")).orderBy(order, "doc_id").collect()]
    within = np.cumsum([n for _, n in sizes]) <= sample_features
    if not within.all():
        ids = spark.createDataFrame([(d,) for (d, _), w in zip(sizes, within.tolist(), strict=True) if w], "doc_id long")
        sample = sample.join(F.broadcast(ids), "doc_id", "left_semi")
    got = sample.toArrow()
    by_id = np.lexsort((got["label"].to_numpy(), got["doc_id"].to_numpy()))
    at, weight, label = got["at"].combine_chunks(), got["weight"].combine_chunks(), got["label"].to_numpy()
    rows = [(int(label[i]), at[i].values.to_numpy(zero_copy_only=False), weight[i].values.to_numpy(zero_copy_only=False)) for i in by_id.tolist()]
    if not rows:
        return Model(np.zeros((buckets, classes), np.float32), np.zeros(classes, np.float32))
    # the driver holds the sample once while it trains, and nothing of it afterwards
    del got
    give_back()
    model = train(rows, classes, buckets)
    del rows, at, weight
    give_back()
    return model


def score_batches(held, batches: Iterator[pa.RecordBatch], text: int | str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices, with class probabilities and word counts. text: the column of texts, or its place."""
    turn_to("subword model")
    for batch in lean(batches):
        data, offs = buffers(batch.column(text))
        for x, y in row_chunks(offs, SCORED_BYTES):
            p, words = probabilities(held.value, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
            yield batch.slice(x, y - x), p, words
