"""Resampling documents by importance towards a target distribution, over hashed n-grams.

A text's words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` (A-Z lower-cased, and nothing else); its features are all
runs of `least` to `most` consecutive words, joined by one space, hashed by crc32 into `buckets`. The target's and the
corpus's shares of each bucket give the bucket a gain, a document's weight is the floored mean of its features' gains, and
adding Gumbel noise (from a hash of doc_id) and taking the greatest scores draws without replacement in proportion to exp(weight / 1000).

Words become integers by a dictionary of the texts at hand (`CHUNK` bytes of them), n-grams tuples of these integers; each
distinct tuple's bytes are put together and hashed once, and its bucket is joined back to its counts by number. Counts of
buckets add up, so they do not ask for one dictionary of all words, and no word is shuffled: texts are read twice, for the
counts and for the weights, and what travels are `buckets` sums a task and the gains (8 bytes a bucket) to all tasks.

The draw sorts the scores by ranges across the cluster; ranks are a row's place in its range and the sizes of the ranges
before it, so nothing passes one task.

Defined cases: null and empty texts have no features, a weight of 0, and are not drawn; a null doc_id is hashed as an empty
one and comes last among equal scores; repeated rows count each and are drawn each; where the target is empty all gains
follow from the corpus alone; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import Words, buffers, lean, row_chunks, turn_to
from meterglass.llm.spelling import CRC, CRC_TABLE, LOWER, UPPER
from meterglass.runtime import settled, ship

LEAST, MOST, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 1, 10_000, 20, 10, 2024
CHUNK = 2 << 20
#: What stands between words: all of ASCII but digits and letters.
BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def features(data: np.ndarray, offs: np.ndarray, least: int, most: int, buckets: int) -> tuple[Words, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The words of some texts and, for each length of n-gram, (document, bucket) of each n-gram."""
    w = Words(LOWERED[data], offs, BETWEEN)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(w):
            return
        ids, distinct = w.encode()
        names = distinct.to_pylist()
        tuples, seen = ids, np.arange(len(names))[:, None]  # the tuple that begins at each word; the words of each distinct tuple
        for n in range(1, most + 1):
            if n > 1:
                # a tuple is its first n - 1 words, by number, and one more
                both = tuples[:-1] * len(names) + ids[n - 1 :]
                keys, tuples = np.unique(both, return_inverse=True)
                seen = np.concatenate((seen[keys // len(names)], (keys % len(names))[:, None]), axis=1)
            if n >= least:
                bucket = np.array([zlib.crc32(b" ".join([names[i] for i in t])) % buckets for t in seen.tolist()], np.int64)
                inside = np.flatnonzero(w.doc[n - 1 :] == w.doc[: len(w) - n + 1]) if len(w) >= n else np.zeros(0, int)
                yield w.doc[inside], bucket[tuples[inside]]
            if len(tuples) < 2:
                return

    return w, each()


def bucket_counts(docs: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts are in each bucket."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("importance")
        total = np.zeros(buckets, np.int64)
        for batch in lean(batches):
            data, offs = buffers(batch.column(0))
            for x, y in row_chunks(offs, CHUNK):
                for _, bucket in features(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], least, most, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from the counts of both."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # as many rows as buckets
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("importance")
        for batch in lean(batches):
            data, offs = buffers(batch.column("text"))
            n, total, words = (np.zeros(len(batch), np.int64) for _ in range(3))
            for x, y in row_chunks(offs, CHUNK):
                w, each = features(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], least, most, held.value.size)
                words[x:y] = w.counts
                for doc, bucket in each:
                    n[x:y] += np.bincount(doc, minlength=y - x)
                    # gains are whole numbers far below 2^53, so their sums as doubles are exact
                    total[x:y] += np.bincount(doc, weights=held.value[bucket], minlength=y - x).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs, least, most, buckets), bucket_counts(target, least, most, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weights(docs, gain, least, most).withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, eligible, order: list, name: str = "rank") -> DataFrame:
    """rows, written once in the order given (eligible ones first), and the rank of each eligible one from 1 on."""
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    held = settled(rows.withColumn("_in", eligible).orderBy(F.desc("_in"), *order).withColumn("_at", place), "ranked")
    part = F.shiftright("_at", 33)
    sizes = held.filter("_in").groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # a row for each range
    before = np.concatenate(([0], np.cumsum([r._n for r in sizes]))).tolist()
    starts = spark.createDataFrame([(r._part, b) for r, b in zip(sizes, before, strict=False)], "_part long, _before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn("_part", part).join(F.broadcast(starts), "_part", "left").withColumn(name, F.when(F.col("_in"), F.col("_before") + within)).drop("_in", "_at", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank (from 1) of those drawn: `share` hundredths, rounded
    down, of the documents with at least `least_words` words."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    # all scores are ranked in one sorted table, so how many are drawn is known from the ranges' sizes
    rows = ranked(scored(docs, target, least, most, buckets, seed), F.col("n_words") >= least_words, order)
    n = rows.filter(F.col("rank").isNotNull()).count()
    drawn = int(share * n // 100)
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH {CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT {_WORDS} AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (SELECT w, {CRC} % {BUCKETS} AS bucket FROM words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS big_s, (SELECT count(*) FROM bw)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS g FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sizes),
summed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
weighed AS (SELECT doc_id, len(coalesce(ws, [])) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN summed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)"""
