"""Spelling variants: words one letter apart, grouped without making pairs.

A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. The vocabulary is
the distinct words of at least `least_length` letters and `least_count` occurrences. Two words are near if one inserted,
deleted or replaced letter turns one into the other:

* replacements: a word of L letters is in L groups, one for each place: those of equal length that agree before and behind it
  (position, prefix, suffix). A group gives its size and its two commonest words, so each member learns how many others
  there are and the best of them. Members differ in one letter of the alphabet, so a group has at most 90 (26 + 64).
* indels: each distinct deletion of a word is looked up in the vocabulary by an equi-join; a hit counts for both words.

Both give one row for each word and group or hit, which one aggregate combines: rows are linear in the letters of the vocabulary.
A word's form is its near word of the largest count (ties: the smallest in code-point order), if that count is at least
`ratio` times its own. Counts grow by `ratio` with each form, so chains are short; roots are found by pointer doubling.

Keys of groups and deletions are 128 bits of two polynomial hashes, made in time linear in the letters (a run of a million
letters has a million groups, whose prefixes and suffixes are never written out). Words travel as numbers in code-point order.

`misspell`: deletes a letter of some runs before they are counted, to plant errors: with h the crc32 of `<doc_id>:<run>`,
runs with h divisible by `misspell` lose letter h modulo their length.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in h; repeated rows count each;
an empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import buffers, inverse_powers, lean, mix, powers, row_chunks, turn_to
from meterglass.runtime import discard, settled, ship

LEAST_LENGTH, LEAST_COUNT, RATIO, MISSPELL = 6, 5, 5, 199
CHUNK = 1 << 18  # letters whose groups are made at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = "k1 long, k2 long, n long, id long"


def misspelt(doc_id: Column, word: Column, every: int) -> Column:
    """The word, without one letter where the hash of document and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspell: int | None = None) -> DataFrame:
    """word, n. Runs that are too short for any word are not split off; counts are added up in each task before the shuffle."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}"), F.lit(0))).alias("run"))
    word = F.col("run") if misspell is None else misspelt(F.col("doc_id"), F.col("run"), misspell)
    counts = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


class Letters:
    """The letters of some words, and sums of two polynomial hashes over them."""

    def __init__(self, column: pa.Array):
        data, offs = buffers(column)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.offs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
        self.size = np.diff(self.offs)
        self.word = np.repeat(np.arange(self.size.size), self.size)
        self.place = np.arange(points.size) - self.offs[self.word]
        self.points = points
        scale = powers(int(self.size.max(initial=0)) + 1)[self.place]
        self.terms = [mix(points.astype(np.uint64) + np.uint64(seed)) * scale for seed in (1 << 32, 7 << 40)]
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(t))) for t in self.terms]

    def sealed(self, h: np.ndarray, length: np.ndarray, kind: int) -> pa.Array:
        return pa.array(mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)).view(np.int64))

    def whole(self) -> list[pa.Array]:
        """The key of each word."""
        return [self.sealed(s[self.offs[1:]] - s[self.offs[:-1]], self.size, 0) for s in self.sums]

    def wildcards(self) -> list[pa.Array]:
        """The key of each word with each letter in turn left blank."""
        blank = self.place + 1
        return [self.sealed((s[self.offs[1:]] - s[self.offs[:-1]])[self.word] - t + blank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), self.size[self.word], 1) for s, t in zip(self.sums, self.terms, strict=True)]

    def deletions(self) -> tuple[list[pa.Array], np.ndarray]:
        """The key of each distinct word that lacks a letter, and whose it is: of a run of equal letters one is deleted."""
        at = np.flatnonzero((self.place == 0) | np.append(True, self.points[1:] != self.points[:-1])[: self.points.size])
        own = self.word[at]
        back = inverse_powers(2)[1]
        keys = [self.sealed((s[at] - s[self.offs[own]]) + (s[self.offs[own + 1]] - s[at + 1]) * back, self.size[own] - 1, 0) for s in self.sums]
        return keys, own


def keys_of(words: DataFrame, kind: str, least_length: int = 1) -> DataFrame:
    """k1, k2, n, id: the keys of words (id, word, n). kind: "whole", "wildcards" or "deletions" (those of least_length letters or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("spelling")
        for batch in lean(batches):
            for x, y in row_chunks(buffers(batch.column("word"))[1], CHUNK):
                part = batch.slice(x, y - x)
                letters = Letters(part.column("word"))
                if kind == "deletions":
                    keys, own = letters.deletions()
                    keep = letters.size[own] > least_length
                    keys, own = [k.filter(pa.array(keep)) for k in keys], own[keep]
                else:
                    keys, own = (letters.whole(), np.arange(len(part))) if kind == "whole" else (letters.wildcards(), letters.word)
                own = pa.array(own)
                yield pa.record_batch([*keys, part.column("n").take(own), part.column("id").take(own)], names=["k1", "k2", "n", "id"])

    return words.select("id", "word", "n").mapInArrow(run, KEYS)


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """id, n_near and best (n and id of the commonest near word, n negated so that the least is the best) of words (id, word, n) that have a near one."""
    ranked = F.struct((-F.col("n")).alias("n"), "id")
    # at most 90 members: a group is as large as the alphabet
    groups = keys_of(words, "wildcards").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(ranked)).alias("members")).filter(F.size("members") > 1)
    others = groups.select((F.size("members") - 1).cast("long").alias("n_near"), F.get("members", F.lit(0)).alias("first"), F.get("members", F.lit(1)).alias("second"), F.explode("members").alias("own"))
    replaced = others.select("own.id", "n_near", F.when(F.col("own.id") == F.col("first.id"), F.col("second")).otherwise(F.col("first")).alias("best"))
    longer = keys_of(words, "deletions", least_length).select("k1", "k2", ranked.alias("longer"))
    hits = longer.join(keys_of(words, "whole").select("k1", "k2", ranked.alias("shorter")), ["k1", "k2"])
    each = F.array(F.struct(F.col("longer.id").alias("id"), F.col("shorter").alias("best")), F.struct(F.col("shorter.id").alias("id"), F.col("longer").alias("best")))
    indels = hits.select(F.inline(each)).select("id", F.lit(1).cast("long").alias("n_near"), "best")
    return replaced.unionByName(indels).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the last of the chain from each id. forms: id, form, without cycles."""
    links = settled(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = settled(links.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(links)
        if new.filter("moved").isEmpty():
            return new.select("id", "root")
        links = new


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, misspell: int | None = None) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n and root."""
    spark = docs.sparkSession
    ship(spark)
    # sorted by ranges, so numbers follow the code points
    words = settled(vocabulary(docs, least_length, least_count, misspell).orderBy("word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = neighbours(words, least_length).select("id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best"))
    known = settled(words.select("id", "n").join(near, "id", "left").select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(f) for c, f in (("best", "form"), ("best_n", "form_n")))), "spelling-forms")
    last = roots(known.filter("form is not null").select("id", "form"))
    name = lambda n: words.select(F.col("id").alias(f"{n}_id"), F.col("word").alias(n))
    changed = known.filter("form is not null").select("id", F.col("form").alias("form_id")).join(last.select("id", F.col("root").alias("root_id")), "id")
    changed = changed.join(name("form"), "form_id").join(name("root"), "root_id").select("id", "form", "root")
    out = words.join(known.select("id", "n_near", "form_n"), "id").join(changed, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: In SQL, at the query's parameters. CRC is also what other corpus operators use.
CRC_TABLE = "crc_steps AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i)), crc_table AS (SELECT list(v ORDER BY i) AS l FROM crc_steps)"
CRC = "xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda c, b: xor(c >> 8, l[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)"
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
hexed AS (SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs WHERE length(w) >= {LEAST_LENGTH}),
hashed AS (SELECT w, {CRC} AS h FROM hexed, crc_table),
counted AS (SELECT CASE WHEN h % {MISSPELL} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM counted WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING count(*) >= {LEAST_COUNT}),
wild AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, i) || '*' || substr(word, i + 2))) AS k FROM v),
short AS (SELECT DISTINCT word, n, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2))) AS k FROM v),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM short s JOIN v ON v.word = s.k UNION ALL SELECT v.word, s.word, s.n FROM short s JOIN v ON v.word = s.k),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM pairs GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN near END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
