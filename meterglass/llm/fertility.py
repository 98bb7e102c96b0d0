"""Quality rules: base counts of each text, and the fertility of public tokenisers on it.

Base counts are exact. The method's verdict measures, with each of several public
vocabularies over the words of the text:

* characters per token (low: the vocabulary does not know the text),
* the share of byte-fallback tokens (byte pieces, unknown pieces, parts of a character),
* the entropy of the token distribution in bits (low: few tokens, repeated),

and rejects a text outside the bands of its language and length. Bands are fitted to the
corpus. Languages are those of the column `lang`, or the script of most letters where there is none
(judged by UTF-8 lead bytes); lengths are powers of two of the number of words, as
entropy grows with length. The quartiles q1 and q3 of each measure, over all documents of
a language and length that pass the base rule, give the band from q1 - FENCE * spread
to q3 + FENCE * spread, where spread is q3 - q1, but at least LEAST_SPREAD (of the median, for
characters per token): normal deviates are rejected once in a million, and a corpus of copies does not shrink
the band to a point. A length with under `least_rows` documents takes the band of its whole
language, a language with so few the fixed band of its script. Quartiles come from
exact counts of measures rounded down to 1 / STEPS, so they are alike however the
table is laid out.

Defined cases: null text is empty; an empty text fails the base rule (no 50 words);
null doc_id, null lang and repeated rows pass through (each row counts); words of over WORD_POINTS
characters are measured in pieces of that size; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterglass.llm.common import IS_SPACE, Words, buffers, lean, row_chunks, turn_to
from meterglass.llm.sentencepiece_codec import DEFAULT_MODEL, load
from meterglass.runtime import settled, ship

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
CACHED_BYTES = 48 << 20
MEASURED_BYTES = 1 << 20  # texts measured at a time
WORD_POINTS = 1000
#: Public vocabularies by name: SentencePiece models (.model) and ranks of byte-level BPE (.tiktoken).
VOCABULARIES = {"piece": DEFAULT_MODEL, "multi": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: How byte-level vocabularies cut words before merging (fixed by the vocabularies).
WORD_PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
FENCE, LEAST_ROWS, STEPS = 3.0, 50, 200
LEAST_SPREAD = {"chars_per_token": 0.03, "fallback_share": 0.02, "token_entropy": 0.15}
ANY_LENGTH = -1
MOST_BROADCAST = 20_000  # rows of bands, some 4 MB


class Band(NamedTuple):
    """A text is kept if its three measures lie within these limits."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: By script, for languages with too few documents to fit bands to. Latin text of any language has over 1.5 characters
#: a token in a 32k vocabulary; Han, kana and Hangul fall back to three byte tokens for many characters.
BANDS = {"latin": Band(1.5, 12.0, 0.15, 4.5), "cyrillic": Band(1.0, 12.0, 0.25, 3.0), "cjk": Band(0.3, 6.0, 0.95, 3.0), "other": Band(0.25, 12.0, 1.0, 2.0)}
SCRIPTS = list(BANDS)

LEAD = np.full(256, 3, np.int8)  # script of a character by its lead byte; -1: no letter, or inside a character
LEAD[0x00:0x80] = -1
LEAD[0x41:0x5B] = LEAD[0x61:0x7B] = 0
LEAD[0x80:0xC0] = -1
LEAD[0xC2] = -1
LEAD[0xC3:0xCA] = 0
LEAD[0xD0:0xD4] = 1
LEAD[0xE1] = 3
LEAD[0xE2] = -1
LEAD[0xE3:0xEE] = 2
LEAD[0xF0:0xF8] = -1
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_CHAR = np.ones(256, bool)
IS_CHAR[0x80:0xC0] = False
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def measure_names(vocabularies: dict[str, str]) -> list[tuple[str, str]]:
    """Column and kind of each measure."""
    return [(f"{v}_{m}", m) for v in vocabularies for m in MEASURES]


def schema_of(vocabularies: dict[str, str]) -> str:
    return BASE + ", script string, size_class int, " + ", ".join(f"{v}_n_tokens long, " + ", ".join(f"{v}_{m} double" for m in MEASURES) for v in vocabularies)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def repeated_words(ids: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row in 3-word windows that it holds twice or more, the first included. ids: exact numbers of the words."""
    n = ids.size
    windows = n - 2
    if windows <= 0:
        return np.zeros(rows, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:windows])
    # exact names of the windows: pairs first, then (document, pair, word)
    pair = np.unique((ids[at] << 32) | ids[at + 1], return_inverse=True)[1]
    triple = np.unique((pair.astype(np.int64) << 32) | ids[at + 2], return_inverse=True)[1]
    key = (doc[at].astype(np.int64) << 32) | triple
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(s.size, bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    hit = at[order[same]]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(doc[covered], minlength=rows).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


class Pieces:
    """A SentencePiece model; each word is its own ▁word."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = self.model.get_piece_size()
        self.fallback = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])

    def ids(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class Ranks:
    """Byte-level BPE by ranks; each word follows a space. Tokens that end inside a character are fallback tokens."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.coder = tiktoken.Encoding("ranks", pat_str=WORD_PARTS, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.fallback = np.zeros(self.size, bool)
        for piece, rank in ranks.items():
            self.fallback[rank] = piece.decode("utf-8", "ignore").encode() != piece

    def ids(self, words: list[str]) -> list[list[int]]:
        encode = self.coder.encode_ordinary
        return [encode(" " + w) for w in words]


class Lexicon:
    """The tokens of words under some vocabularies. Words are coded once, and kept up to a bound of bytes."""

    def __init__(self, vocabularies: tuple[tuple[str, bytes], ...]):
        self.vocabularies = [(Pieces if name.endswith(".model") else Ranks)(raw) for name, raw in vocabularies]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        # by vocabulary: tokens of all words one after another, where each word's begin
        self.tokens = [np.zeros(0, np.int32) for _ in self.vocabularies]
        self.begin = [np.zeros(1, np.int64) for _ in self.vocabularies]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each of some distinct words."""
        if self.held > CACHED_BYTES:
            self.forget()
        missing = [w for w in words if w not in self.place]
        if missing:
            texts = [w.decode("utf-8", "replace") for w in missing]
            parts = np.fromiter((max(1, -(-len(t) // WORD_POINTS)) for t in texts), np.int64, len(texts))
            if parts.max() > 1:
                texts = [t[k : k + WORD_POINTS] for t in texts for k in range(0, max(1, len(t)), WORD_POINTS)]
            own = np.cumsum(parts)
            for v, vocabulary in enumerate(self.vocabularies):
                coded = vocabulary.ids(texts)
                ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(ends[-1]))
                self.begin[v] = np.concatenate((self.begin[v], self.begin[v][-1] + ends[own - 1]))
                self.tokens[v] = np.concatenate((self.tokens[v], flat))
                self.held += flat.nbytes + 8 * len(missing)
            first = len(self.place)
            self.place.update(zip(missing, range(first, first + len(missing)), strict=True))
            self.held += sum(map(len, missing)) + 180 * len(missing)  # with the objects' own size
        place = self.place
        return np.fromiter((place[w] for w in words), np.int64, len(words))

    def measure(self, v: int, place: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte-fallback tokens and token entropy of each row under a vocabulary. place: of each word."""
        vocabulary, begin = self.vocabularies[v], self.begin[v]
        own = begin[place + 1] - begin[place]
        shift = begin[place] - np.concatenate(([0], np.cumsum(own)[:-1]))
        token = self.tokens[v][np.arange(int(own.sum())) + np.repeat(shift, own)].astype(np.int64)
        of = np.repeat(doc, own)
        total = np.bincount(of, minlength=rows).astype(np.int64)
        fallback = np.bincount(of[vocabulary.fallback[token]], minlength=rows).astype(np.int64)
        key = np.sort(of * np.int64(vocabulary.size) + token)
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(head, key.size)).astype(float)
        spread = np.bincount(key[head] // vocabulary.size, weights=count * np.log2(count), minlength=rows)
        some = np.maximum(total, 1)
        return total, fallback, np.maximum(0.0, np.where(total > 0, np.log2(some) - spread / some, 0.0))


@lru_cache(maxsize=1)
def lexicon(vocabularies: tuple[tuple[str, bytes], ...]) -> Lexicon:
    return Lexicon(vocabularies)


def measured(vocabularies: tuple[tuple[str, bytes], ...], data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    """The columns of schema_of for some texts. vocabularies: file name and content of each."""
    rows = len(offs) - 1
    w = Words(data, offs)
    ids, distinct = w.encode()
    n_words = w.counts
    chars = per_row(IS_CHAR[data] & ~IS_SPACE[data], offs)
    symbols = per_row(IS_SYMBOL[data], offs)
    lines = np.array([duplicate_lines(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64)
    repeats = repeated_words(ids, w.doc, rows)
    lead = LEAD[data]
    letters = np.stack([per_row(lead == k, offs) for k in range(len(SCRIPTS))])
    script = np.where(letters.any(axis=0), letters.argmax(axis=0), len(SCRIPTS) - 1)
    failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
    size_class = np.frexp(np.maximum(n_words, 1).astype(float))[1].astype(np.int32) - 1
    columns = [n_words, chars, symbols, lines, repeats, failed, np.array(SCRIPTS, object)[script], size_class]
    held = lexicon(vocabularies)
    place = held.places(distinct.to_pylist())[ids] if ids.size else np.zeros(0, np.int64)
    for v in range(len(vocabularies)):
        tokens, fallback, entropy = held.measure(v, place, w.doc, rows) if ids.size else (np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows))
        some = np.maximum(tokens, 1)
        columns += [tokens, chars / some, fallback / some, entropy]
    return [pa.array(x) for x in columns]


def measures(docs: DataFrame, vocabularies: dict[str, str], text: int) -> DataFrame:
    """All columns of docs, and those of schema_of. text: the place of the texts among them."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tuple((path, load(path)) for path in vocabularies.values()))
    added = [x.split()[0] for x in schema_of(vocabularies).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("fertility", lexicon.cache_clear)
        for batch in lean(batches):
            data, offs = buffers(batch.column(text))
            for x, y in row_chunks(offs, MEASURED_BYTES):
                found = measured(held.value, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
                yield pa.record_batch([*batch.slice(x, y - x).columns, *found], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(schema_of(vocabularies)).fields]))


def limits(rows: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """language, size_class (or ANY_LENGTH), documents, and the least and most of each measure. rows: measures with `language`."""
    names = measure_names(vocabularies)
    cells = F.array(*(F.struct(F.lit(c).alias("measure"), F.floor(F.col(c) * STEPS).cast("int").alias("bin")) for c, _ in names))
    counts = rows.filter("not base_failed").select("language", "size_class", F.inline(cells)).groupBy("language", "size_class", "measure", "bin").agg(F.count("*").alias("n"))
    # as many rows as there are bins, whatever the documents
    both = counts.withColumn("size_class", F.explode(F.array("size_class", F.lit(ANY_LENGTH)))).groupBy("language", "size_class", "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("language", "size_class", "measure")
    ranked = both.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "documents": F.sum("n").over(group)})
    quartile = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("documents"), F.col("bin"))) / STEPS).alias(f"q{round(4 * q)}")
    quartiles = ranked.groupBy("language", "size_class", "measure").agg(F.first("documents").alias("documents"), quartile(0.25), quartile(0.5), quartile(0.75))
    pick = lambda c, x: F.max(F.when(F.col("measure") == c, x))
    found = []
    for c, kind in names:
        least = F.lit(LEAST_SPREAD[kind]) * (F.col("q2") if kind == "chars_per_token" else F.lit(1.0))
        spread = F.greatest(F.col("q3") - F.col("q1"), least)
        found += [pick(c, F.col("q1") - FENCE * spread).alias(f"{c}_least"), pick(c, F.col("q3") + 1 / STEPS + FENCE * spread).alias(f"{c}_most")]
    return quartiles.groupBy("language", "size_class").agg(F.max("documents").alias("documents"), *found)


def judged(rows: DataFrame, vocabularies: dict[str, str], bands: dict[str, Band] | None, least_rows: int) -> DataFrame:
    """rows with `rejected_by` (the measures outside their bands) and `kept`. rows: measures with `language`."""
    names = measure_names(vocabularies)
    of = settled(limits(rows, vocabularies), "bands")
    own = [c for c in of.columns if c not in ("language", "size_class")]
    by_length = of.filter(F.col("size_class") != ANY_LENGTH).withColumnsRenamed({c: f"l_{c}" for c in own})
    by_language = of.filter(F.col("size_class") == ANY_LENGTH).drop("size_class").withColumnsRenamed({c: f"g_{c}" for c in own})
    # a few rows for each language: broadcast, so that no text is shuffled, unless languages are so many that Spark must join by key
    if of.count() <= MOST_BROADCAST:
        by_length, by_language = F.broadcast(by_length), F.broadcast(by_language)
    wide = rows.join(by_length, ["language", "size_class"], "left").join(by_language, "language", "left")
    fixed = bands or BANDS

    def by_script(side: str, kind: str) -> Column:
        place = {("least", "chars_per_token"): 0, ("most", "chars_per_token"): 1, ("most", "fallback_share"): 2, ("least", "token_entropy"): 3}[side, kind]
        out = F.lit(float(fixed["other"][place]))
        for script, band in fixed.items():
            out = F.when(F.col("script") == script, F.lit(float(band[place]))).otherwise(out)
        return out

    def limit(side: str, c: str, kind: str) -> Column:
        return F.when(F.col("l_documents") >= least_rows, F.col(f"l_{c}_{side}")).when(F.col("g_documents") >= least_rows, F.col(f"g_{c}_{side}")).otherwise(by_script(side, kind))

    outside = []
    for c, kind in names:
        low = F.col(c) < limit("least", c, kind) if kind != "fallback_share" else F.lit(False)
        high = F.col(c) > limit("most", c, kind) if kind != "token_entropy" else F.lit(False)
        outside.append(F.when(~F.col("base_failed") & (low | high), F.lit(c)))
    rejected = F.array_join(F.array_compact(F.array(*outside)), ",")
    return wide.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def language_of(given: Column | None) -> Column:
    return F.col("script") if given is None else F.coalesce(given.cast("string"), F.col("script"))


def quality_rules(docs: DataFrame, vocabularies: dict[str, str] | None = None, bands: dict[str, Band] | None = None, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base counts, base_failed, kept, rejected_by, and the measures of the method.

    bands: the fixed bands by script (of `other`, too); least_rows: how many documents a fitted band needs."""
    vocabularies = vocabularies or VOCABULARIES
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    # numbers only; the texts are not kept
    rows = settled(measures(source, vocabularies, 1).drop("text").withColumn("language", language_of(F.col("lang"))).drop("lang"), "fertility")
    out = judged(rows, vocabularies, bands, least_rows)
    numbers = [x.split()[0] for x in schema_of(vocabularies).split(", ")]
    return out.select("doc_id", *numbers[:6], "kept", "rejected_by", "language", *numbers[6:])


def kept_documents(docs: DataFrame, vocabularies: dict[str, str] | None = None, bands: dict[str, Band] | None = None, least_rows: int = LEAST_ROWS, lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rows are measured once and written with
    their measures; bands are fitted to the measures alone; no shuffle but of counts."""
    vocabularies = vocabularies or VOCABULARIES
    own = [f"c{i}" for i in range(len(docs.columns))]
    lang = F.col(own[docs.columns.index(lang_col)]) if lang_col in docs.columns else None
    wide = measures(docs.toDF(*own), vocabularies, docs.columns.index("text"))
    rows = settled(wide.withColumn("language", language_of(lang)), "measured")
    return judged(rows, vocabularies, bands, least_rows).filter("kept").select(*own).toDF(*docs.columns)


BASE_ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS a FROM t)),
v AS (SELECT *, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM v WHERE third IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT pos + j) AS n FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS j FROM c WHERE n > 1) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT t.doc_id, coalesce(s.n, 0) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""
