import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD_ROWS, SCHEMA, documents

from meterglass.llm import importance, piecewise, spelling
from meterglass.llm.common import buffers

LOWERED = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_spelling(rows, least_length, least_count, ratio, misspell):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, size = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(v, w)]
        size[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], size[w], None if form[w] is None else words[form[w]])
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("seed", "misspell"), [(1, None), (2, 7)])
def test_spelling_variants_equal_brute_force(spark, seed, misspell):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 6))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "Éaaaaa", "éaaaaa", "àa×÷ÿb"]
    rows = []
    for i in range(60):
        words = [rng.choice(base[: rng.randint(1, len(base))]) for _ in range(60)]
        rows.append((i if i % 9 else None, " 1".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words), "x"))
    rows += [(7, None, "x"), (7, "", "x"), rows[3]]
    got = spelled(spelling.spelling_variants(documents(spark, rows), 3, 2, 2, misspell))
    want = brute_spelling(rows, 3, 2, 2, misspell)
    assert got == want and sum(v[0] is not None for v in want.values()) > 5 and any(v[0] != v[1] for v in want.values() if v[0])


def test_spelling_edges(spark):
    got = spelled(spelling.spelling_variants(documents(spark), misspell=199))
    assert got == brute_spelling(ODD_ROWS, 6, 5, 5, 199)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    # chains: each form is five times as common; a word of many letters
    long = "xy" * 20000
    text = " ".join(["planet"] * 200 + ["planets"] * 30 + ["planetsz"] * 5 + ["Plamet"] * 40 + [long] * 50 + [long + "x"] * 6 + ["z" + long[1:]] * 5)
    rows = [(i, t, "x") for i, t in enumerate(re.findall(".{1,99999}(?: |$)", text))]
    got = spelled(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)))
    assert got["planetsz"] == ("planets", "planet", 5, 1, 30) and got["planet"] == (None, "planet", 200, 2, None)
    assert got["plamet"] == ("planet", "planet", 40, 1, 200)
    assert got[long + "x"][:2] == got["z" + long[1:]][:2] == (long, long)


def test_keys_are_those_of_the_strings():
    words = ["abc", "aab", "bé", "x", "abcc", "aa"]
    letters = spelling.Letters(pa.array(words))
    both = lambda keys: list(zip(*(k.to_pylist() for k in keys), strict=True))
    own = dict(zip(words, both(letters.whole()), strict=True))
    keys, of = letters.deletions()
    cut = Counter((words[i], k) for i, k in zip(of.tolist(), both(keys), strict=True))
    for w in words:
        shorter = {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert sum(n for (v, _), n in cut.items() if v == w) == len(shorter)
        for s in shorter & set(words):
            assert cut[w, own[s]] == 1
    wild = Counter(both(letters.wildcards()))
    assert len(wild) == sum(map(len, words)) and max(wild.values()) == 1
    a, b = (both(spelling.Letters(pa.array([w])).wildcards()) for w in ("abcd", "axcd"))
    assert [x == y for x, y in zip(a, b, strict=True)] == [False, True, False, False]


def brute_resample(docs, target, share, least_words, least, most, buckets, seed):
    def grams(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWERED))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1)]

    s = Counter(b for _, t, *_ in docs for b in grams(t)[1])
    t = Counter(b for _, x in target for b in grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text, *_ in docs:
        n, found = grams(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return sorted((str((*r[:4], drawn.get(id(r)))) for r in out))


@pytest.mark.parametrize(("least", "most", "buckets"), [(1, 1, 10_000), (1, 2, 10_000), (2, 3, 64)])
def test_resampling_equals_brute_force(spark, monkeypatch, least, most, buckets):
    monkeypatch.setattr(importance, "CHUNK", 500)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma's", "x1", "été", "日本", "the", "of"]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 3 :]) for _ in range(rng.randint(0, 60))), "x") for i in range(80)] + list(ODD_ROWS)
    target = [(0, "the alpha beta " * 30), (1, None), (2, "日本 of the alpha!")]
    found = importance.resampled(documents(spark, rows), spark.createDataFrame(target, "item_id long, text string"), 30, 20, least, most, buckets)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_resample(rows, target, 30, 20, least, most, buckets, 2024)


def test_resampling_of_empty_tables(spark):
    nothing, some = spark.createDataFrame([], SCHEMA), documents(spark)
    assert importance.resampled(nothing, some).collect() == []
    rows = importance.resampled(some, nothing).collect()
    assert len(rows) == len(ODD_ROWS) and sum(r.rank is not None for r in rows) == sum(len(re.findall(r"\w+", t or "")) >= 20 for _, t, _ in ODD_ROWS) // 10


def brute_neighbours(rows):
    """What each document's n_chars, edited text and next document are; rows with equal ids and texts are alike."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own, other, following = (piecewise.fingerprint(x) for x in (t, new, after))
        out.append(str((i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, other, piecewise.likeness(own, other), piecewise.likeness(own, following))))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_neighbours_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(-(10**12), 10**12), "".join(rng.choice("abc déf😀\n") for _ in range(rng.randint(0, 400))), "x") for _ in range(n)]
    rows[-1] = (rows[-1][0], None, "x")
    if n > 3:
        rows += [(None, "the only one without an id", "x"), (5, "a row that comes twice", "x"), (5, "a row that comes twice", "x")]
    got = piecewise.edited_likeness(documents(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_neighbours(rows)


def test_neighbours_edges(spark):
    got = piecewise.edited_likeness(documents(spark)).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert piecewise.edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []
    prints = {r.fingerprint for r in piecewise.fingerprints(documents(spark)).collect() if r.doc_id in (1, 2)}
    assert prints == {"0::::"}


def brute_fingerprint(text):
    """By loops: rolling hashes of 7 bytes, first comings, chunks, characters."""
    raw, p = text.encode(), 0x9E3779B97F4A7C15
    codes = [int(c) for c in piecewise.BYTE_CODES]
    wrap = (1 << 64) - 1

    def final(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & wrap
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & wrap
        return x ^ x >> 31

    chunk = lambda a, b: final((sum(codes[c] * pow(p, j, 1 << 64) for j, c in enumerate(raw[a:b])) + (b - a)) & wrap)
    rolled = [(final(sum(codes[c] * pow(p, j, 1 << 64) for j, c in enumerate(raw[i : i + 7])) & wrap) >> 32, i + 6) for i in range(len(raw) - 6)]
    for k in range(40):
        sizes = []
        for size in range(k, k + 4):
            seen, ends = set(), []
            for h, at in rolled:
                if (h + 1) % (3 << size) == 0 and h not in seen:
                    seen.add(h)
                    ends.append(at + 1)
            sizes.append(ends)
        if len(sizes[0]) < 64:
            break
    signatures = []
    for ends in sizes:
        cuts = [0, *ends, *([len(raw)] if not ends or ends[-1] < len(raw) else [])]
        signatures.append("".join(chr(piecewise.ALPHABET[chunk(a, b) & 63]) for a, b in zip(cuts, cuts[1:], strict=False)) if raw else "")
    if raw and len(raw) < 64:
        # every byte is a chunk, before the first three sizes of blocks
        return "0:" + "".join(chr(piecewise.ALPHABET[chunk(i, i + 1) & 63]) for i in range(len(raw))) + "".join(f":{x}" for x in signatures[:3])
    return f"{k + bool(raw)}:" + ":".join(signatures)


def test_fingerprints_equal_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "short", "seven77", "again " * 100, "é" * 50, *("".join(rng.choice("abcdefgh ij\n") for _ in range(n)) for n in (30, 200, 500, 1500))]
    assert [piecewise.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_likeness_follows_what_texts_share():
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for n in (40, 200, 1000, 5000):
        a, b = words(n), words(n)
        own = piecewise.fingerprint(a)
        assert piecewise.likeness(own, piecewise.fingerprint(piecewise.edited(a, b))) > 0.35 > 0.2 > piecewise.likeness(own, piecewise.fingerprint(b))
        one = a.split()
        one[n // 3] = "changed"
        assert piecewise.likeness(own, piecewise.fingerprint(" ".join(one))) > 0.85
        assert piecewise.likeness(own, own) == 1.0
    brute = lambda a, b: max(len(a), len(b)) and _common(a, b)
    for _ in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))) for _ in "ab")
        assert piecewise.common_length(a, b) == brute(a, b)


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else [0, *_next(row, x, b)]
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out[1:]


def test_likeness_as_a_column(spark):
    rows = [("a", piecewise.fingerprint("some text " * 5), None), ("b", "1:abc:ab:a:a", "1:abc:ab:a:a")]
    got = {r.n: r.v for r in spark.createDataFrame(rows, "n string, x string, y string").select("n", piecewise.like("x", "y").alias("v")).collect()}
    assert got == {"a": None, "b": 1.0}
    assert np.array_equal(buffers(pa.array(["x", None]))[1], [0, 1, 1])
