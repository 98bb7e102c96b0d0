"""Chains: of coders around secrets, of features to scores, of stages over odd tables."""

import base64
import gzip
import math
import random
import urllib.parse
import zlib

import numpy as np
import pytest
from helpers import PASSAGE

from meterglass.llm import bagminhash, secrets
from meterglass.llm import subword_model as model

CODERS = {
    "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "entities": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "base64url": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("seed", range(60))
def test_random_secrets_in_random_chains_of_coders(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kind = rng.randrange(3)
    made = [
        f"{rng.choice(['password', 'Token', 'api_key'])}={''.join(rng.choice(letters) for _ in range(rng.randint(8, 30)))}",
        "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(32, 64))),
    ][kind]
    inner = f"some words {made} and more"
    names = [rng.choice(list(CODERS)) for _ in range(rng.randint(1, 4))]
    for name in names:
        inner = CODERS[name](inner)
    before = "prose before, " * rng.randint(1, 3)
    text = f"{before}{inner} prose after"
    base, every, oversized = secrets.find(text)
    found = [(a, b) for a, k, b in every if k == kind]
    # the span lies within what was encoded
    assert any(len(before) <= a < b <= len(before) + len(inner) for a, b in found), names
    assert set(base) <= set(every) and not oversized


def test_oversized_data_inside_oversized_data_is_read_to_the_budget():
    secret = b"password=abcdefgh12"
    lines = b"".join(b"line %d of the data, nothing in it\n" % i for i in range(1500))
    inner = gzip.compress(lines + secret + b"\n" + lines[:9000])
    noise = random.Random(1).randbytes(3000)
    text = base64.b64encode(gzip.compress(noise + inner + noise)).decode()
    most = 16 << 10
    _, every, oversized, unread = secrets.followed(text, most)
    assert [k for _, k, _ in every] == [0] and oversized and not unread
    far = gzip.compress(lines * 40 + secret)
    _, every, _, unread = secrets.followed(base64.b64encode(gzip.compress(noise * 4 + far + noise)).decode(), most)
    assert unread and not every


def brute_features(text, buckets):
    """Hashed features of a text by loops over its words, and the weight of each."""
    words = text.encode().split()
    one = lambda data, offs: model.hash_slices(np.frombuffer(data, np.uint8), np.array(offs))
    found = []
    codes = [int(one(w, [0, len(w)])[0]) for w in words]
    found += codes
    for i in range(len(words) - 1):
        found.append(int(model.hash_runs(np.array(codes[i : i + 2], np.uint64), 2)[0]))
    for back in (1, 2):
        found += [int(model.REPEATED[back - 1])] * sum(words[i] == words[i - back] for i in range(back, len(words)))
    for w in words:
        points = [0x110000, *map(ord, w.decode()), 0x110001]
        letters = model.mix(np.array(points, np.uint64) + np.uint64(7))
        for n in model.GRAMS:
            for i in range(len(points) - n + 1):
                found.append((int(model.hash_runs(letters[i : i + n], n)[0]) + n) % (1 << 64))
    out = {}
    for h in found:
        out[h % buckets] = out.get(h % buckets, 0) + 1
    return {k: v / len(found) for k, v in out.items()}


TEXTS = ["the cat sat on the mat", "été été naïve 日本 x", "again again again", "a", PASSAGE[:200]]


@pytest.mark.parametrize("text", TEXTS)
def test_features_equal_brute_force(text):
    at, weight = model.features(text.encode(), 1 << 12)
    want = brute_features(text, 1 << 12)
    assert dict(zip(at.tolist(), weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)


def test_a_step_follows_the_gradient_by_finite_differences():
    buckets, dimension, rate = 64, 4, 0.1
    rows = [(1, *model.features(TEXTS[0].encode(), buckets)), (0, *model.features(TEXTS[1].encode(), buckets))]
    rng = np.random.default_rng(model.SEED)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (buckets, dimension)).astype(np.float32).astype(float)
    layer, bias = np.zeros((2, dimension)), np.zeros(2)
    order = rng.permutation(len(rows))

    def loss(label, at, weight, v, u, b):
        s = u @ (weight @ v[at]) + b
        return -s[label] + math.log(np.exp(s).sum())

    def slope(f, x, h=1e-5):
        out = np.zeros_like(x)
        for i in np.ndindex(*x.shape):
            y, z = x.copy(), x.copy()
            y[i] += h
            z[i] -= h
            out[i] = (f(y) - f(z)) / (2 * h)
        return out

    for done, i in enumerate(order):
        label, at, weight = rows[i]
        step = rate * (1 - done / len(rows))
        own_layer, own_bias, own = (slope(lambda x: loss(label, at, weight, vectors, x, bias), layer), slope(lambda x: loss(label, at, weight, vectors, layer, x), bias), slope(lambda x: loss(label, at, weight, x, layer, bias), vectors))  # noqa: B023
        # a feature's step is on the scale of the square root of its share
        scale = np.zeros(buckets)
        scale[at] = 1 / np.sqrt(weight)
        # vectors move by the layer before its own step
        layer_before, layer = layer, layer - step * own_layer
        p = np.exp(layer_before @ (weight @ vectors[at]) + bias)
        p /= p.sum()
        p[label] -= 1
        assert np.allclose(own[at], np.outer(weight, layer_before.T @ p), atol=1e-6)
        vectors[at] -= step * (np.sqrt(weight)[:, None] * (layer_before.T @ p)[None, :])
        bias = bias - step * 0.1 * own_bias
    made = model.train(rows, 2, buckets, dimension, epochs=1, rate=rate)
    assert np.allclose(made.table, vectors @ layer.T, atol=1e-5) and np.allclose(made.bias, bias, atol=1e-5)


def test_scores_equal_brute_force():
    buckets = 1 << 12
    rows = [(i % 2, *model.features(t.encode(), buckets)) for i, t in enumerate(TEXTS)]
    made = model.train(rows, 2, buckets, epochs=3)
    raw = [t.encode() for t in [*TEXTS, ""]]
    offs = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    p, words = model.probabilities(made, np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, t in enumerate([*TEXTS, ""]):
        score = made.bias.astype(float).copy()
        for f, w in (brute_features(t, buckets) if t else {}).items():
            score += w * made.table[f]
        want = np.exp(score) / np.exp(score).sum()
        assert words[i] == len(t.split()) and np.allclose(p[i], want, atol=1e-6)


def test_near_copies_under_names_with_dots(spark):
    rows = [(1, PASSAGE, "a"), (2, PASSAGE + " tail", "b"), (3, "other words here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    kept = bagminhash.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == ["a", "c"]


def test_pipeline_over_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    syllables = ["lo", "ra", "me", "ti", "sun", "gar", "pel", "o", "vi", "ter"]
    prose = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(90)) + "." for _ in range(12)]
    rows = [(i, t, "en", "web", len(t), "x") for i, t in enumerate(prose)]
    rows += [(None, prose[0], "en", None, 5, "x"), (None, None, None, None, None, None), (50, "", "en", "web", 0, "x"), (3, prose[3], "en", "web", 9, "x"), (51, prose[4].replace(" ", "  "), None, "web", 9, "y"), (52, prose[5] + " end", "en", "web", 9, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(6)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    kept = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = [r.doc_id for r in kept]
    # of document 4 the copy with more code points stays, of 5 the first
    assert sorted(ids) == sorted({*range(12), 51} - {4}) and all(r.round_trip for r in kept)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []


def test_pipeline_reads_the_documents_table_in_its_first_stage_alone(spark, tmp_path, monkeypatch):
    import shutil

    import corpus_pipeline

    rng = random.Random(9)
    syllables = ["lo", "ra", "me", "ti", "sun", "gar", "pel", "o", "vi", "ter"]
    prose = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(90)) + "." for _ in range(8)]
    spark.createDataFrame([(i, t) for i, t in enumerate(prose)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    settled = corpus_pipeline.settled

    def written(df, what):
        out = settled(df, what)
        shutil.rmtree(tmp_path / "documents.parquet", ignore_errors=True)
        return out

    monkeypatch.setattr(corpus_pipeline, "settled", written)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(8))
