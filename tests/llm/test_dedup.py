import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_ROWS, PASSAGE, SCHEMA, SPACES, documents

from meterglass.llm import bagminhash, exact_dedup, suffix_dedup, suffix_sort
from meterglass.llm.common import merged
from meterglass.llm.substring_dedup import substring_dedup

SMALL = list({(i, t): (i, t, s) for i, t, s in ODD_ROWS}.values())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_substrings_equal_brute_force(spark):
    seen, want = set(), {}
    for i, t, _ in sorted(SMALL, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    rows = substring_dedup(documents(spark)).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_suffixes_equal_brute_force(spark):
    texts = [(i, (t or "").encode()) for i, t, _ in SMALL]
    count = Counter(t[a : a + 200] for _, t in texts for a in range(len(t) - 199))
    want = {}
    for i, t in texts:
        keep = bytearray(b"1" * len(t))
        for a in range(len(t) - 199):
            if count[t[a : a + 200]] > 1:
                keep[a : a + 200] = b"0" * 200
        left = bytes(c for c, k in zip(t, keep, strict=True) if k == 49)
        want[i] = (len(t), len(t) - len(left), len([x for x in bytes(keep).split(b"1") if x]), sha(left))
    rows = suffix_dedup.suffix_dedup(documents(spark, SMALL)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_repeated_rows_lose_what_they_share(spark):
    rows = suffix_dedup.suffix_dedup(documents(spark, [(4, PASSAGE, ""), (4, PASSAGE, "")])).collect()
    assert len(rows) == 2 and all(r.n_removed == len(PASSAGE) for r in rows)


@pytest.mark.parametrize("seed", range(30))
def test_difference_cover_sorts_suffixes(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 3, rng.integers(1, 80))
    rank = suffix_dedup.ranks_of(suffix_dedup.difference_cover_ranks(s, 200))[0]
    order = sorted(range(s.size), key=lambda i: tuple(s[i:]))
    assert [int(i) for i in np.argsort(rank)] == order


def test_the_sort_across_the_cluster_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), 60)), "".join(rng.choice(list("abc"), 41)), "", None, "abab" * 9, "short"]
    texts += [texts[0][10:40] + "é", texts[1]]
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    for k in (7, 12):
        count = Counter(t[a : a + k] for t in raw for a in range(len(t) - k + 1))
        want = {(i, a) for i, t in enumerate(raw) for a in range(len(t) - k + 1) if count[t[a : a + k]] > 1}
        assert {tuple(r) for r in suffix_sort.repeated_places(docs, k).collect()} == want
    # the order itself
    s = [int(x) for x in rng.integers(1, 3, 50)]
    seq = spark.createDataFrame(list(enumerate(s)), "pos long, sym long")
    rank = {r.pos: r.rank for r in suffix_sort.suffix_ranks(seq, 50, 50).collect()}
    assert sorted(range(50), key=rank.get) == sorted(range(50), key=lambda i: s[i:])


def test_pieces_cover_each_window_once():
    offs = np.array([0, 10, 10, 1000])
    windows = Counter((r, a + j) for part in suffix_dedup.pieces(offs, 20, 100) for r, a, b in part for j in range(b - a - 19))
    assert all(n == 1 for n in windows.values()) and len([w for w in windows if w[0] == 2]) == 990 - 19


def test_intervals_merge_within_groups():
    a, b, g = merged(np.array([5, 0, 3, 7]), np.array([6, 4, 5, 9]), np.array([0, 0, 0, 1]))
    assert list(zip(a, b, g, strict=True)) == [(0, 6, 0), (7, 9, 1)]


@pytest.mark.parametrize("digest_bytes", [8, 1, 0])
def test_exact_dedup_equals_brute_force_whatever_the_digest(spark, digest_bytes):
    rows = SMALL + [(20, " " + PASSAGE.replace(" ", "\n\n"), ""), (21, PASSAGE, ""), (22, " \t", "")]
    groups = {}
    for i, t, _ in rows:
        groups.setdefault("".join(c for c in t or "" if c not in SPACES), []).append((-len(t or ""), i is None, i or 0, i))
    want = {}
    for text, members in groups.items():
        keep = min(members)[3]
        for m in members:
            want[m[3]] = (keep, len(members), m[3] == keep, sha(text.encode()))
    got = exact_dedup.exact_dedup(documents(spark, rows), digest_bytes, memtable_bytes=400).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    kept = exact_dedup.kept_documents(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "spans"] and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, w in want.items() if w[2])


def test_one_of_equal_rows_stays(spark):
    assert exact_dedup.kept_documents(documents(spark, [(1, "a b", ""), (1, "a b", ""), (2, "ab", "")])).count() == 1


def test_filter_has_no_false_negatives():
    d = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    b = exact_dedup.Bloom.load(exact_dedup.Bloom(d).dump())
    assert b.may_hold(d).all() and b.may_hold(d + np.uint64(1)).mean() < 0.1


def brute_classes(rows, similarity=0.8):
    bags = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        bags[i] = Counter(zip(*(w[k:] for k in range(5)), strict=False))
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in bags if bags[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bagminhash.overlap(bags[a], bags[b]) >= similarity:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in bags}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [r for r in SMALL if r[0] is not None]
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for c in range(12):
            text = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 8)):
                text[at] = f"new{g}_{c}_{at}"
            rows.append((100 + g * 20 + c, " ".join(text), ""))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicate_edges(spark):
    rows = {r.doc_id: r for r in bagminhash.near_duplicates(documents(spark)).collect()}
    assert rows[1].class_id == 1 and rows[2].class_size == 1 and rows[3].kept
    assert rows[6].class_id == 4 and rows[None].class_id == 4 and not rows[None].kept


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 400, dtype=np.uint64)
    wa, wb = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = (bagminhash.bag_signatures(e[w > 0], np.zeros((w > 0).sum(), np.int64), w[w > 0], 1, 4096) for w in (wa, wb))
    assert abs((a == b).mean() - true) < 0.04


@pytest.mark.parametrize("seed", range(6))
def test_joining_links_give_the_components(seed):
    rng = np.random.default_rng(seed)
    bags = [Counter({(bytes([c]),): int(n) for c, n in enumerate(rng.integers(0, 4, 60)) if n}) for _ in range(40)]
    hub = bags[0]
    differs = [bagminhash.differences(b, hub) for b in bags]
    begin = np.concatenate(([0], np.cumsum([d.size for d in differs])))
    size, shared = (np.array([f(b) for b in bags]) for f in (Counter.total, lambda b: (b & hub).total()))
    for s in (0.42, 0.45, 0.5):
        for side in (np.zeros(40, np.int64), np.arange(40) % 3 % 2):
            label = np.arange(40) // 2
            links = bagminhash.joining_links(size, shared, hub.total(), begin, np.concatenate(differs), label, side, s)
            assert all(bagminhash.overlap(bags[i], bags[j]) >= s for i, j in links) and len(links) <= 19
            for edges in (links, [(i, j) for i in range(40) for j in range(i) if (side[i] != side[j] or not side.any()) and bagminhash.overlap(bags[i], bags[j]) >= s]):
                comp = label.copy()
                for i, j in edges:
                    comp[comp == comp[j]] = comp[i]
                first = {c: int(np.flatnonzero(comp == c)[0]) for c in comp}
                edges[:] = [first[c] for c in comp]
                if edges is links:
                    got = edges
            assert got == edges


def test_a_large_bucket_in_blocks_gives_the_same_classes(spark, monkeypatch):
    # one group whose members differ from the hubs too much, so that most links are found between blocks
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(300)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.integers(0, 300, 9):
            text[at] = f"new{rng.integers(0, 3)}_{at}"
        rows.append((i, " ".join(text), ""))
    docs = documents(spark, rows)
    want = brute_classes(rows)
    assert len(set(want.values())) > 1
    whole = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs, bands=60, rows_of_band=2).collect()}
    block = bagminhash.spanning_links
    monkeypatch.setattr(bagminhash, "spanning_links", lambda rest, s: block(rest, s, block_nodes=7))
    parts = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs, bands=60, rows_of_band=2).collect()}
    assert whole == parts == want


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup.suffix_dedup, exact_dedup.exact_dedup, bagminhash.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_copies_are_removed_by_row(spark):
    rng = random.Random(11)
    prose = [" ".join("".join(rng.choice("aeioumnrst") for _ in range(6)) for _ in range(120)) for _ in range(6)]
    near = [t.replace(t.split()[60], "other") for t in prose]
    rows = [
        (1, prose[0], "a"), (None, near[0], "b"), (None, prose[1], "c"),  # a null-id copy takes no other null-id row along
        (7, prose[2], "d"), (7, near[0] + " end", "e"),  # nor does a copy under a shared id
        (None, prose[3], "f"), (None, near[3], "g"), (None, " " + prose[3], "h"),  # of null ids alone, one stays
        (9, prose[4], "i"), (9, near[4], "j"), (9, prose[4].replace(" ", "\t"), "k"),  # and of one shared id
        (None, "short", "l"), (None, None, "m"), (None, "short", "n"),
    ]
    got = bagminhash.kept_documents(spark.createDataFrame(rows, SCHEMA))
    kept = "".join(sorted(r.spans for r in got.collect()))
    assert got.columns == ["doc_id", "text", "spans"] and set("acdlmn") <= set(kept) and not set("be") & set(kept)
    assert sum(c in kept for c in "fgh") == 1 and sum(c in kept for c in "ijk") == 1
