"""Isolation forests (Liu et al. 2008), grown across tasks and kept in parts.

A device's trees are dealt in parts. A part's task sees the rows that its trees draw from: all of a device where trees take
whole samples, else at most some POOL of them, which a hash of key and part picks. A tree of a smaller sample takes the rows
with the least hashes of key and tree (a keyed bottom-k). Trees come from such hashes alone - of seed, tree, node and
feature, by 32-bit arithmetic that SQL can repeat - so they do not depend on partitions, and a lost task grows the same trees.

A part is arrays over its nodes, the roots first: feature (-1: a leaf), cut (rows below it go left), left (place of the left
child; the right one follows it) and value (of a leaf: depth, and the mean path among its rows). A part scores
rows apart, and sums of path lengths are added up by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.operators.bundles import Vectors, bundled, count_for, units
from meterglass.operators.vectors import to_map
from meterglass.runtime import dealt as spread
from meterglass.runtime import settled, ship, shuffle_partitions

SEED = 42
POOL = 16384  # rows, on average, that the trees of a part draw their samples from
NODES = 100_000  # of a part
CELLS = 500_000  # numbers that are worked on at a time
BLOCK_ROWS = 50_000  # scored rows of a block, or as many as the trees of a part learn from
MASK, START, MIXERS = (1 << 32) - 1, 2654435769, (2146121005, 2221713035, 3168867693)
ARRAYS = ("feature", "cut", "left", "value")


def drawn(*parts: np.ndarray | int) -> np.ndarray:
    """32 bits from numbers, alike in numpy and SQL."""
    h = np.uint64(START)
    for p in parts:
        h = (h + np.asarray(p, np.uint64)) & np.uint64(MASK)
        for c in MIXERS:
            h = ((h ^ (h >> np.uint64(15))) * np.uint64(c)) & np.uint64(MASK)
    return h ^ (h >> np.uint64(16))


def unit(*parts: np.ndarray | int) -> np.ndarray:
    """A number above 0, up to 1."""
    return (drawn(*parts).astype(float) + 1) / 2.0**32


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 9, 8), 16, 10).cast("long")


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def depth_limit(sample: int) -> int:
    return int(np.ceil(np.log2(max(2, sample))))


def grow(train: np.ndarray, tree: np.ndarray, limit: int, seed: int) -> dict[str, np.ndarray]:
    """Random trees, all grown level by level together; rows are kept in the order of their nodes. train: trees x sample x features."""
    trees, sample, width = train.shape
    x = train.reshape(-1, width)
    size, heap = np.full(trees, sample), np.ones(trees, np.int64)
    before = 0
    out: dict[str, list[np.ndarray]] = {k: [] for k in ARRAYS}
    for depth in range(limit + 1):
        count = size.size
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        # a side is empty where a cut is rounded to an end of its range
        filled = np.flatnonzero(size)
        low, high = np.zeros((2, count, width))
        low[filled], high[filled] = np.minimum.reduceat(x, start[filled], axis=0), np.maximum.reduceat(x, start[filled], axis=0)
        wide = high > low
        leaf = (size <= 1) | ~wide.any(axis=1) | (depth == limit)
        own = np.arange(count)
        lots = unit(seed, tree[:, None], heap[:, None], np.arange(width + 1))  # the first for the cut, then one for each feature
        column = np.where(wide, lots[:, 1:], -1.0).argmax(axis=1)
        least, most = low[own, column], high[own, column]
        cut = np.where(leaf, 0.0, least + (most - least) * lots[:, 0])
        inner = np.cumsum(~leaf) - 1
        for k, v in zip(ARRAYS, (np.where(leaf, -1, column), cut, np.where(leaf, -1, before + count + 2 * inner), np.where(leaf, depth + path_length(size), 0.0)), strict=True):
            out[k].append(v)
        if leaf.all():
            break
        keep = np.repeat(~leaf, size)
        node = np.repeat(own, size)[keep]
        x, at = x[keep], inner[node]
        right = x[np.arange(node.size), column[node]] >= cut[node]
        # both sides of a node keep their order: a place is the side's start and how many of the side came before
        rights = np.bincount(at, weights=right, minlength=inner[-1] + 1).astype(np.int64)
        sizes = size[~leaf]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        seen = np.cumsum(right)
        seen_before = np.concatenate(([0], np.cumsum(rights)[:-1]))[at]
        rank = np.where(right, seen - 1 - seen_before, np.arange(node.size) - first[at] - (seen - seen_before))
        place = first[at] + np.where(right, (sizes - rights)[at], 0) + rank
        moved = np.empty_like(x)
        moved[place] = x
        x = moved
        size = np.stack([sizes - rights, rights], axis=1).ravel()
        heap = np.stack([2 * heap[~leaf], 2 * heap[~leaf] + 1], axis=1).ravel()
        tree = np.repeat(tree[~leaf], 2)
        before += count
    return {k: np.concatenate(v).astype(float) for k, v in out.items()}


def fit_part(x: np.ndarray, key: np.ndarray, tree: np.ndarray, sample: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """The trees of a part. x: the rows of its pool, in the order of their keys; key: a hash of each key."""
    sample = max(1, min(sample, len(x)))
    limit, step = depth_limit(sample), max(1, CELLS // max(sample, 1))
    parts, roots, before = [], [], 0
    for i in range(0, tree.size, step):
        some = tree[i : i + step]
        if sample < len(x):
            train = np.stack([x[np.sort(np.argsort(drawn(seed, t, key), kind="stable")[:sample])] for t in some])
        else:
            train = np.broadcast_to(x, (some.size, *x.shape))
        part = grow(train, some, limit, seed)
        part["left"] = np.where(part["left"] >= 0, part["left"] + before, -1)
        roots.append(before + np.arange(some.size, dtype=float))
        before += part["cut"].size
        parts.append(part)
    return {**{k: np.concatenate([p[k] for p in parts]) for k in ARRAYS}, "roots": np.concatenate(roots)}


def depths(part: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of rows over the trees of a part."""
    roots, total = part["roots"].astype(np.int64), np.zeros(len(rows))
    feature, left = part["feature"].astype(np.int64), part["left"].astype(np.int64)
    for first in range(0, len(rows), CELLS // 16):
        some = rows[first : first + CELLS // 16]
        together = max(1, CELLS // max(1, len(some)))
        for i in range(0, roots.size, together):
            at = np.repeat(roots[i : i + together], len(some))
            row = np.tile(np.arange(len(some)), at.size // max(1, len(some)))
            while at.size:
                leaf = feature[at] < 0
                total[first : first + len(some)] += np.bincount(row[leaf], weights=part["value"][at[leaf]], minlength=len(some))
                at, row = at[~leaf], row[~leaf]
                at = left[at] + (some[row, feature[at]] >= part["cut"][at])
    return total


def sizes_a(n: Column) -> tuple[Column, Column]:
    """Trees and sample of variant A: at most 256 rows a tree, cut at 0.5."""
    return F.least(F.lit(100) + F.bround(n / 5, 0), F.lit(7000)).cast("int"), F.least(n, F.lit(256)).cast("int")


def sizes_b(n: Column) -> tuple[Column, Column]:
    """Variant B: whole samples, cut at the quantile that its contamination gives."""
    return F.least(F.lit(100) + F.floor(n / 3), F.lit(3000)).cast("int"), n.cast("int")


CONTAMINATION = {"if_sklearn": None, "if_custom": 0.18}


def shapes(rows: DataFrame, variant: str, device: str, nodes: int) -> DataFrame:
    """device, its rows (_n), trees, sample, the trees of a part (_each) and how many parts there are (_parts)."""
    trees, sample = (sizes_a if variant == "if_sklearn" else sizes_b)(F.col("_n"))
    shape = rows.groupBy(device).agg(F.count("*").alias("_n")).select(device, "_n", trees.alias("trees"), sample.alias("sample"))
    each = F.greatest(F.lit(1), F.floor(nodes / (2 * F.col("sample")))).cast("int")
    return shape.withColumn("_each", each).withColumn("_parts", F.ceil(F.col("trees") / F.col("_each")).cast("int"))


def drawn_by(part: Column, key: str, seed: int, pool: int) -> Column:
    """Whether a part learns from a row: parts of smaller samples draw these from a pool of their own."""
    share = F.when(F.col("sample") < F.col("_n"), F.lit(float(pool)) / F.col("_n")).otherwise(F.lit(1.0))
    lot = F.pmod(F.xxhash64(F.lit(seed), key, part), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return lot < share


def pools(rows: DataFrame, shape: DataFrame, device: str, key: str, seed: int, pool: int) -> DataFrame:
    """The rows that each part learns from, with the columns of shape but for _n and _parts."""
    dealt = rows.select(device, key, "v").join(shape, device).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = [c for c in shape.columns if c not in (device, "_n", "_parts")]
    return dealt.filter(drawn_by(F.col("part"), key, seed, pool)).select(device, key, key_hash(F.col(key)).alias("_h"), "v", "part", *own)


def fit(rows: DataFrame, variant: str, device: str, key: str, seed: int = SEED, pool: int = POOL, nodes: int = NODES) -> DataFrame:
    """device, part, trees, sample (of the device) and arrays of each part. rows: device, key and v, an array of doubles without nulls."""
    ship(rows.sparkSession)
    dealt = pools(rows, shapes(rows, variant, device, nodes), device, key, seed, pool)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        part, total, sample, each = (int(table.column(c)[0].as_py()) for c in ("part", "trees", "sample", "_each"))
        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        made = fit_part(x, table.column("_h").to_numpy(), np.arange(part * each, min(total, (part + 1) * each)), sample, seed)
        row = [table.column(device).slice(0, 1), *(pa.array([n], pa.int32()) for n in (part, total, sample)), to_map(made)]
        return pa.table(row, names=[device, "part", "trees", "sample", "arrays"])

    return spread(dealt, device, "part").groupBy(device, "part").applyInArrow(run, f"`{device}` {dict(rows.dtypes)[device]}, part int, trees int, sample int, arrays map<string, array<double>>")


def grown_sums(rows: DataFrame, asked: DataFrame, variant: str, device: str, key: str, seed: int = SEED, pool: int = POOL, nodes: int = NODES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """device, key, learned, _value (the sum of a row's path lengths), trees and sample of asked rows (device, key, v, learned).

    The trees are those of fit(), but a task that grows a part scores a block of rows with it at once, so nodes are neither written nor
    shuffled. The parts of a device are dealt in shares, and a task grows those of a share one after the other from the same rows: these are
    shuffled once a share, not once a part. A device has several shares only where its work is more than half a task's part of all work,
    so all devices together have few more shares than devices. Where a device has several blocks, its parts are grown in each."""
    spark = rows.sparkSession
    ship(spark)
    # blocks are no smaller than what a part learns from, so that growing it anew is never most of the work
    blocks = asked.groupBy(device).agg(F.count("*").alias("_asked"))
    learns = F.when(F.col("sample") < F.col("_n"), F.least(F.col("_n"), F.lit(pool))).otherwise(F.col("_n"))
    shape = shapes(rows, variant, device, nodes).join(blocks, device).withColumn("_blocks", F.ceil(F.col("_asked") / F.greatest(F.lit(block_rows), learns)).cast("int"))
    shape = settled(shape.withColumn("_work", F.col("trees") * (F.col("sample") + F.col("_asked") / F.col("_blocks"))), "forest-shape")
    most = (shape.agg(F.sum(F.col("_work") * F.col("_blocks"))).first()[0] or 0) / (2 * shuffle_partitions(spark))
    shape = shape.withColumn("_shares", F.least(F.col("_parts"), F.ceil(F.col("_work") / F.lit(max(most, 1.0)))).cast("int"))
    dealt = shape.agg(F.sum(F.col("_shares") * (F.col("_n") * F.col("_blocks") + F.col("_asked")))).first()[0] or 0
    shape = shape.drop("_asked", "_work")
    spread_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [device, "_share", "_block", key, "v", "_h", "_in", "learned", "trees", "sample", "_each", "_parts", "_shares"]
    given = rows.select(device, key, "v").join(shape, device).withColumn("_share", spread_to("_shares"))
    # _in: the parts that learn from the row; null: all of the share
    own = F.filter(F.sequence("_share", F.col("_parts") - 1, "_shares"), lambda part: drawn_by(part, key, seed, pool))
    given = given.withColumn("_in", F.when((F.col("sample") < F.col("_n")) & (F.col("_n") > pool), own)).filter("_in is null or size(_in) > 0")
    given = given.withColumns({"_block": spread_to("_blocks"), "_h": key_hash(F.col(key)), "learned": F.lit(None).cast("boolean")}).select(*columns)
    left = asked.select(device, key, "v", "learned").join(shape, device).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    left = left.withColumns({"_share": spread_to("_shares"), "_h": F.lit(None).cast("long"), "_in": F.lit(None).cast("array<int>")}).select(*columns)
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        # rows to learn from first (their `learned` is null), then by key
        table, each = units(table.append_column("_asks", table.column("learned").is_valid()), [device, "_share", "_block"], ["_asks", key])
        asks, v, pooled = table.column("_asks").to_numpy(), Vectors(table.column("v")), table.column("_in")
        hashes = table.column("_h").fill_null(0).to_numpy()
        share, trees, sample, of, parts, shares = (table.column(c).to_numpy() for c in ("_share", "trees", "sample", "_each", "_parts", "_shares"))
        value = np.zeros(table.num_rows)
        for a, b in each:
            m = a + int(np.count_nonzero(~asks[a:b]))
            if not a < m < b:
                continue
            x, h, rows_ = v.rows(a, m), hashes[a:m], v.rows(m, b)
            drawn_in = pooled.slice(a, m - a).combine_chunks() if pooled[a].is_valid else None
            if drawn_in is not None:
                whose, part_of = np.repeat(np.arange(m - a), pc.list_value_length(drawn_in).to_numpy()), drawn_in.flatten().to_numpy()
            for part in range(int(share[a]), int(parts[a]), int(shares[a])):
                at = slice(None) if drawn_in is None else whose[part_of == part]
                if len(x[at]):
                    some = np.arange(part * int(of[a]), min(int(trees[a]), (part + 1) * int(of[a])))
                    value[m:b] += depths(fit_part(x[at], h[at], some, int(sample[a]), seed), rows_)
        names = [device, key, "learned", "trees", "sample"]
        out = pa.table([*(table.column(c) for c in names), pa.array(value)], names=[*names, "_value"])
        return out.filter(table.column("_asks"))

    # few rows may be much work, so there are some bundles a task whatever the rows
    bundles = max(4 * shuffle_partitions(spark), count_for(spark, dealt))
    found = bundled(given.unionByName(left), [device, "_share", "_block"], bundles).applyInArrow(run, f"`{device}` {kinds[device]}, `{key}` {kinds[key]}, learned boolean, trees int, sample int, _value double")
    return found.groupBy(device, key, "learned").agg(F.sum("_value").alias("_value"), F.first("trees").alias("trees"), F.first("sample").alias("sample"))


def score_of(total: Column, trees: Column, sample: Column) -> Column:
    """2^(-mean depth / c(sample)): near 1 for what is easily isolated."""
    n = sample.cast("double")
    c = F.when(n > 2, 2 * (F.log(n - 1) + F.lit(float(np.euler_gamma))) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(1e-12)
    return F.pow(F.lit(2.0), -(total / trees) / c)
