"""Exact nearest neighbours among the training rows of a device, by cells around pivots.

A device's training rows are dealt to the nearest of its pivots (some rows, picked by a hash of their keys); a cell is a
pivot, the largest distance of a member from it, and its size. By the triangle inequality a row is at least its distance from the pivot less
that radius away from every member, so rows are compared in two rounds: with the nearest cells that hold enough members
together, and then with those cells only whose bound is within the k-th distance found. Neither the rows of a device nor all pairs of its rows meet in a task: a
task compares a block of rows with a block of one cell. Devices of up to two cells' worth of rows have one cell.

Of training rows with equal values only the first by key take part, as many as can ever be chosen; so a third of all rows
may be copies of one another. Distances are rounded to DIGITS, and equal ones go by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterglass.operators.vectors import VECTORS, matrix, squares
from meterglass.runtime import dealt, settled, ship

DIGITS, MOST = 9, 15
CELL_ROWS, MOST_CELLS = 1024, 4096
BLOCK_TRAIN, BLOCK_ROWS = 4096, 16384
CELLS = 500_000  # distances that are held at a time
SLACK = 1e-8  # for rounded distances


def lists(places: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([p.size for p in places]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)))


def nearest(a: np.ndarray, b: np.ndarray, most: int, self_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in b of the `most` nearest of each row of a, equal ones by place, their distances, and the places in a; self_at: which place of b is none (-1: all are)."""
    near, far, who = [], [], []
    step = max(1, CELLS // max(1, len(b)))
    for i in range(0, len(a) if len(b) else 0, step):
        dist = np.round(np.sqrt(squares(a[i : i + step], b)), DIGITS)
        mine = np.flatnonzero(self_at[i : i + step] >= 0)
        dist[mine, self_at[i : i + step][mine]] = np.inf
        if 4 * most < len(b):
            # all that are as near as the k-th, so that ties go by key
            limit = np.partition(dist, most - 1, axis=1)[:, most - 1]
            row, col = np.nonzero(dist <= limit[:, None])
        else:
            row, col = np.nonzero(np.isfinite(dist))
        value = dist[row, col]
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        rank = np.arange(row.size) - np.searchsorted(row, row)
        keep = (rank < most) & np.isfinite(value)
        near.append(col[keep])
        far.append(value[keep])
        who.append(row[keep] + i)
    near, far, who = (np.concatenate(x) if x else np.zeros(0, int) for x in (near, far, who))
    return near.astype(np.int64), far.astype(float), who.astype(np.int64)


class Search:
    """The cells of training rows (device, key, v) and the neighbours of other rows.

    cell_rows, block_train, block_rows: sizes, other than the defaults for tests."""

    def __init__(self, train: DataFrame, device: str, key: str, cell_rows: int = CELL_ROWS, block_train: int = BLOCK_TRAIN, block_rows: int = BLOCK_ROWS):
        ship(train.sparkSession)
        self.device, self.key, self.block_train, self.block_rows = device, key, block_train, block_rows
        self.kinds = {n: t for n, t in train.dtypes}
        equal = Window.partitionBy(device, "v").orderBy(key)
        first = train.select(device, key, "v").withColumn("_copy", F.row_number().over(equal)).filter(F.col("_copy") <= MOST + 1)
        lot = F.pmod(F.xxhash64(F.lit("pivot"), key), F.lit(1 << 40))
        first = settled(first.withColumn("_lot", lot), "neighbours-train")
        sizes = first.groupBy(device).agg(F.count("*").alias("_n"), F.min(F.when(F.col("_copy") == 1, F.col("_lot"))).alias("_least"))
        wanted = F.when(F.col("_n") <= 2 * cell_rows, 1).otherwise(F.least(F.ceil(F.col("_n") / cell_rows), F.lit(MOST_CELLS)))
        sizes = sizes.withColumn("_wanted", wanted.cast("long"))
        large = first.join(sizes.filter("_wanted > 1"), device)
        # the two least lots are pivots whatever the others draw, so that a device of several values has several cells
        second = large.filter((F.col("_copy") == 1) & (F.col("_lot") > F.col("_least"))).groupBy(device).agg(F.min("_lot").alias("_second"))
        large = large.join(second, device, "left")
        chosen = (F.col("_copy") == 1) & ((F.col("_lot") % F.ceil(F.col("_n") / F.col("_wanted")) == 0) | (F.col("_lot") <= F.coalesce("_second", "_least")))
        # some MOST_CELLS vectors a device at most
        self.pivots = large.filter(chosen).groupBy(device).agg(F.sort_array(F.collect_list(F.struct("_lot", "v")))["v"].alias("_pivots"))
        small = first.join(sizes.filter("_wanted = 1").select(device), device, "left_semi").select(device, key, "v", F.lit(0).alias("cell"), F.lit(0.0).alias("_far"))
        self.divided = not sizes.filter("_wanted > 1").isEmpty()
        placed = small
        if self.divided:
            own = self.planned(large.select(device, key, "v"), self.pivots.select(device, "_pivots"), ["_pivots"], self.nearest_cell, "cell int, _far double", [])
            placed = settled(small.unionByName(own), "neighbours-cells")
        self.placed = placed
        stats = placed.groupBy(device, "cell").agg(F.max("_far").alias("radius"), F.count("*").alias("n"))
        self.cells = stats.withColumn("_tb", F.ceil(F.col("n") / block_train).cast("int"))
        if self.divided:
            each = self.cells.join(self.pivots, device).withColumn("_v", F.get("_pivots", "cell")).groupBy(device).agg(F.sort_array(F.collect_list(F.struct("cell", "_v", "radius", "n"))).alias("_c"))
            self.bounds = settled(each.select(device, *(F.col(f"_c.{a}").alias(b) for a, b in (("cell", "_cells"), ("_v", "_pivots"), ("radius", "_radius"), ("n", "_size")))), "neighbours-bounds")

    def planned(self, rows: DataFrame, of: DataFrame, names: list[str], plan, schema: str, keep: list[str]) -> DataFrame:
        """Rows of devices with several cells, in blocks, each with the pivots of its device: what plan says of them."""
        d, k = self.device, self.key
        blocks = rows.groupBy(d).agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("_blocks"))
        left = rows.join(blocks, d).withColumn("_block", F.pmod(F.xxhash64(k), F.col("_blocks")).cast("int")).drop("_blocks")
        right = of.join(blocks, d).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        columns = [d, k, "v", *keep]
        column = lambda t, c: t.column(c).cast(VECTORS) if c == "v" else t.column(c)
        made = [c.split()[0] for c in schema.split(", ")]

        def run(some: pa.Table, cells: pa.Table) -> pa.Table:
            if not some.num_rows or not cells.num_rows:
                kinds = [pa.float64() if "double" in c else pa.list_(pa.int32()) if "array" in c else pa.int32() for c in schema.split(", ")]
                return pa.table([*(column(some, c).slice(0, 0) for c in columns), *(pa.nulls(0, t) for t in kinds)], names=[*columns, *made])
            held = [cells.column(n)[0].values for n in names]
            return pa.table([*(column(some, c) for c in columns), *plan(some, *held)], names=[*columns, *made])

        kinds = dict(rows.dtypes)
        types = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
        return dealt(left, d, "_block").groupBy(d, "_block").cogroup(dealt(right.toDF(*right.columns), d, "_block").groupBy(d, "_block")).applyInArrow(run, f"{types}, {schema}")

    @staticmethod
    def nearest_cell(some: pa.Table, pivots: pa.Array) -> list[pa.Array]:
        x, p = matrix(some.column("v")), matrix(pivots)
        at, far = [], []
        step = max(1, CELLS // len(p))
        for i in range(0, len(x), step):
            d = np.sqrt(squares(x[i : i + step], p))
            at.append(d.argmin(axis=1))
            far.append(d.min(axis=1))
        return [pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(far))]

    @staticmethod
    def cells_for(some: pa.Table, cells: pa.Array, pivots: pa.Array, radius: pa.Array, size: pa.Array) -> list[pa.Array]:
        """Cells of the first round: the nearest ones with k + 1 members together. With `_u`, those of the second round: others within it."""
        x, p = matrix(some.column("v")), matrix(pivots)
        names, radius, size = (np.asarray(a.to_numpy(zero_copy_only=False)) for a in (cells, radius, size))
        k = some.column("_k").to_numpy()
        within = some.column("_u").to_numpy() if "_u" in some.column_names else None
        out = []
        step = max(1, CELLS // len(p))
        for i in range(0, len(x), step):
            d = np.sqrt(squares(x[i : i + step], p))
            order = np.argsort(d, axis=1, kind="stable")
            enough = np.cumsum(size[order], axis=1) - size[order] < (k[i : i + step] + 1)[:, None]  # what comes before does not suffice
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, enough, axis=1)
            if within is not None:
                first = ~first & (d - radius <= within[i : i + step, None] * (1 + 1e-12) + SLACK)
            out.extend(names[row] for row in first)
        return [lists(out)]

    def compared(self, visits: DataFrame) -> DataFrame:
        """The k nearest of visits (device, key, v, own, _k, cell) in each cell and block: device, key, own, near, _d."""
        d, k = self.device, self.key
        load = visits.groupBy(d, "cell").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("_qb"))
        shape = self.cells.select(d, "cell", "_tb").join(load, [d, "cell"])
        place = lambda n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(shape, [d, "cell"]).withColumn("_q", place("_qb")).withColumn("_t", spread("_tb")).select(d, "cell", "_q", "_t", k, "v", "own", "_k")
        right = self.placed.join(shape, [d, "cell"]).withColumn("_t", place("_tb")).withColumn("_q", spread("_qb")).select(d, "cell", "_q", "_t", F.col(k).alias("near"), "v")
        group = [d, "cell", "_q", "_t"]

        def run(some: pa.Table, others: pa.Table) -> pa.Table:
            others = others.sort_by("near")
            keys, near_keys, own = some.column(k).combine_chunks(), others.column("near").combine_chunks(), some.column("own").to_numpy()
            a, b = matrix(some.column("v")), matrix(others.column("v"))
            near, far, who = nearest(a[:0], b[:0], 1, np.zeros(0, int))
            if len(a) and len(b):
                most = min(int(some.column("_k")[0].as_py()), len(b))
                place_of = {v: i for i, v in enumerate(near_keys.to_pylist())} if own.any() else {}
                self_at = np.array([place_of.get(v, -1) if o else -1 for v, o in zip(keys.to_pylist(), own.tolist(), strict=True)]) if place_of else np.full(len(a), -1)
                near, far, who = nearest(a, b, most, self_at)
            who = pa.array(who)
            return pa.table([some.column(d).combine_chunks().take(who), keys.take(who), some.column("own").combine_chunks().take(who), near_keys.take(pa.array(near)), pa.array(far)], names=[d, k, "own", "near", "_d"])

        types = f"`{d}` {self.kinds[d]}, `{k}` {dict(visits.dtypes)[k]}, own boolean, near {self.kinds[k]}, _d double"
        return dealt(left, *group).groupBy(*group).cogroup(dealt(right.toDF(*right.columns), *group).groupBy(*group)).applyInArrow(run, types)

    def best(self, found: DataFrame, k_of: DataFrame) -> DataFrame:
        nearest = Window.partitionBy(self.device, "own", self.key).orderBy("_d", "near")
        ranked = found.withColumn("_at", F.row_number().over(nearest)).filter(F.col("_at") <= MOST)
        return ranked.join(k_of, self.device).filter(F.col("_at") <= F.col("_k")).drop("_at", "_k")

    def visits(self, rows: DataFrame, k_of: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The cells that rows (device, key, v, own) are compared with in the first round, and what that finds (None where no device has several cells)."""
        d, k = self.device, self.key
        asked = rows.select(d, k, "v", "own").join(k_of, d)
        if not self.divided:
            return asked.withColumn("cell", F.lit(0)), None
        one = asked.join(self.bounds.select(d), d, "left_anti").withColumn("cell", F.lit(0))
        names = ["_cells", "_pivots", "_radius", "_size"]
        several = asked.join(self.bounds.select(d), d, "left_semi")
        first = self.planned(several, self.bounds, names, self.cells_for, "_to array<int>", ["own", "_k"])
        first = settled(first.select(d, k, "v", "own", "_k", F.explode("_to").alias("cell")), "neighbours-first")
        found = settled(self.best(self.compared(first), k_of), "neighbours-found")
        within = found.groupBy(d, "own", k).agg(F.max("_d").alias("_u"))
        then = self.planned(several.join(within, [d, "own", k]), self.bounds, names, self.cells_for, "_to array<int>", ["own", "_k", "_u"])
        then = settled(then.select(d, k, "v", "own", "_k", F.explode("_to").alias("cell")), "neighbours-then")
        return one.unionByName(then), found

    def neighbours(self, rows: DataFrame, k_of: DataFrame) -> DataFrame:
        """device, key, own, near and _d: the k nearest training rows of rows (device, key, v, own: whether it is a training row, which then
        is no neighbour of itself). k_of: device, _k (at most MOST)."""
        visits, found = self.visits(rows, k_of)
        more = self.compared(visits)
        return self.best(more if found is None else found.unionByName(more), k_of)

    def census(self, rows: DataFrame, k_of: DataFrame) -> DataFrame:
        """device, rows, cells, compared: how many cells a row is compared with on average."""
        d, k = self.device, self.key
        visits, found = self.visits(rows, k_of)
        seen = visits.select(d, k, "own")
        if found is not None:
            first = self.planned(rows.select(d, k, "v", "own").join(k_of, d), self.bounds, ["_cells", "_pivots", "_radius", "_size"], self.cells_for, "_to array<int>", ["own", "_k"])
            seen = seen.unionByName(first.select(d, k, "own", F.explode("_to").alias("_c")).drop("_c"))
        counts = seen.groupBy(d).agg(F.count("*").alias("_v"))
        total = rows.groupBy(d).agg(F.count("*").alias("rows"))
        return total.join(counts, d).join(self.cells.groupBy(d).agg(F.count("*").alias("cells")), d).select(d, "rows", "cells", (F.col("_v") / F.col("rows")).alias("compared"))
