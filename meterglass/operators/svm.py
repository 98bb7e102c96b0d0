"""One-class support vector machines (Schoelkopf et al. 2001) with an RBF kernel, solved across tasks.

The dual of a device: minimise a'Ka / 2 with 0 <= a <= 1 / (nu n) and sum a = 1. Its rows are dealt in chunks that are solved
apart, each by pairwise steps; the solutions, weighted by their rows, are a feasible and good start. Then, until the conditions of
optimality hold over all rows, a task takes the rows that violate them most (WORKING of them at most), solves for these
with all others fixed, and every row's gradient is brought up to date with what has changed. Rows are compared in
blocks, so no task holds a kernel of more than CHUNK rows. A device of one chunk is solved at once.

`gap` is the largest violation over all rows, (K a)_j - (K a)_i over i that may grow and j that may shrink, times nu n (the
scale of usual tolerances). A model is its support vectors in parts, with rho; a row's value is sum a k(x, s) - rho, negative for outliers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterglass.operators.bundles import Vectors, bundled, count_for, units
from meterglass.operators.vectors import VECTORS, matrix, squares
from meterglass.runtime import dealt as spread_out
from meterglass.runtime import discard, settled, ship

NU, TOLERANCE, SPREAD_TOLERANCE = 1 / 3, 1e-12, 1e-7
CHUNK, WORKING, BLOCK_ROWS, PART_ROWS, ROUNDS = 1500, 1000, 8192, 4096, 200
CELLS = 500_000
EDGE = 1e-9  # of the upper bound: closer weights count as on it


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * squares(a, b))


def products(rows: np.ndarray, support: np.ndarray, weight: np.ndarray, gamma: float) -> np.ndarray:
    """Sum over support of weight * k(row, support)."""
    step = max(1, CELLS // max(1, len(support)))
    parts = [kernel(rows[i : i + step], support, gamma) @ weight for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def gap_of(a: np.ndarray, g: np.ndarray, most: float) -> float:
    up, down = a < most * (1 - EDGE), a > most * EDGE
    return float(g[down].max() - g[up].min()) if up.any() and down.any() else 0.0


def solve(k: np.ndarray, a: np.ndarray, g: np.ndarray, most: float, tolerance: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise steps from weights a with gradients g, which may hold more than K a; the sum of a stays. Some `steps` a row at most."""
    a, g = a.copy(), g.copy()
    for _ in range(steps * len(a)):
        up, down = np.flatnonzero(a < most), np.flatnonzero(a > 0)
        if not up.size or not down.size:
            break
        i = up[g[up].argmin()]
        # of those that may shrink, the one whose step lowers the objective most
        better = g[down] - g[i]
        if better.max() <= tolerance:
            break
        gain = np.where(better > 0, better * better / np.maximum(2 - 2 * k[i, down], 1e-12), -1.0)
        j = down[gain.argmax()]
        step = min((g[j] - g[i]) / max(2 - 2 * k[i, j], 1e-12), most - a[i], a[j])
        if step <= 0:
            break
        # a weight that reaches a bound is put on it exactly
        a[i] = most if step == most - a[i] else a[i] + step
        a[j] = 0.0 if step == a[j] else a[j] - step
        g += step * (k[:, i] - k[:, j])
    return a, g


def start(n: int, most: float) -> np.ndarray:
    """The first rows at their upper bound, one with what is left."""
    a = np.zeros(n)
    full = min(n, int(1 / most + 1e-9))
    a[:full] = most
    if full < n:
        a[full] = max(0.0, 1.0 - full * most)
    return a / a.sum()


def by_device(rows: DataFrame, device: str, shape: DataFrame, names: list[str]) -> DataFrame:
    return rows.join(shape.select(device, *names), device)


def moved(rows: DataFrame, changed: DataFrame, shape: DataFrame, device: str, key: str, parts: str | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """device, key and _s: the sum of w * k(row, other) over changed rows (device, v, w). parts: how changed rows are dealt in blocks; None: they are few."""
    blocks = rows.groupBy(device).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_rb"))
    others = changed.groupBy(device).agg((F.ceil(F.count("*") / block_rows) if parts else F.lit(1)).cast("int").alias("_sb"))
    dealt = blocks.join(others, device)
    place = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select(device, key, "v").join(dealt, device).withColumn("_r", place("_rb", key)).withColumn("_t", spread("_sb")).select(device, key, "v", "_r", "_t")
    right = changed.select(device, *([parts] if parts else []), F.col("v").alias("s"), "w").join(dealt, device).join(shape.select(device, "gamma"), device).withColumn("_t", place("_sb", parts or F.lit(0))).withColumn("_r", spread("_rb")).select(device, "s", "w", "gamma", "_r", "_t")

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        value = np.zeros(some.num_rows)
        if some.num_rows and others.num_rows:
            value = products(matrix(some.column("v")), matrix(others.column("s")), others.column("w").to_numpy(), others.column("gamma")[0].as_py())
        return pa.table([some.column(device), some.column(key), pa.array(value)], names=[device, key, "_s"])

    kinds = dict(rows.dtypes)
    group = [device, "_r", "_t"]
    found = spread_out(left, *group).groupBy(*group).cogroup(spread_out(right.toDF(*right.columns), *group).groupBy(*group)).applyInArrow(run, f"`{device}` {kinds[device]}, `{key}` {kinds[key]}, _s double")
    return found.groupBy(device, key).agg(F.sum("_s").alias("_s"))


def solution(rows: DataFrame, device: str, key: str, nu: float = NU, chunk: int = CHUNK, working: int = WORKING, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(device, key, v, a, g of each row; device, n, gamma, most of each device). rows: device, key and v without nulls."""
    ship(rows.sparkSession)
    flat = rows.select(device, F.explode("v").alias("_x")).groupBy(device).agg(F.var_pop("_x").alias("_var"))
    shape = rows.groupBy(device).agg(F.count("*").alias("n"), F.first(F.size("v")).alias("_d")).join(flat, device)
    shape = settled(shape.select(device, "n", (1 / F.greatest(F.col("_d") * F.col("_var"), F.lit(1e-12))).alias("gamma"), (1 / (nu * F.col("n"))).alias("most"), F.ceil(F.col("n") / chunk).cast("int").alias("_chunks")), "svm-shape")
    kinds = dict(rows.dtypes)
    state_type = f"`{device}` {kinds[device]}, `{key}` {kinds[key]}, v array<double>, a double, g double"
    columns = [device, key, "v", "a", "g"]

    def alone(table: pa.Table) -> pa.Table:
        # the chunks of a bundle, each by its keys
        table, each = units(table, [device, "_chunk"], [key])
        v, ns, gammas = Vectors(table.column("v")), table.column("n").to_numpy(), table.column("gamma").to_numpy()
        weights, gradients = np.zeros(table.num_rows), np.zeros(table.num_rows)
        for i, j in each:
            x = v.rows(i, j)
            most = max(1 / (nu * len(x)), 1 / len(x))
            k = kernel(x, x, float(gammas[i]))
            a = start(len(x), most)
            a, g = solve(k, a, k @ a, most, TOLERANCE)
            share = len(x) / int(ns[i])
            weights[i:j], gradients[i:j] = a * share, g * share
        return pa.table([table.column(device), table.column(key), table.column("v").cast(VECTORS), pa.array(weights), pa.array(gradients)], names=columns)

    total = shape.agg(F.sum("n")).first()[0] or 0
    chunked = by_device(rows.select(device, key, "v"), device, shape, ["n", "gamma", "_chunks"]).withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), key), F.col("_chunks")).cast("int"))
    state = settled(bundled(chunked, [device, "_chunk"], count_for(rows.sparkSession, total)).applyInArrow(alone, state_type), "svm-state")
    large = shape.filter("_chunks > 1").select(device)
    if large.isEmpty():
        return state, shape
    done, open_ = state.join(large, device, "left_anti"), state.join(large, device, "left_semi")
    g = moved(open_, open_.filter("a > 0").withColumnRenamed("a", "w"), shape, device, key, key)
    open_ = settled(open_.drop("g").join(g.withColumnRenamed("_s", "g"), [device, key]).select(*columns), "svm-state")

    def corrected(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        x, a, g = matrix(table.column("v")), table.column("a").to_numpy(), table.column("g").to_numpy()
        new, _ = solve(kernel(x, x, table.column("gamma")[0].as_py()), a, g, table.column("most")[0].as_py(), TOLERANCE)
        return pa.table([table.column(device), table.column(key), table.column("v").cast(VECTORS), pa.array(new), pa.array(new - a)], names=[device, key, "v", "_new", "w"])

    for _ in range(rounds):
        limits = conditions(open_, shape, device)
        waiting = limits.filter((F.col("_down") - F.col("_up")) * nu * F.col("n") > SPREAD_TOLERANCE).select(device, "_up", "_down")
        if waiting.isEmpty():
            break
        most = F.col("most")
        bad = open_.join(waiting, device).join(shape.select(device, "most", "gamma"), device)
        # the rows that may grow with the least gradients, and those that may shrink with the largest
        grow = Window.partitionBy(device).orderBy("g", key)
        shrink = Window.partitionBy(device).orderBy(F.desc("g"), key)
        ups = bad.filter((F.col("a") < most * (1 - EDGE)) & (F.col("g") < F.col("_down"))).withColumn("_at", F.row_number().over(grow)).filter(F.col("_at") <= working // 2)
        downs = bad.filter((F.col("a") > most * EDGE) & (F.col("g") > F.col("_up"))).withColumn("_at", F.row_number().over(shrink)).filter(F.col("_at") <= working // 2)
        taken = ups.unionByName(downs).dropDuplicates([device, key]).select(device, key, "v", "a", "g", "most", "gamma")
        changed = settled(spread_out(taken, device).groupBy(device).applyInArrow(corrected, f"`{device}` {kinds[device]}, `{key}` {kinds[key]}, v array<double>, _new double, w double"), "svm-changed")
        step = moved(open_, changed.filter("w <> 0"), shape, device, key, None)
        new = open_.join(step, [device, key], "left").join(changed.select(device, key, "_new"), [device, key], "left")
        new = settled(new.select(device, key, "v", F.coalesce("_new", "a").alias("a"), (F.col("g") + F.coalesce("_s", F.lit(0.0))).alias("g")), "svm-state")
        discard(open_)
        discard(changed)
        open_ = new
    return settled(done.unionByName(open_), "svm-state"), shape


def conditions(state: DataFrame, shape: DataFrame, device: str) -> DataFrame:
    """device, n and the bounds of optimality: _up, the least gradient of rows that may grow, and _down, the largest of those that may shrink."""
    a, most, g = F.col("a"), F.col("most"), F.col("g")
    grows, shrinks = a < most * (1 - EDGE), a > most * EDGE
    free = grows & shrinks
    when = lambda c: F.when(c, g)
    out = state.join(shape.select(device, "n", "most", "gamma"), device).groupBy(device).agg(
        F.first("n").alias("n"), F.first("gamma").alias("gamma"), F.min(when(grows)).alias("_up"), F.max(when(shrinks)).alias("_down"), F.avg(when(free)).alias("_free"),
        F.max(when(shrinks & ~grows)).alias("_full"), F.min(when(grows & ~shrinks)).alias("_none"), F.max(g).alias("_top"),
    )
    return out


def fit(rows: DataFrame, device: str, key: str, nu: float = NU, **sizes: int) -> DataFrame:
    """device, part, rho, gamma, gap and arrays of the support vectors (v flattened, a, and key where it is a number)."""
    state, shape = solution(rows, device, key, nu, **sizes)
    limits = conditions(state, shape, device)
    rho = F.coalesce("_free", (F.col("_full") + F.col("_none")) / 2, "_top")
    gap = F.greatest(F.coalesce(F.col("_down") - F.col("_up"), F.lit(0.0)), F.lit(0.0)) * nu * F.col("n")
    meta = limits.select(device, rho.alias("rho"), "gamma", gap.alias("gap"))
    support = state.filter("a > 0")
    parts = support.groupBy(device).agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    dealt = support.join(parts, device).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    # some PART_ROWS support vectors, as a hash deals them
    held = dealt.groupBy(device, "part").agg(F.sort_array(F.collect_list(F.struct(key, "a", "v"))).alias("_r"))
    named = [F.lit("a"), F.col("_r.a"), F.lit("v"), F.flatten("_r.v")]
    if dict(state.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        named += [F.lit("key"), F.transform(f"_r.{key}", lambda k: k.cast("double"))]
    named = F.create_map(*named)
    return held.select(device, "part", named.alias("arrays")).join(meta, device)
