"""Feature vectors: assembly, scaling, and reduction from trees of QR factors.

A reduction needs the singular values and right directions of all rows. Each task factors the rows it reads, block by
block, into one upper triangle R of as many rows as columns, and triangles are stacked and factored again, FAN at a time, until
one is left: its singular values are those of all rows. Nothing is squared on the way, so values down to 1e-16 of the largest count;
the Gramian (an operator of its own) loses those below 1e-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.functions import exprs as X
from meterglass.runtime import discard, settled, ship

VARIANCE = 0.99
FAN, BLOCK = 64, 8192  # triangles, and rows, that are factored together
HELD = 4096  # devices whose triangles a task holds


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Columns in sorted order as one array of doubles."""
    return df.withColumn(out, F.array(*(F.col(c).cast("double") for c in sorted(columns))))


def standard_scale(df: DataFrame, device: str, columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation per device; 0.0 where the deviation is zero or undefined."""
    stats = df.groupBy(device).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.join(stats, device).withColumns(scaled).drop(*(f"_{a}_{c}" for a in "ms" for c in columns))


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def gramian(df: DataFrame, vector: str) -> DataFrame:
    """i, j and the sum over rows of x_i * x_j; each task adds up its own matrix before the shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "g"])

    return df.select(vector).mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def explained_k(values: DataFrame, index: str, value: str, share: float = VARIANCE) -> DataFrame:
    """How many of the values, greatest first, reach a share of their sum (all, if rounding keeps it below)."""
    from pyspark.sql import Window

    order, whole = Window.orderBy(F.desc(value), index), Window.partitionBy()
    ranked = values.withColumns({"_at": F.row_number().over(order), "_cum": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(value).over(whole)})
    return ranked.agg(F.coalesce(F.min(F.when(F.col("_cum") >= share * F.col("_all"), F.col("_at"))), F.max("_at")).alias("k"))


def triangle(x: np.ndarray) -> np.ndarray:
    """R of x = QR; fewer rows than columns stay as they are."""
    return x if len(x) <= x.shape[1] else np.linalg.qr(x, mode="r")


def spectrum(r: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, greatest first, and the fewest directions (as columns) that hold a share of their sum, with signs by their largest entry."""
    size = r.shape[1]
    _, values, directions = np.linalg.svd(np.vstack([r, np.zeros((max(0, size - len(r)), size))]))
    values, vectors = values**2, directions.T
    reached = np.flatnonzero(np.cumsum(values) >= share * values.sum())
    k = int(reached[0]) + 1 if reached.size else size
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return values, (vectors * sign)[:, :k]


def factor(df: DataFrame, vector: str, mean: np.ndarray) -> np.ndarray:
    """The triangle of all vectors less the mean."""
    ship(df.sparkSession)
    size = mean.size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            x = matrix_of(batch.column(0)) if batch.num_rows else r[:0]
            for i in range(0, len(x), BLOCK):
                r = triangle(np.vstack([r, x[i : i + BLOCK] - mean]))
        if len(r):
            yield pa.record_batch([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for one in batch.column(0):
                r = triangle(np.vstack([r, one.values.to_numpy(zero_copy_only=False).reshape(-1, size)]))
        if len(r):
            yield pa.record_batch([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    parts = settled(df.select(vector).mapInArrow(rows, "r array<double>"), "triangles")
    while (n := parts.count()) > FAN:
        fewer = settled(parts.repartition(-(-n // FAN)).mapInArrow(merge, "r array<double>"), "triangles")
        discard(parts)
        parts = fewer
    r = np.zeros((0, size))
    for row in parts.collect():  # FAN triangles at most, each of d x d numbers
        r = triangle(np.vstack([r, np.array(row.r).reshape(-1, size)]))
    discard(parts)
    return r


def reduction(df: DataFrame, vector: str, centred: bool, share: float = VARIANCE) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of the fewest directions that hold `share` of the variance (PCA) or squared singular values (SVD)."""
    size = df.select(F.size(vector).alias("d")).first()["d"]
    mean = np.zeros(size)
    if centred:
        row = df.agg(F.count("*"), *(F.sum(F.get(vector, F.lit(i))) for i in range(size))).first()
        mean = np.array(row[1:], float) / row[0]
    return mean, spectrum(factor(df, vector, mean), share)[1]


def project(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, out: str = "projected") -> DataFrame:
    """The vectors in the reduced space."""
    ship(df.sparkSession)
    kept = [(n, t) for n, t in df.dtypes if n != vector]
    names = [n for n, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(vector)) if batch.num_rows else np.zeros((0, mean.size))
            keep = [batch.column(n) for n in names]
            z = (x - mean) @ components
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.record_batch([*keep, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=[*names, out])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept) + f", {out} array<double>")


def factors(rows: DataFrame, device: str, vector: str, size: int) -> DataFrame:
    """device and `_r`: the triangle of the vectors of each device. A task holds HELD devices' triangles at most, and hands over what it has of them."""
    kind = dict(rows.dtypes)[device]
    out = f"`{device}` {kind}, _r array<double>"

    def packed(held: dict, of: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), of), pa.array([r.ravel() for r in held.values()], pa.list_(pa.float64()))], names=[device, "_r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            at, x = coded.indices.to_numpy(), matrix_of(batch.column(1))
            order = np.argsort(at, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(at[order]) != 0, True)) + 1
            names = coded.dictionary.take(pa.array(at[order][ends - 1])).to_pylist()
            for name, a, b in zip(names, [0, *ends[:-1]], ends, strict=True):
                part = x[order[a:b]]
                held[name] = triangle(np.vstack([held[name], part]) if name in held else part)
            if len(held) > HELD:
                yield packed(held, batch.column(0).type)
                held = {}
        if held:
            yield packed(held, batch.column(0).type)

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, size))
        for one in table.column("_r").combine_chunks():
            r = triangle(np.vstack([r, one.values.to_numpy(zero_copy_only=False).reshape(-1, size)]))
        return pa.table([table.column(device).slice(0, 1), pa.array([r.ravel()], pa.list_(pa.float64()))], names=[device, "_r"])

    parts = settled(rows.select(device, vector).mapInArrow(run, out), "triangles")
    while not (many := parts.groupBy(device).agg(F.count("*").alias("_n")).filter(F.col("_n") > FAN)).isEmpty():
        # a device that many tasks have rows of: its triangles first meet in groups
        dealt = parts.join(many, device).withColumn("_g", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / FAN)))
        fewer = settled(parts.join(many, device, "left_anti").unionByName(dealt.select(device, "_r", "_g").groupBy(device, "_g").applyInArrow(merge, out)), "triangles")
        discard(parts)
        parts = fewer
    return parts.groupBy(device).applyInArrow(merge, out)


TRANSFORM = "features array<string>, shift array<double>, factor array<double>, components array<array<double>>"


def fit_transforms(train: DataFrame, device: str, columns: list[str], scale: bool = False, reduction: str | None = None, share: float = VARIANCE) -> DataFrame:
    """device and how its rows become features, learned from training rows without nulls (but for columns a device never has).

    features: the sorted columns that the device has; shift and factor: mean and inverse sample deviation where
    scaled (a factor of 0 where there is no deviation), else 0 and 1; components: the directions that hold `share` of
    the variance (reduction "PCA") or of the squared singular values ("SVD"), else null.
    Means that are short decimals are exact, whatever the order of rows, so a tie of their rounding is one.
    Means and deviations are aggregates of all devices at once; of a reduction only the triangles of a device (about its means) meet."""
    if reduction not in (None, "PCA", "SVD"):
        raise ValueError(f"no such reduction: {reduction}")
    spark, names = train.sparkSession, sorted(columns)
    ship(spark)
    d = len(names)
    own = [F.col(c).cast("double").alias(c) for c in names]
    means = train.groupBy(device).agg(F.count("*").cast("double").alias("_n"), F.array(*(F.coalesce(X.exact_mean(c), F.avg(c)) for c in own)).alias("_mean"), F.array(*(F.stddev_samp(c) for c in own)).alias("_sd"))
    if reduction:
        centred = train.join(means.select(device, "_mean"), device).select(device, F.array(*(F.coalesce(c - F.get("_mean", F.lit(i)), F.lit(0.0)) for i, c in enumerate(own))).alias("_x"))
        moments = means.join(factors(centred, device, "_x", d), device)
    else:
        moments = means.withColumn("_r", F.array().cast("array<double>"))

    def learned(n: float, mean: np.ndarray, deviation: np.ndarray, r: np.ndarray) -> dict:
        own = np.flatnonzero(~np.isnan(mean))
        mean = mean[own]
        shift, factor = np.zeros(own.size), np.ones(own.size)
        if scale:
            deviation = np.nan_to_num(deviation[own])
            shift, factor = mean, np.divide(1.0, deviation, out=np.zeros(own.size), where=deviation > 0)
        components = None
        if reduction and own.size:
            spread = r.reshape(-1, d)[:, own] * factor
            if reduction == "SVD":
                spread = np.vstack([spread, np.sqrt(n) * (mean - shift) * factor])
            components = spectrum(triangle(spread), share)[1].T.tolist()
        return {"features": [names[i] for i in own], "shift": shift.tolist(), "factor": factor.tolist(), "components": components}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("features", pa.list_(pa.string())), ("shift", pa.list_(pa.float64())), ("factor", pa.list_(pa.float64())), ("components", pa.list_(pa.list_(pa.float64())))])
        for batch in batches:
            rows = [learned(n, *(np.array(v, float) for v in vs)) for n, *vs in zip(*(batch.column(x).to_pylist() for x in ("_n", "_mean", "_sd", "_r")), strict=True)]
            yield pa.record_batch([batch.column(0), *pa.array(rows, kind).flatten()], names=[device, *kind.names])

    return moments.mapInArrow(run, f"`{device}` {dict(train.dtypes)[device]}, {TRANSFORM}")


def transformed(columns: list[str], transform: Column) -> Column:
    """The features of a row as an array, by built-ins alone. columns: all that a transform may name."""
    values = F.create_map(*(c for n in sorted(columns) for c in (F.lit(n), F.col(n).cast("double"))))
    x = F.transform(transform["features"], lambda n, i: (F.try_element_at(values, n) - F.get(transform["shift"], i)) * F.get(transform["factor"], i))
    dot = lambda v: F.aggregate(F.zip_with(x, v, lambda a, b: a * b), F.lit(0.0), lambda t, y: t + y)
    return F.when(transform["components"].isNull(), x).otherwise(F.transform(transform["components"], dot))


def apply_transforms(df: DataFrame, transforms: DataFrame, device: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with its columns replaced by features z00, z01, ... (null beyond those of a device), and their names."""
    kept = [c for c in df.columns if c not in columns]
    names = [f"z{i:02d}" for i in range(len(columns))]
    wide = df.join(transforms.select(device, F.struct("features", "shift", "factor", "components").alias("_t")), device)
    wide = wide.withColumn("_z", transformed(columns, F.col("_t")))
    return wide.select(*kept, *(F.get("_z", F.lit(i)).alias(n) for i, n in enumerate(names))), names
