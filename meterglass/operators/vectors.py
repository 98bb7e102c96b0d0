"""Rows as vectors of the features that their device has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known(name: str):
    """A column as double, null where it is null or NaN."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def usable(train: DataFrame, device: str, names: list[str]) -> DataFrame:
    """device and features: the sorted columns that it has a value of."""
    names = sorted(names)
    counts = train.groupBy(device).agg(*(F.count(known(n)).alias(f"_c{i}") for i, n in enumerate(names)))
    return counts.select(device, F.array_compact(F.array(*(F.when(F.col(f"_c{i}") > 0, F.lit(n)) for i, n in enumerate(names)))).alias("features"))


def vectors(rows: DataFrame, of: DataFrame, device: str, key: str, names: list[str]) -> DataFrame:
    """device, key and v: the values of the features of the device (of: device, features), null if one is missing or there is none."""
    names = sorted(names)
    cells = F.array(*(known(n) for n in names)) if names else F.array().cast("array<double>")
    held = rows.select(device, key, cells.alias("_cells")).join(of.select(device, F.col("features").alias("_f")), device)
    at = F.transform(F.array(*(F.lit(n) for n in names)).cast("array<string>"), lambda n: F.array_contains("_f", n))
    own = F.filter("_cells", lambda x, i: F.get(F.col("_at"), i))
    v = held.withColumn("_at", at).select(device, key, own.alias("v"))
    return v.select(device, key, F.when((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()), F.col("v")).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def to_map(arrays: dict[str, np.ndarray]) -> pa.MapArray:
    """One map of names to arrays, without a Python object for each number."""
    ends = np.concatenate(([0], np.cumsum([a.size for a in arrays.values()]))).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in arrays.values()]).astype(float)))
    return pa.MapArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), pa.array(list(arrays), pa.string()), values)


def from_map(maps: pa.ChunkedArray | pa.Array, i: int = 0) -> dict[str, np.ndarray]:
    """The arrays of the i-th map."""
    items = maps[i].values
    return {k: v.values.to_numpy(zero_copy_only=False) for k, v in zip(items.field(0).to_pylist(), items.field(1), strict=True)}


VECTORS = pa.list_(pa.field("element", pa.float64()))  # as Spark names them, whether elements may be null or not


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += (a[:, f, None] - b[None, :, f]) ** 2
    return out
