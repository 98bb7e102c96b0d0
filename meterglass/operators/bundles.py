"""Work by unit (a device, or a block or part of one), many units a group.

Most devices are small, and a group of its own costs a device more than its work does. So units are dealt by a hash into
bundles of some ROWS rows, which are Arrow groups, and a task goes through the units of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.runtime import dealt, shuffle_partitions

ROWS = 20_000  # of a bundle, on average


def count_for(spark, rows: int) -> int:
    return max(shuffle_partitions(spark), -(-rows // ROWS))


def bundled(df: DataFrame, unit: list[str], bundles: int):
    """df grouped by bundle; units are whole in it."""
    wide = df.withColumn("_bundle", F.pmod(F.xxhash64(*unit), F.lit(bundles)))
    return dealt(wide.toDF(*wide.columns), "_bundle").groupBy("_bundle")


def codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """A number for each row, alike where all columns are."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        held = pa.chunked_array(c.chunks, c.type).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(1, len(held.dictionary)) + held.indices.to_numpy(zero_copy_only=False)
    return code


def ends_of(code: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and row after the last of each run of equal numbers."""
    ends = np.flatnonzero(np.append(code[1:] != code[:-1], True)) + 1 if len(code) else np.zeros(0, np.int64)
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)


def units(table: pa.Table, unit: list[str], order: list[str]) -> tuple[pa.Table, Iterator[tuple[int, int]]]:
    """The rows of a bundle in the order of their units, within these by columns, and where each unit begins and ends."""
    if order:
        table = table.sort_by([(c, "ascending") for c in order])
    code = codes([table.column(c) for c in unit])
    at = np.argsort(code, kind="stable")
    return table.take(pa.array(at)).combine_chunks(), ends_of(code[at])


class Vectors:
    """Vectors, of one length within a unit, as matrices by place."""

    def __init__(self, column: pa.ChunkedArray):
        lists = pa.chunked_array(column.chunks, column.type).combine_chunks()
        self.offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)

    def rows(self, first: int, end: int) -> np.ndarray:
        a, b = self.offsets[first], self.offsets[end]
        return self.values[a:b].reshape(end - first, -1) if end > first else np.zeros((0, 0))
