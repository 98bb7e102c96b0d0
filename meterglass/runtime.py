"""Session helpers shared by every part of the library."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def ship(spark: SparkSession) -> None:
    """Let executors import this package: hand it to Spark's own file server once per application.

    Also bounds the Arrow batches of the session by bytes, unless a smaller bound is set: rows may be long, and
    the row bound alone lets a batch of them take tens of megabytes in the JVM and again in a Python worker."""
    context = spark.sparkContext
    given = re.fullmatch(r"(\d+)([kmgt]?)b?", (spark.conf.get(BATCH_LIMIT, None) or "1t").lower())
    if given is None or int(given[1]) << 10 * " kmgt".index(given[2] or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="meterglass-")
    path = os.path.join(folder, "meterglass_src.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests, local runs)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all nodes share")
    return "file://" + os.path.join(tempfile.gettempdir(), "meterglass-shared")


#: The scratch paths of what runs in holding(), each thread and task its own.
_OWN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def holding() -> Iterator[list[str]]:
    """The scratch paths that are made in here: those of other queries, which may run beside this one, are not among them."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/meterglass/{what}-{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if (own := _OWN.get()) is not None and path in own:
        own.remove(path)


def discard(df: DataFrame) -> None:
    """Delete what a settled frame was written to; nothing that is still to run may read it."""
    drop_path(df.sparkSession, df.settled_at)


def keep_only(df: DataFrame, own: list[str]) -> None:
    """Delete the scratch paths that are held, but for that of a settled frame which no longer needs the others."""
    for path in [p for p in own if p != df.settled_at]:
        drop_path(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by a hash of keys, in as many partitions as the session shuffles into: few bytes may be much work, and
    adaptive execution, which goes by bytes, would put them into one task."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
