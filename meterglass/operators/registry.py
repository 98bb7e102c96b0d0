"""Model registry: versions by device, message type and algorithm, in a store that several writers may change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.sources.store import Store

KEYS = ["device", "msg_type", "algorithm"]
NAMES = [*KEYS, "version", "part", "params", "arrays"]
SCHEMA = "device string, msg_type string, algorithm string, version long, part int, params string, arrays map<string, array<double>>"
METRICS = "device string, msg_type string, algorithm string, version long, tp long, tn long, fp long, fn long"


def latest(models: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version; aggregated before the shuffle."""
    rest = [c for c in models.columns if c not in keys]
    return models.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_m")).select(*keys, "_m.*")


def current(models: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows of each key that have its greatest version; only keys and versions are aggregated."""
    newest = models.groupBy(*keys).agg(F.max(version).alias(version))
    return models.join(newest, [*keys, version], "left_semi").select(*models.columns)


class Registry:
    """Models in parts, and what they reached in evaluation (confusion counts by device)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.models, self.evaluations = Store(spark, f"{path}/models", SCHEMA), Store(spark, f"{path}/metrics", METRICS)

    def all(self) -> DataFrame:
        found = self.models.read()
        return self.spark.createDataFrame([], SCHEMA) if found is None else found

    def store(self, models: DataFrame, version: int, part: str = "all", expected: int | None = None) -> bool:
        """Put models as a version; writing a version of a part again replaces it. part: what is stored together, as
        a message type and an algorithm: other parts keep their versions. expected: only if the part's greatest version is still
        this one (-1: none); False if another writer was first."""
        if "part" not in models.columns:
            models = models.withColumns({"part": F.lit(0), "arrays": F.lit(None).cast("map<string, array<double>>")})
        out = models.withColumn("version", F.lit(version).cast("long")).select(*NAMES)
        return self.models.write(out, f"{part}/{version}", version, expected)

    def next(self, models: DataFrame, part: str = "all") -> int:
        """Store as the version after the greatest of the part, whoever else is storing; the version."""
        while True:
            last = max((e["v"] for e in self.models.entries() if e["tag"].split("/")[0] == part), default=-1)
            if self.store(models, last + 1, part, last):
                return last + 1

    def load(self) -> DataFrame:
        return current(self.all(), KEYS, "version")

    def latest(self, msg_type: str, algorithm: str, up_to: int | None = None) -> DataFrame:
        """The latest models of all devices; up_to: of these versions only."""
        own = self.all().filter((F.col("msg_type") == msg_type) & (F.col("algorithm") == algorithm))
        return current(own if up_to is None else own.filter(F.col("version") <= up_to), KEYS, "version")

    def find(self, device: str, msg_type: str, algorithm: str) -> DataFrame:
        return self.load().filter((F.col("device") == device) & (F.col("msg_type") == msg_type) & (F.col("algorithm") == algorithm))

    def store_metrics(self, counts: DataFrame, device: str, msg_type: str, algorithm: str, version: int) -> None:
        """counts: device, tp, tn, fp, fn."""
        rows = counts.select(F.col(device).cast("string").alias("device"), F.lit(msg_type).alias("msg_type"), F.lit(algorithm).alias("algorithm"), F.lit(version).cast("long").alias("version"), *(F.col(c).cast("long").alias(c) for c in ("tp", "tn", "fp", "fn")))
        self.evaluations.write(rows, f"{msg_type}-{algorithm}/{version}", version)

    def metrics(self) -> DataFrame:
        """Confusion counts of the latest version of each device's models."""
        found = self.evaluations.read()
        return self.spark.createDataFrame([], METRICS) if found is None else current(found, KEYS, "version")
