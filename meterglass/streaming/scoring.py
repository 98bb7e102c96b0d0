"""Scoring of streamed messages with stored per-device models, and their refit on what was judged normal.

Batches are written under their number, so a batch that runs again replaces its own output: scores, normal rows
(the history) and model versions alike. A batch is scored by the models of earlier batches; a device without a model gathers
history until it has enough rows to learn from. Rows are numbered as they arrive, so messages that repeat are scored and kept each.

A refit touches the devices that the batch has added rows of, and reads their history alone: every COMPACT batches the
history becomes one folder dealt by device into buckets (sources/store.py), its moments one row a device, and models that later ones have replaced go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterglass.operators import training
from meterglass.operators.prep import size_gate
from meterglass.operators.registry import KEYS, Registry, current
from meterglass.runtime import discard, settled
from meterglass.sources.store import Store, bucket_of

COMPACT = 20


def is_uplink(message) -> F.Column:
    return message.startswith('{"rxpk"')


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that has arrived, batch by batch, and return."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_on(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that runs until it is stopped; `every`: the interval of batches, as soon as possible without."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer).start()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that holds each batch once, however often it is written."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def moments(rows: DataFrame, device: str, columns: list[str]) -> DataFrame:
    """device, and the sum and number of each column's values: what means need of a part of the history."""
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.groupBy(device).agg(*(F.sum(usable(c)).alias(f"_s_{c}") for c in columns), *(F.count(usable(c)).alias(f"_n_{c}") for c in columns))


def imputed(rows: DataFrame, known: DataFrame, device: str, columns: list[str]) -> DataFrame:
    """rows with nulls and NaNs as the means of their device. known: moments, any number of rows a device."""
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    means = known.groupBy(device).agg(*(F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"_m_{c}") for c in columns))
    return rows.join(means, device).withColumns({c: F.coalesce(usable(c), F.col(f"_m_{c}")) for c in columns}).drop(*(f"_m_{c}" for c in columns))


class Scorer:
    """Models by device: impute and score a batch, add its normal rows to the history, refit.

    refit: "history" (all that is kept), "batch" (the normal rows of the batch only) or "never" (stored models stay).
    keep: learn from the latest rows of each device only, by the column `time`. Models are read from and written to a
    registry (registry: its folder, else one beside the history); a model that training stored is used from the first batch on."""

    def __init__(
        self,
        spark,
        folder: str,
        device: str,
        key: str,
        features: list[str],
        least: int,
        refit: str = "history",
        keep: int | None = None,
        time: str | None = None,
        algorithm: str = "hbos",
        scale: bool = False,
        reduction: str | None = None,
        registry: str | None = None,
        msg_type: str = "rxpk",
        compact: int = COMPACT,
    ):
        if keep is not None and time is None:
            raise ValueError("keep needs a time column")
        if refit not in ("history", "batch", "never"):
            raise ValueError(f"no such refit: {refit}")
        self.columns = list(dict.fromkeys([device, key, *features, *([time] if time else [])]))
        self.spark, self.folder, self.device, self.key, self.features, self.least = spark, folder, device, key, features, least
        self.refit, self.keep, self.time, self.algorithm, self.scale, self.reduction, self.msg_type = refit, keep, time, algorithm, scale, reduction, msg_type
        self.compact_every = compact
        self.registry = Registry(spark, registry or f"{folder}/models")
        self.past, self.sums = Store(spark, f"{folder}/history", by=device), Store(spark, f"{folder}/moments", by=device)

    def arrived(self, df: DataFrame, number: int) -> DataFrame:
        """The rows of a batch, kept under the numbers that they have from now on."""
        rows = df.select(*self.columns).withColumn("_row", F.concat(F.lit(f"{number}-"), F.monotonically_increasing_id().cast("string")))
        self.past.schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        self.sums.schema = ", ".join([f"`{self.device}` {dict(rows.dtypes)[self.device]}", *(f"`_s_{c}` double" for c in self.features), *(f"`_n_{c}` bigint" for c in self.features)])
        return settled(rows, "batch")

    def seed(self, rows: DataFrame) -> None:
        """Cold start: the history before the first batch, and models of the devices with enough of it (but for those that have one)."""
        self.remember(self.arrived(rows, -1), -1)
        past = self.past.read(lambda e: e["v"] < 0)
        fresh = past.join(self.models(0, dict(rows.dtypes)[self.device]).select(self.device), self.device, "left_anti")
        self.learn(fresh, 0)

    def remember(self, rows: DataFrame, number: int) -> None:
        """Rows of the history, and their moments: imputation reads the moments alone."""
        self.past.write(rows, f"batch/{number}", number)
        own = self.past.read(lambda e: e["tag"] == f"batch/{number}")
        self.sums.write(moments(own, self.device, self.features), f"batch/{number}", number)

    def history(self, before: int) -> DataFrame | None:
        """The rows kept before a batch, repeats too."""
        found = self.past.read(lambda e: e["v"] < before)
        return found if found is None else found.drop("_row")

    def models(self, before: int, kind: str) -> DataFrame:
        """The latest models of versions up to `before`: those of batch n are version n + 1, of seeding 0, of batch training less."""
        own = self.registry.latest(self.msg_type, self.algorithm, before)
        return training.loaded(own, self.device, kind)

    def learn(self, rows: DataFrame, version: int) -> None:
        d = self.device
        train = size_gate(rows, d, self.least)
        if self.keep is not None:
            newest = Window.partitionBy(d).orderBy(F.desc(self.time), F.desc(self.key))
            train = train.withColumn("_at", F.row_number().over(newest)).filter(F.col("_at") <= self.keep).drop("_at")
        train = settled(imputed(train, moments(train, d, self.features), d, self.features), "learned-from")
        fitted = training.fit(train, self.algorithm, d, "_row", self.features, self.scale, self.reduction, [self.key, "_row"])
        self.registry.store(training.stored(fitted, d, self.msg_type, self.algorithm), version, f"{self.msg_type}-{self.algorithm}")
        discard(train)

    def batch(self, df: DataFrame, number: int) -> None:
        d, k, f = self.device, self.key, self.features
        df = self.arrived(df, number)
        if not df.isEmpty():
            known, past = moments(df, d, f), self.sums.read(lambda e: e["v"] < number)
            rows = imputed(df, known if past is None else known.unionByName(past), d, f)
            found = training.predict(rows, self.models(number, dict(df.dtypes)[d]), self.algorithm, d, "_row", f)
            scored = settled(df.select(d, k, "_row").join(found.select(d, "_row", "score", "prediction"), [d, "_row"], "left"), "scored")
            scored.drop("_row").write.mode("overwrite").parquet(f"{self.folder}/scored/batch={number}")
            normal = df.join(scored.filter("prediction = 1").select(d, "_row"), [d, "_row"], "left_anti").select(*df.columns)
            self.remember(normal, number)
            if self.refit != "never":
                latest = self.past.read(lambda e: e["tag"] == f"batch/{number}")
                self.learn(latest if self.refit == "batch" else self.of_devices(latest, number + 1), number + 1)
            discard(scored)
            if self.compact_every and number % self.compact_every == self.compact_every - 1:
                self.tidy(number)
        discard(df)

    def of_devices(self, latest: DataFrame, before: int) -> DataFrame:
        """The history of the devices that rows are of; of what is compacted only their buckets are opened."""
        buckets = {r.b for r in latest.select(bucket_of(F.col(self.device)).alias("b")).distinct().collect()}  # as many as buckets
        return self.past.read(lambda e: e["v"] < before, buckets).join(latest.select(self.device).distinct(), self.device, "left_semi")

    def tidy(self, number: int) -> None:
        """Compact what batches before this one, which may run again, have left."""
        d = self.device
        total = lambda rows: rows.groupBy(d).agg(*(F.sum(c).alias(c) for c in rows.columns if c != d))
        self.past.compact(number)
        self.sums.compact(number, lambda rows: total(rows))
        self.registry.models.compact(number, lambda rows: current(rows, KEYS, "version"))

    def scored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scored").drop("batch")
