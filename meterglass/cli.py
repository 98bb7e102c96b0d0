"""Command line: `python -m meterglass.cli etl|train|stream`."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.functions.exprs import duration_text
from meterglass.operators import training
from meterglass.operators.flatten import clean, etl, flatten_stream
from meterglass.operators.metrics import class_report
from meterglass.operators.prep import MIN_ROWS, MIN_ROWS_STREAM, attack_pools
from meterglass.operators.registry import Registry
from meterglass.runtime import settled
from meterglass.sources import io
from meterglass.streaming.scoring import Scorer, is_uplink, run_available, run_on

KINDS = ("rxpk", "txpk")
#: Clean columns that streamed messages do not have.
BATCH_ONLY = ("stat", "chan2", "lsnr2", "intrusion")


def truth(text: str) -> bool:
    return text.lower() in ("1", "true", "yes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meterglass")
    p.add_argument("command", choices=("etl", "train", "stream"))
    p.add_argument("--logs", default="./datasets")
    p.add_argument("--out", default="./tables")
    p.add_argument("--datasets_format", choices=("parquet", "json"), default="parquet")
    p.add_argument("--skip_dataset_generation_if_exists", type=truth, default=True)
    p.add_argument("--dev_addr", nargs="*", default=None)
    p.add_argument("--ml_algorithm", choices=training.ALGORITHMS, default="hbos")
    p.add_argument("--scaling", type=truth, default=False)
    p.add_argument("--with_feature_reduction", choices=("None", "PCA", "SVD"), default="None")
    p.add_argument("--least_rows", type=int, default=None, help="rows that a device needs for a model")
    p.add_argument("--refit", choices=("history", "batch", "never"), default="history")
    p.add_argument("--kafka", default="localhost:9092")
    p.add_argument("--messages", default=None, help="folder of message files to read in place of Kafka")
    p.add_argument("--udp_port", type=int, default=None, help="port of UDP datagrams to read in place of Kafka")
    p.add_argument("--spool", default="./spool", help="folder that keeps datagrams until their batch is done")
    p.add_argument("--every", default=None, help="interval of micro-batches")
    p.add_argument("--available_now", action="store_true", help="process what has arrived and end")
    return p


def clean_table(spark: SparkSession, args: argparse.Namespace, kind: str) -> DataFrame:
    path = f"{args.out}/{kind}.{args.datasets_format}"
    return io.materialise(spark, path, lambda: etl(io.read_logs(spark, args.logs, kind), kind), args.datasets_format, args.skip_dataset_generation_if_exists)


def numeric(df: DataFrame, without: tuple[str, ...] = ("intrusion",)) -> list[str]:
    """All numeric columns, in order of their names: what models learn from."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*without, "_key"))


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """A name by content, the same in each run; rows that repeat share it."""
    return df.withColumn("_key", F.xxhash64("DevAddr", *columns))


def train(spark: SparkSession, args: argparse.Namespace, kind: str) -> DataFrame:
    """Evaluate on injected attacks, then learn from all rows and store the models; returns the report."""
    rows = clean_table(spark, args, kind)
    if args.dev_addr:
        rows = rows.filter(F.col("DevAddr").isin(args.dev_addr))
    least = args.least_rows or MIN_ROWS
    reduction = None if args.with_feature_reduction == "None" else args.with_feature_reduction
    # streamed messages are scored by these models, so they learn from the columns that both have
    used = numeric(rows, BATCH_ONLY)
    # a key by content and the number of the copy: the split does not depend on how files are laid out
    copy = F.row_number().over(Window.partitionBy("DevAddr", "_key").orderBy("_key"))
    rows = keyed(rows.select("DevAddr", *used), used).withColumn("_copy", copy)
    rows = settled(rows.withColumn("_key", F.concat_ws("-", "_key", "_copy")).drop("_copy"), "numbered")
    pools = {k: v for k, v in attack_pools().items() if k in used}
    counters = ("FCnt",) if "FCnt" in used else ()
    found = training.evaluate(rows, args.ml_algorithm, "DevAddr", "_key", used, pools, least, args.scaling, reduction, counters)
    fitted = training.fit(settled(training.prepare(rows, "DevAddr", "_key", used, least), "prepared"), args.ml_algorithm, "DevAddr", "_key", used, args.scaling, reduction)
    counts = settled(training.by_device(found, "DevAddr"), "metrics")
    registry = Registry(spark, f"{args.out}/models")
    # a version before those of streams, in place of an earlier training's
    registry.store(training.stored(fitted, "DevAddr", kind, args.ml_algorithm), -1, f"{kind}-{args.ml_algorithm}")
    registry.store_metrics(counts, "DevAddr", kind, args.ml_algorithm, -1)
    return class_report(counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn"))))


def stream(spark: SparkSession, args: argparse.Namespace) -> Scorer:
    """Score uplink messages as they arrive, until stopped (or all that has arrived, with --available_now)."""
    if args.udp_port is not None:
        messages = io.datagram_messages(spark, args.udp_port, args.spool)
    else:
        messages = io.file_messages(spark, args.messages) if args.messages else io.kafka_messages(spark, args.kafka)
    rows = clean(flatten_stream(messages.filter(is_uplink(F.col("message")))))
    used = numeric(rows)
    rows = keyed(rows, used)
    reduction = None if args.with_feature_reduction == "None" else args.with_feature_reduction
    scorer = Scorer(spark, f"{args.out}/stream", "DevAddr", "_key", used, args.least_rows or MIN_ROWS_STREAM, args.refit, None, None, args.ml_algorithm, args.scaling, reduction, f"{args.out}/models")
    if not scorer.past.entries() and io.exists(spark, f"{args.out}/rxpk.{args.datasets_format}"):
        past = clean_table(spark, args, "rxpk")
        past = past.select("DevAddr", *(F.col(c) if c in past.columns else F.lit(None).cast("double").alias(c) for c in used))
        scorer.seed(keyed(past, used))
    if args.available_now:
        run_available(rows, scorer.batch, f"{args.out}/checkpoint")
    else:
        run_on(rows, scorer.batch, f"{args.out}/checkpoint", args.every).awaitTermination()
    return scorer


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("meterglass").getOrCreate()
    began = time.time()
    if args.command == "stream":
        stream(spark, args)
    else:
        for kind in KINDS:
            clean_table(spark, args, kind) if args.command == "etl" else train(spark, args, kind).show()
    print("took", duration_text(time.time() - began))


if __name__ == "__main__":
    main()
