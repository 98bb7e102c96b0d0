"""Sources and sinks: gateway logs, clean tables, streams."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.functions.exprs import json_tail

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
_double = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]

#: Hex fields of a decoded frame, as the gateway logs name them.
FRAME = ("AppEUI", "AppNonce", "DLSettings", "CFList", "DevAddr", "DevEUI", "DevNonce", "FCnt", "FCtrl", "FOpts", "FPort", "PHYPayload", "MIC", "MHDR", "RxDelay")
SIGNAL = T.StructType(_long("chan") + _double("lsnr"))
UPLINK = T.StructType([T.StructField("rxpk", T.ArrayType(T.StructType(_text(*FRAME) + _long("chan") + _text("codr", "datr") + _double("freq", "lsnr") + _long("rfch") + [T.StructField("rsig", T.ArrayType(SIGNAL))] + _long("rssi", "size", "stat", "tmst"))))])
DOWNLINK_FRAME = ("AppNonce", "CFList", "DLSettings", "DevAddr", "FCtrl", "FCnt", "FOpts", "FPort", "PHYPayload", "MIC", "MHDR", "RxDelay")
TRANSMIT = T.StructType(_text("codr", "datr") + _double("freq") + _long("powe", "rfch", "size", "tmst") + [T.StructField("ipol", T.BooleanType()), T.StructField("imme", T.BooleanType()), T.StructField("ncrc", T.BooleanType())] + _text("modu", "data"))
DOWNLINK = T.StructType(_text(*DOWNLINK_FRAME) + [T.StructField("txpk", TRANSMIT)])
MESSAGE = T.StructType([T.StructField("rxpk", T.ArrayType(T.StructType(_long("chan") + _text("codr", "data", "datr") + _double("freq", "lsnr") + _text("modu") + _long("rfch", "rssi", "size", "stat") + _text("time") + _long("tmst"))))])
LOGS = {"rxpk": UPLINK, "txpk": DOWNLINK}


def read_logs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Line-delimited gateway logs `<kind>_*.log`, under their fixed schema (no pass over the input to infer one)."""
    return spark.read.schema(LOGS[kind]).json(f"{folder}/{kind}_*.log")


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return getattr(reader, form)(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    getattr(df.write.mode("overwrite"), form)(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialise(spark: SparkSession, path: str, make, form: str = "parquet", skip_if_exists: bool = True) -> DataFrame:
    """The table at path, under the schema of what make() describes; written first unless it is there and may be kept."""
    made = make()
    if not (skip_if_exists and exists(spark, path)):
        write_table(made, path, form)
    return read_table(spark, path, form, made.schema)


def kafka_messages(spark: SparkSession, servers: str, topic: str = "lorawan-messages") -> DataFrame:
    """A stream of datagrams as a string column `message` (needs Spark's Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(json_tail(F.col("value").cast("string")).alias("message"))


def file_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The same from text files that arrive in a folder."""
    return spark.readStream.text(folder).select(json_tail(F.col("value")).alias("message"))


def datagram_messages(spark: SparkSession, port: int, spool: str, host: str = "0.0.0.0") -> DataFrame:
    """The same from UDP datagrams (sources/datagrams.py)."""
    from pyspark import cloudpickle

    from meterglass.sources import datagrams

    # the process that plans a source does not see what executors import, so the source travels by value
    cloudpickle.register_pickle_by_value(datagrams)
    spark.dataSource.register(datagrams.DatagramSource)
    raw = spark.readStream.format("datagrams").options(port=port, spool=spool, host=host).load()
    return raw.select(json_tail(F.col("value").cast("string")).alias("message"))


def forward_datagrams(port: int, folder: str, limit: int | None = None, size: int = 4096) -> int:
    """Receive UDP datagrams and drop each non-empty one as a file into a folder that a file stream watches.

    Names start with the time of the start, so those of a new start never replace files that are there."""
    import socket
    import time

    Path(folder).mkdir(parents=True, exist_ok=True)
    seen, start = 0, time.time_ns()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", port))
        while limit is None or seen < limit:
            data, _ = s.recvfrom(size)
            if data:
                hidden = Path(folder, f".{start}-{seen:012d}.tmp")
                hidden.write_bytes(data)
                hidden.rename(Path(folder, f"{start}-{seen:012d}.txt"))
                seen += 1
    return seen
