"""Flattening of gateway messages and the cleaning that all message types share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.functions.exprs import cflist_split, data_rate, distinct_values, fraction_to_double, hex_to_decimal, known, pick
from meterglass.functions.phy import FIELDS, decode_base64
from meterglass.sources.io import MESSAGE

UPLINK_HEX = ("AppEUI", "DevEUI", "DevNonce")
COMMON_HEX = ("AppNonce", "CFList", "CFListType", "DLSettings", "FCnt", "FCtrl", "FOpts", "FPort", "MHDR", "MIC", "RxDelay")
TRANSMIT_UNUSED = ("ipol", "modu", "imme", "ncrc", "data")


def leaf_names(schema: T.DataType, kind: type | None = None, prefix: str = "") -> list[str]:
    """Dotted paths of the leaves of a schema, through structs and arrays of structs; of one type if given."""
    if isinstance(schema, T.ArrayType):
        return leaf_names(schema.elementType, kind, prefix)
    if isinstance(schema, T.StructType):
        return [n for f in schema.fields for n in leaf_names(f.dataType, kind, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix] if kind is None or isinstance(schema, kind) else []


def leaf_counts(value: Column, kind: T.DataType, prefix: str) -> dict[str, Column]:
    """For each leaf below a value, by its dotted path, how many of its values are known."""
    if isinstance(kind, T.StructType):
        return {n: c for f in kind.fields for n, c in leaf_counts(value[f.name], f.dataType, f"{prefix}.{f.name}").items()}
    if isinstance(kind, T.ArrayType):
        inner = leaf_counts(F.lit(None).cast(kind.elementType), kind.elementType, prefix)
        total = lambda n: F.aggregate(F.transform(value, lambda x: leaf_counts(x, kind.elementType, prefix)[n]), F.lit(0).cast("long"), lambda a, b: a + b)
        return {n: F.coalesce(total(n), F.lit(0).cast("long")) for n in inner}
    return {prefix: value.isNotNull().cast("long")}


def leaf_census(df: DataFrame) -> DataFrame:
    """leaf and known: how many values each leaf holds over all rows, through structs and arrays, in one pass."""
    counts = {n: c for f in df.schema.fields for n, c in leaf_counts(F.col(f.name), f.dataType, f.name).items()}
    one = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_{i}") for i, c in enumerate(counts.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("leaf"), F.col(f"_{i}").alias("known")) for i, n in enumerate(counts)))))


def numbered(value: Column, kind: T.DataType) -> Column:
    """A value with every boolean in it, at any depth, as 0/1."""
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    if not leaf_names(kind, T.BooleanType):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: numbered(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*(numbered(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))


def booleans_to_int(df: DataFrame) -> DataFrame:
    """Every boolean, also inside structs and arrays, as 0/1, null kept."""
    return df.withColumns({f.name: numbered(F.col(f.name), f.dataType) for f in df.schema.fields if leaf_names(f.dataType, T.BooleanType)})


def hex_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: hex_to_decimal(F.col(n)) for n in names if n in df.columns})


def flatten_uplink(df: DataFrame) -> DataFrame:
    """One row per message of the `rxpk` arrays; the antenna signals give chan/lsnr and chan2/lsnr2."""
    rows = df.select(F.inline("rxpk"))
    chan, lsnr = distinct_values(F.col("chan"), F.col("rsig.chan")), distinct_values(F.col("lsnr"), F.col("rsig.lsnr"))
    rows = rows.withColumns({"_c": chan, "_l": lsnr})
    rows = rows.withColumns({"chan": pick(F.col("_c"), 0), "chan2": pick(F.col("_c"), 1), "lsnr": pick(F.col("_l"), 0), "lsnr2": pick(F.col("_l"), 1)})
    return hex_columns(rows.drop("_c", "_l", "rsig"), UPLINK_HEX)


def flatten_stream(df: DataFrame) -> DataFrame:
    """The same for streamed messages: JSON parsed, payload decoded; malformed messages give no row."""
    rows = df.select(F.inline(F.from_json("message", MESSAGE)["rxpk"]))
    rows = rows.withColumn("_p", decode_base64(F.col("data")))
    rows = rows.select(*(c for c in rows.columns if c not in ("modu", "stat", "time", "data", "_p")), *(F.col(f"_p.{n}") for n in FIELDS))
    return hex_columns(rows, UPLINK_HEX)


def flatten_downlink(df: DataFrame) -> DataFrame:
    own = [c for c in df.columns if c != "txpk"]
    return df.select(*own, "txpk.*").drop(*TRANSMIT_UNUSED)


def clean(df: DataFrame, codr_bad: str = "sentinel") -> DataFrame:
    """Common cleaning: label, payload length, devices, code rate, data rate, hex fields as decimals."""
    if "PHYPayload" in df.columns:
        df = df.withColumn("PHYPayloadLen", F.length("PHYPayload")).withColumn("intrusion", F.lit(0)).drop("PHYPayload")
    df = df.filter(known(F.col("DevAddr")))
    if "CFListType" not in df.columns:
        rest, last = cflist_split(F.col("CFList"))
        df = df.withColumns({"CFList": rest, "CFListType": last})
    sf, bw = data_rate(F.col("datr"))
    df = df.withColumns({"codr": fraction_to_double(F.col("codr"), codr_bad), "SF": sf, "BW": bw}).drop("datr")
    return hex_columns(booleans_to_int(df), COMMON_HEX)


def etl(df: DataFrame, kind: str, stream: bool = False) -> DataFrame:
    """Raw log (or streamed message) frame to clean table. kind: rxpk or txpk."""
    return clean(flatten_stream(df) if stream else flatten_uplink(df) if kind == "rxpk" else flatten_downlink(df))
