"""Per-device preparation, for all devices in one grouped plan."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterglass.functions import exprs as X
from meterglass.runtime import dealt

MIN_ROWS, MIN_ROWS_STREAM = 50, 30000
ATTACK_SHARE, ATTACK_MOST = 0.2, 30
ORDERED = 20_000  # rows of a device whose means are summed in order, and of a block of a larger one


def size_gate(df: DataFrame, device: str, least: int = MIN_ROWS) -> DataFrame:
    """Rows of devices with `least` rows or more. The counts are aggregated first; rows are not ranked or collected."""
    big = df.groupBy(device).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(device)
    return df.join(big, device, "left_semi")


def null_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null counts of all columns, in one pass."""
    return df.agg(*(F.count(c).alias(c) for c in columns))


def mean_impute(df: DataFrame, device: str, columns: list[str], key: str | None = None, ordered: int = ORDERED) -> DataFrame:
    """Nulls and NaNs become the device's mean of the column (as double); other values stay.

    Means that are short decimals are exact (exprs.exact_mean), so one that equals a value of the device is that value. Of others, with a key,
    values of devices of up to `ordered` rows are summed in its order, so the last bit does not depend on how rows are shuffled. Larger
    devices have the mean of the aggregate, so no window holds more rows."""
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    means = df.groupBy(device).agg(F.count("*").alias("_n"), *(F.avg(usable(c)).alias(f"_mean_{c}") for c in columns), *(X.exact_mean(usable(c)).alias(f"_exact_{c}") for c in columns))
    wide, mean = df.join(means, device), {c: F.col(f"_mean_{c}") for c in columns}
    if key is not None:
        block = F.when(F.col("_n") > ordered, F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / ordered)))
        whole = Window.partitionBy(device, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wide = wide.withColumn("_block", block).withColumns({f"_own_{c}": F.avg(usable(c)).over(whole) for c in columns})
        mean = {c: F.when(F.col("_n") <= ordered, F.col(f"_own_{c}")).otherwise(mean[c]) for c in columns}
    return wide.select(*(F.coalesce(usable(c), F.col(f"_exact_{c}"), mean[c]).alias(c) if c in columns else c for c in df.columns))


def in_order(df: DataFrame, device: str, order: list[str], ordered: int = ORDERED) -> DataFrame:
    """The rows of a device of up to `ordered` rows in order and in one task, so that its sums do not depend on how rows are shuffled; larger
    devices in blocks of that many."""
    sizes = df.groupBy(device).agg(F.count("*").alias("_n"))
    block = F.when(F.col("_n") > ordered, F.pmod(F.xxhash64(*order), F.ceil(F.col("_n") / ordered)))
    wide = df.join(sizes, device).withColumn("_block", block)
    return dealt(wide, device, "_block").sortWithinPartitions(device, "_block", *order).drop("_n", "_block")


def in_train(key: Column, share: int = 80) -> Column:
    """Deterministic split by a hash of the key: whatever the partitions, a row stays on its side."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < share


def random_split(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([0.8, 0.2], seed)
    return train, test


def attack_count(n: Column) -> Column:
    """A fifth of the test rows, rounded half to even; at least 1, at most 30."""
    return F.greatest(F.lit(1), F.least(F.bround(n * ATTACK_SHARE, 0).cast("int"), F.lit(ATTACK_MOST)))


def attack_pools(seed: int = 42) -> dict[str, list[float]]:
    """Values that attacks give to the parameters of a message, the same for the same seed."""
    rng = random.Random(seed)
    whole = lambda n, a, b: [float(rng.randint(a, b)) for _ in range(n)]
    tenths = lambda n, a, b: [round(rng.uniform(a, b), 1) for _ in range(n)]
    # fixed values: the parameters, and how many values of which range each has
    return {
        "SF": [7.0, 8.0, 9.0, 10.0, 11.0, 12.0],
        "BW": [125.0, 250.0, 500.0],
        "PHYPayloadLen": whole(7, 200, 10000),
        "powe": whole(7, 200, 10000),
        "size": whole(7, 200, 10000),
        "rssi": tenths(7, -130, -20),
        "lsnr": tenths(7, -20, -10),
        "codr": tenths(5, 0, 1),
        "rfch": whole(7, 0, 30),
        "FCtrl": whole(10, 0, 255),
        "MHDR": whole(10, 0, 255),
        "MIC": whole(10, 0, 2**32),
        "FPort": whole(10, 1, 223),
        "freq": tenths(7, 867, 869),
        "FOpts": whole(10, 0, 2**120),
    }


#: Parameters that get new whole numbers where a device holds all values of all pools: from, to, how many.
REFILL = {"PHYPayloadLen": (200, 10000, 8), "powe": (200, 10000, 8), "size": (200, 10000, 8)}


def refilled(train: DataFrame, device: str, names: list[str]) -> DataFrame:
    """device and `_more`: for each refillable parameter that it has, numbers of its range that its training rows do not hold, spread over what is
    free; one above the largest if all are held. Of training values only whole numbers of the range are gathered, so as many as it has."""
    x = lambda p: F.col(p).cast("double")
    held = {p: F.collect_set(F.when(x(p).between(*REFILL[p][:2]) & (x(p) == F.floor(x(p))), x(p))) for p in names}
    seen = train.groupBy(device).agg(*(held[p].alias(f"_h_{p}") for p in names), *(F.max(x(p)).alias(f"_m_{p}") for p in names), *(F.count(p).alias(f"_n_{p}") for p in names))

    def values(p: str) -> Column:
        low, high, n = REFILL[p]
        free = F.array_except(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda v: v.cast("double")), F.col(f"_h_{p}"))
        some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(free, F.floor(i * F.size(free) / n).cast("int"))))
        return F.when(F.size(free) > 0, some).otherwise(F.array(F.col(f"_m_{p}") + 1))

    each = F.array(*(F.struct(F.lit(p).alias("name"), values(p).alias("values"), F.col(f"_n_{p}").alias("n")) for p in names))
    return seen.select(device, F.filter(each, lambda c: c["n"] > 0).alias("_more"))


def attack_values(train: DataFrame, device: str, pools: dict[str, list[float]], counters: tuple[str, ...] = ()) -> DataFrame:
    """device and `_attacks`: the parameters to change, in order of their names, each with the values that the device's training rows do not hold.

    Parameters that the device never has, or whose pool is used up, are left out; if none is left, the refillable ones of the pools
    get new values (refilled), and only without any of them the whole pools stand.
    A counter is reset: its one value is the least of training."""
    names = sorted({*pools, *counters})
    x = lambda p: F.col(p).cast("double")
    # of the training values only those in the pool are gathered: as many as the pool has at most
    held = {p: F.collect_set(F.when(x(p).isin(*pools[p]), x(p))) if p in pools else F.min(x(p)) for p in names}
    seen = train.groupBy(device).agg(*(held[p].alias(f"_h_{p}") for p in names), *(F.count(p).alias(f"_n_{p}") for p in names))
    pool = {p: F.array(*(F.lit(float(v)) for v in pools[p])) if p in pools else F.array(F.col(f"_h_{p}")) for p in names}
    fresh = {p: F.array_except(pool[p], F.col(f"_h_{p}")) if p in pools else pool[p] for p in names}
    listed = lambda of: F.filter(F.array(*(F.struct(F.lit(p).alias("name"), of[p].alias("values"), F.col(f"_n_{p}").alias("n")) for p in names)), lambda c: (c["n"] > 0) & (F.size(c["values"]) > 0))
    usable = seen.select(device, listed(fresh).alias("_fresh"), listed(pool).alias("_whole"))
    again = [p for p in names if p in pools and p in REFILL]
    if not again:
        return usable.select(device, F.when(F.size("_fresh") > 0, F.col("_fresh")).otherwise(F.col("_whole")).alias("_attacks"))
    used_up = train.join(usable.filter(F.size("_fresh") == 0).select(device), device, "left_semi")
    wide = usable.join(refilled(used_up, device, again), device, "left")
    more = F.when(F.size("_more") > 0, F.col("_more")).otherwise(F.col("_whole"))
    return wide.select(device, F.when(F.size("_fresh") > 0, F.col("_fresh")).otherwise(more).alias("_attacks"))


def attack_inject(train: DataFrame, test: DataFrame, device: str, key: str, pools: dict[str, list[float]], counters: tuple[str, ...] = ()) -> DataFrame:
    """Test rows with label `intrusion`: the first rows of each device by key get a value that training has not seen.

    Row i changes parameter i mod p to element i mod len of its values (attack_values). Only the first ATTACK_MOST keys
    of a device are ranked together, so a device with very many rows is no single task's work."""
    names = sorted({*pools, *counters})
    first = test.select(device, key).withColumn("_i", F.row_number().over(Window.partitionBy(device).orderBy(key)) - 1).filter(F.col("_i") < ATTACK_MOST)
    sizes = test.groupBy(device).agg(attack_count(F.count("*")).alias("_hits"))
    chosen = first.join(sizes, device).filter(F.col("_i") < F.col("_hits")).join(attack_values(train, device, pools, counters), device)
    at = F.get("_attacks", (F.col("_i") % F.size("_attacks")).cast("int"))
    chosen = chosen.filter(F.size("_attacks") > 0).withColumn("_a", at)
    chosen = chosen.select(device, key, F.col("_a.name").alias("_name"), F.get("_a.values", (F.col("_i") % F.size("_a.values")).cast("int")).alias("_value"))
    rows = test.join(chosen, [device, key], "left")
    changed = {p: F.when(F.col("_name") == p, F.col("_value")).otherwise(F.col(p).cast("double")) for p in names}
    return rows.withColumns(changed | {"intrusion": F.col("_name").isNotNull().cast("int")}).drop("_name", "_value")


def rows_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference."""
    return a.exceptAll(b)


def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
