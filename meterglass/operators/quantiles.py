"""Exact quantiles by group, without all values of a group in one place.

The two order statistics that a quantile lies between are narrowed down by histograms: BINS equal bins over the range that is
left, with the count, least and greatest value of each, which tasks add up before the shuffle; the bin that holds the
lower one is the next range, by its own least and greatest value. Once no range holds more than HELD values, these are
sorted. Groups of up to HELD values need no histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterglass.runtime import settled

BINS, HELD = 4096, 20_000


def quantile(rows: DataFrame, group: str, value: str, share: float, bins: int = BINS, held: int = HELD) -> DataFrame:
    """group and value: the quantile, linear between the order statistics around it; nulls and NaNs do not count."""
    x = F.col(value).cast("double")
    rows = rows.select(group, x.alias("_x")).filter("_x is not null and not isnan(_x)")
    at = (F.col("_all") - 1) * F.lit(float(share))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_all"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # _skip: values below the range; _n: values in it; _next: the upper order statistic, where the range is the lower one alone
    state = settled(sizes.select(group, "_all", F.floor(at).alias("_low"), (at - F.floor(at)).alias("_part"), "_lo", "_hi", F.lit(0).cast("long").alias("_skip"), F.col("_all").alias("_n"), F.lit(None).cast("double").alias("_next")), "quantile")
    while not (open_ := state.filter((F.col("_n") > held) & (F.col("_lo") < F.col("_hi")))).isEmpty():
        inside = rows.join(open_, group).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        bin_ = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        # BINS rows a group
        counts = inside.groupBy(group, bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        order = Window.partitionBy(group).orderBy("_bin")
        known = counts.withColumns({"_before": F.sum("_c").over(order) - F.col("_c"), "_after": F.lead("_least").over(order)}).join(open_, group)
        rank = F.col("_low") - F.col("_skip")
        own = known.filter((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")))
        last = rank + 1 >= F.col("_before") + F.col("_c")
        narrowed = own.select(group, "_all", "_low", "_part", F.when(last, F.col("_most")).otherwise(F.col("_least")).alias("_lo"), F.col("_most").alias("_hi"), (F.col("_skip") + F.col("_before")).alias("_skip"), F.col("_c").alias("_n"), F.when(last, F.col("_after")).alias("_next"))
        shut = state.filter((F.col("_n") <= held) | (F.col("_lo") >= F.col("_hi")))
        state = settled(shut.unionByName(narrowed), "quantile")
    single = F.col("_lo") >= F.col("_hi")
    # ranges of one value are known; the others hold HELD values at most
    exact = rows.join(state.filter(~single), group).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).groupBy(group).agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    place = (F.col("_low") - F.col("_skip")).cast("int")
    both = state.join(exact, group, "left")
    low = F.when(single, F.col("_lo")).otherwise(F.get("_v", place))
    high = F.when(single, F.coalesce("_next", "_lo")).otherwise(F.coalesce(F.get("_v", place + 1), "_next", low))
    return both.select(group, (low + (high - low) * F.col("_part")).alias("value"))
