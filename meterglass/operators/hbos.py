"""Histogram-based outlier scores (Goldstein and Dengel 2012), one model per device, by aggregates and joins alone.

A feature of a device with n training rows gets round(sqrt(n)) equal-width bins over
[min, max] (a constant feature: a range of 1 around it). A row's score is the sum
over features of -log2(density + alpha); a value outside the range by more than
`tolerance` bin widths scores as the rarest bin. Rows above the (1 - contamination)
quantile of the training scores are outliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.operators.quantiles import quantile
from meterglass.runtime import settled

ALPHA, TOLERANCE, CONTAMINATION, DIGITS = 0.1, 1e-20, 1 / 3, 6


def long_form(df: DataFrame, device: str, key: str, features: list[str]) -> DataFrame:
    """device, key, feature, x."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in sorted(features)))
    return df.select(device, key, F.inline(cells)).filter("x is not null and not isnan(x)")


def fit(df: DataFrame, device: str, key: str, features: list[str]) -> DataFrame:
    """One row per device and feature: lo, width, bins, the density of each bin, and that of the rarest."""
    cells = long_form(df, device, key, features)
    shape = cells.groupBy(device, "feature").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    bins = F.greatest(F.lit(1), F.bround(F.sqrt("n"), 0).cast("int"))
    flat = F.col("least") == F.col("most")
    shape = shape.select(device, "feature", "n", F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("lo"), F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("hi"), bins.alias("bins"))
    shape = shape.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    counts = cells.join(shape, [device, "feature"]).groupBy(device, "feature", at.alias("bin")).agg(F.count("*").alias("c"))
    held = counts.groupBy(device, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("counts"))
    count = lambda b: F.coalesce(F.try_element_at("counts", b), F.lit(0))
    densities = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda b: count(b) / (F.col("n") * F.col("width")))
    model = shape.join(held, [device, "feature"]).withColumn("density", densities)
    return model.select(device, "feature", "n", "lo", "hi", "bins", "width", "density", F.array_min("density").alias("rarest"))


def score(df: DataFrame, model: DataFrame, device: str, key: str, features: list[str], alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """device, key, score (rounded to DIGITS, so that engines agree on ties)."""
    names = sorted(features)
    # one row a device, so that rows meet their models by one join and stay in place
    cell = F.struct("lo", "hi", "bins", "width", "density", "rarest")
    per = model.groupBy(device).agg(*(F.first(F.when(F.col("feature") == f, cell), ignorenulls=True).alias(f"_m{i}") for i, f in enumerate(names)))
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    wide = df.select(device, key, *(known(f).alias(f"_x{i}") for i, f in enumerate(names))).join(per, device)

    def part(i: int):
        x, m = F.col(f"_x{i}"), F.col(f"_m{i}")
        lo, width = m["lo"], m["width"]
        outside = (x < lo - tolerance * width) | (x > m["hi"] + tolerance * width)
        at = F.greatest(F.lit(0), F.least(F.floor((x - lo) / width).cast("int"), m["bins"] - 1))
        density = F.when(outside, m["rarest"]).otherwise(F.get(m["density"], at))
        return F.when(x.isNotNull() & m.isNotNull(), -F.log2(density + alpha))

    parts = wide.select(device, key, *(part(i).alias(f"_p{i}") for i in range(len(names)))).filter(reduce(lambda a, b: a | b, (F.col(f"_p{i}").isNotNull() for i in range(len(names)))))
    # summed in the order of their names
    total = reduce(lambda a, b: a + b, (F.coalesce(F.sum(f"_p{i}"), F.lit(0.0)) for i in range(len(names))))
    return parts.groupBy(device, key).agg(F.round(total, DIGITS).alias("score"))


def thresholds(scores: DataFrame, device: str, contamination: float = CONTAMINATION) -> DataFrame:
    # written once: the quantile reads the scores several times
    held = scores if hasattr(scores, "settled_at") else settled(scores.select(device, "score"), "scores")
    return quantile(held, device, "score", 1 - contamination).select(device, F.round("value", 9).alias("threshold"))


def predict(scores: DataFrame, limits: DataFrame, device: str) -> DataFrame:
    return scores.join(limits, device).withColumn("prediction", (F.col("score") > F.col("threshold")).cast("int"))


def train_and_label(df: DataFrame, device: str, key: str, features: list[str]) -> DataFrame:
    """Scores and labels of the training rows themselves."""
    scores = settled(score(df, fit(df, device, key, features), device, key, features), "scores")
    return predict(scores, thresholds(scores, device), device)
