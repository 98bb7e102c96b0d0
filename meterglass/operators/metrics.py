"""Confusion counts and classification reports, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn; 1 is the positive class."""
    count = lambda l, p: F.count_if((F.col(label) == l) & (F.col(prediction) == p))  # noqa: E731,E741
    return df.groupBy(*(by or [])).agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))


def class_report(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From tp, tn, fp, fn: accuracy, and precision, recall, F1 and support by class, macro and weighted; by: of each row of these columns."""
    by = by or []
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    total = tp + tn + fp + fn
    rows = F.array(*(F.struct(F.lit(n).alias("class"), ratio(hit, hit + wrong).alias("precision"), ratio(hit, hit + missed).alias("recall"), (hit + missed).alias("support")) for n, hit, wrong, missed in (("0", tn, fn, fp), ("1", tp, fp, fn))))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    each = counts.select(*by, ratio(tp + tn, total).alias("accuracy"), F.inline(rows)).withColumn("f1", f1)
    names = ("precision", "recall", "f1")
    macro = each.groupBy(*by, "accuracy").agg(F.lit("macro").alias("class"), *(F.avg(n).alias(n) for n in names), F.sum("support").alias("support"))
    weighted = each.groupBy(*by, "accuracy").agg(F.lit("weighted").alias("class"), *(ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)
