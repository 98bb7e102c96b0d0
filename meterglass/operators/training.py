"""Training, storage and evaluation of one model per device, all devices in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.operators import metrics, models
from meterglass.operators.features import apply_transforms, fit_transforms
from meterglass.operators.models import ALGORITHMS
from meterglass.operators.prep import MIN_ROWS, attack_inject, in_order, in_train, mean_impute, size_gate
from meterglass.runtime import settled

MODEL = "features array<string>, shift array<double>, factor array<double>, components array<array<double>>, params string"


def prepare(df: DataFrame, device: str, key: str, features: list[str], least: int = MIN_ROWS) -> DataFrame:
    """Gate by size and impute; `training` marks the rows to learn from. A column that a device never has stays null."""
    gated = size_gate(df.select(device, key, *features), device, least)
    return mean_impute(gated, device, features, key).withColumn("training", in_train(F.col(key)))


def fit(train: DataFrame, algorithm: str, device: str, key: str, features: list[str], scale: bool = False, reduction: str | None = None, order: list[str] | None = None) -> DataFrame:
    """device, the transform of its rows (features, shift, factor, components), and part, params and arrays of its model: a row for each part.

    Deviations are summed in order (of the key, unless given): a value that lies on the edge of a bin falls to either side by their last bit."""
    transforms = settled(fit_transforms(in_order(train, device, order or [key]) if scale else train, device, features, scale, reduction), "transforms")
    rows, names = apply_transforms(train, transforms, device, features)
    rows = settled(rows, "transformed")  # fitting reads them several times
    return transforms.join(models.fit(rows, algorithm, device, key, names), device)


def predict(rows: DataFrame, fitted: DataFrame, algorithm: str, device: str, key: str, features: list[str]) -> DataFrame:
    """device, key, score, prediction of rows by the models of their devices."""
    changed, names = apply_transforms(rows, fitted.filter("part = 0"), device, features)
    return models.score(changed, fitted, algorithm, device, key, names)


def evaluate(df: DataFrame, algorithm: str, device: str, key: str, features: list[str], pools: dict[str, list[float]], least: int = MIN_ROWS, scale: bool = False, reduction: str | None = None, counters: tuple[str, ...] = ()) -> DataFrame:
    """Test rows with attacks injected: device, key, intrusion, prediction. Transforms and models are learned from training rows alone."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}")
    # written once: what follows reads the rows several times
    rows = settled(prepare(df, device, key, features, least), "prepared")
    train, test = rows.filter("training"), rows.filter("not training")
    attacked = attack_inject(train, test, device, key, pools, counters)
    fitted = settled(fit(train, algorithm, device, key, features, scale, reduction), "fitted")
    found = predict(attacked, fitted, algorithm, device, key, features)
    return attacked.select(device, key, "intrusion").join(found.select(device, key, "prediction"), [device, key])


def by_device(found: DataFrame, device: str) -> DataFrame:
    """device, tp, tn, fp, fn of evaluated rows; rows without a prediction count as normal ones."""
    return metrics.confusion(found.withColumn("prediction", F.coalesce("prediction", F.lit(0))), "intrusion", "prediction", [device])


def report(df: DataFrame, *args, **named) -> DataFrame:
    return metrics.class_report(metrics.confusion(evaluate(df, *args, **named), "intrusion", "prediction"))


def stored(fitted: DataFrame, device: str, msg_type: str, algorithm: str) -> DataFrame:
    """Rows for the registry: device, msg_type, algorithm, part, params (JSON of the transform and the model) and arrays."""
    whole = F.to_json(F.struct("features", "shift", "factor", "components", "params"))
    return fitted.select(F.col(device).cast("string").alias("device"), F.lit(msg_type).alias("msg_type"), F.lit(algorithm).alias("algorithm"), "part", whole.alias("params"), "arrays")


def loaded(rows: DataFrame, device: str, kind: str = "string") -> DataFrame:
    """The fitted models of registry rows. kind: type of the device column."""
    return rows.select(F.col("device").cast(kind).alias(device), "part", "arrays", F.from_json("params", MODEL).alias("_m")).select(device, "part", "_m.*", "arrays")
