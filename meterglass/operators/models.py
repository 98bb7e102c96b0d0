"""Detectors as models: fitted for all devices in one job, kept as rows (device, part, params, arrays), scored apart.

params is JSON: features (the columns that the device has, which are all that its model learns from) and the model's numbers, the
same in each part of a device. arrays holds what is long: nodes of trees, support vectors, training rows, in as many parts
as bound what one task has in hand; part 0 is always there. Histogram models are fitted and scored by aggregates and
joins and live in params alone. Parts of forests and support vectors score rows apart, and their sums are added up by row;
the training rows of local outlier factors are searched by cells. So neither a device's rows nor its whole model meet in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.operators import forests, hbos, lof, svm
from meterglass.operators.quantiles import quantile
from meterglass.operators.vectors import from_map, matrix, usable, vectors
from meterglass.runtime import dealt, settled, ship

ALGORITHMS = ("lof", "if_custom", "if_sklearn", "hbos", "ocsvm")
BLOCK_ROWS = 50_000
DIGITS = 6  # of scores, so that engines agree on them
HISTOGRAM = "struct<cells: array<struct<feature: string, n: bigint, lo: double, hi: double, bins: int, width: double, density: array<double>, rarest: double>>, threshold: double>"
META = "struct<features: array<string>, trees: int, sample: int, cut: double, k: int, rho: double, gamma: double, gap: double>"
COLUMNS = "part int, params string, arrays map<string, array<double>>"


def _rows(parts: DataFrame, of: DataFrame, device: str, numbers: list[str]) -> DataFrame:
    """Parts as model rows; devices that nothing was learned for get an empty one."""
    meta = F.to_json(F.struct("features", *numbers))
    own = of.join(parts, device, "left")
    return own.select(device, F.coalesce("part", F.lit(0)).alias("part"), F.when(F.col("part").isNull(), F.to_json(F.struct(F.array().cast("array<string>").alias("features")))).otherwise(meta).alias("params"), "arrays")


def fit(train: DataFrame, algorithm: str, device: str, key: str, features: list[str], seed: int = forests.SEED) -> DataFrame:
    """device, part, params, arrays."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}")
    if algorithm == "hbos":
        model = settled(hbos.fit(train, device, key, features), "histograms")
        limits = hbos.thresholds(hbos.score(train, model, device, key, features), device)
        cell = F.struct("feature", "n", "lo", "hi", "bins", "width", "density", "rarest")
        per = model.groupBy(device).agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # a cell for each feature
        made = per.join(limits, device).select(device, F.to_json(F.struct("cells", "threshold")).alias("params"))
        return made.select(device, F.lit(0).alias("part"), "params", F.lit(None).cast("map<string, array<double>>").alias("arrays"))
    of = settled(usable(train, device, features), "features")
    rows = settled(vectors(train, of, device, key, features).filter("v is not null"), "vectors")
    if algorithm == "lof":
        return _rows(lof.fit(rows, device, key), of, device, ["k"])
    if algorithm == "ocsvm":
        return _rows(svm.fit(rows, device, key), of, device, ["rho", "gamma", "gap"])
    grown = settled(forests.fit(rows, algorithm, device, key, seed), "forest")
    share = forests.CONTAMINATION[algorithm]
    if share is None:
        return _rows(grown.withColumn("cut", F.lit(0.5)), of, device, ["trees", "sample", "cut"])
    plain = _rows(grown, of, device, ["trees", "sample"])
    cuts = quantile(sums(rows, plain, algorithm, device, key).select(device, "score"), device, "score", 1 - share).select(device, F.round("value", 9).alias("cut"))
    return _rows(grown.join(cuts, device), of, device, ["trees", "sample", "cut"])


def sums(rows: DataFrame, models: DataFrame, algorithm: str, device: str, key: str) -> DataFrame:
    """device, key, score and the numbers of the model as `m`, of rows (device, key, v); null where v is."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    parts = models.groupBy(device).agg((F.max("part") + 1).alias("_parts"))
    blocks = rows.groupBy(device).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")).join(parts, device)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select(device, key, "v").join(blocks, device).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).withColumn("part", spread("_parts")).drop("_parts", "_blocks")
    meta = F.from_json("params", META)
    right = models.select(device, "part", "arrays", meta.getField("gamma").alias("gamma")).join(blocks.drop("_parts"), device).withColumn("_block", spread("_blocks")).drop("_blocks")

    def run(some: pa.Table, model: pa.Table) -> pa.Table:
        value, fits = np.zeros(some.num_rows), np.zeros(some.num_rows, bool)
        if some.num_rows and model.num_rows and model.column("arrays")[0].is_valid:
            v = some.column("v").combine_chunks()
            fits = v.is_valid().to_numpy(zero_copy_only=False)
            x = matrix(v.drop_null())
            held = from_map(model.column("arrays"))
            if len(x) and algorithm == "ocsvm":
                value[fits] = svm.products(x, held["v"].reshape(-1, x.shape[1]), held["a"], model.column("gamma")[0].as_py())
            elif len(x):
                value[fits] = forests.depths(held, x)
        return pa.table([some.column(device), some.column(key), pa.array(value, mask=~fits)], names=[device, key, "_value"])

    group = [device, "_block", "part"]
    found = dealt(left, *group).groupBy(*group).cogroup(dealt(right.toDF(*right.columns), *group).groupBy(*group)).applyInArrow(run, f"`{device}` {kinds[device]}, `{key}` {kinds[key]}, _value double")
    total = found.groupBy(device, key).agg(F.sum("_value").alias("_value"))
    wide = total.join(models.filter("part = 0").select(device, meta.alias("m")), device)
    score = F.col("m.rho") - F.col("_value") if algorithm == "ocsvm" else forests.score_of(F.col("_value"), F.col("m.trees"), F.col("m.sample"))
    return wide.select(device, key, F.round(score, 9 if algorithm == "ocsvm" else DIGITS).alias("score"), "m")


def score(rows: DataFrame, models: DataFrame, algorithm: str, device: str, key: str, features: list[str]) -> DataFrame:
    """device, key, score, prediction of the rows of devices that have a model; null where a value is missing."""
    if algorithm == "hbos":
        read = models.select(device, F.from_json("params", HISTOGRAM).alias("m"))
        found = hbos.score(rows, read.select(device, F.inline("m.cells")), device, key, features)
        return hbos.predict(found, read.select(device, F.col("m.threshold").alias("threshold")), device).select(device, key, "score", "prediction")
    of = models.filter("part = 0").select(device, F.from_json("params", META).getField("features").alias("features"))
    asked = vectors(rows, of, device, key, features)
    if algorithm == "lof":
        held = models.filter("arrays is not null").select(device, F.from_json("params", META).getField("k").alias("k"), "arrays")
        trained = settled(lof.unpacked(held, device), "lof-model")
        asked = settled(asked, "vectors")
        found = lof.scores(trained, asked.filter("v is not null"), device, key).select(device, key, F.col("lof").alias("score"))
        out = asked.select(device, key).join(found, [device, key], "left")
        return out.withColumn("prediction", (F.col("score") > lof.CUT).cast("int"))
    found = sums(asked, models, algorithm, device, key)
    limit = F.lit(0.0) if algorithm == "ocsvm" else F.col("m.cut")
    return found.select(device, key, "score", (F.col("score") > limit).cast("int").alias("prediction"))


def learned_scores(train: DataFrame, others: DataFrame, algorithm: str, device: str, key: str, features: list[str], with_train: bool = False, seed: int = forests.SEED) -> DataFrame:
    """device, key, score, prediction of other rows (with_train: of the training rows too) by models that are learned for this alone, and not kept:
    what score() gives by what fit() made. The trees of forests score rows where they are grown."""
    rows = others.unionByName(train) if with_train else others
    if algorithm not in forests.CONTAMINATION:
        return score(rows, settled(fit(train, algorithm, device, key, features, seed), "fitted"), algorithm, device, key, features)
    of = settled(usable(train, device, features), "features")
    vector = lambda x: settled(vectors(x, of, device, key, features), "vectors")
    own, asked = vector(train), vector(others).withColumn("learned", F.lit(False))
    own = own.filter("v is not null") if not with_train else own
    share = forests.CONTAMINATION[algorithm]
    if with_train or share is not None:
        asked = asked.unionByName(own.withColumn("learned", F.lit(True)))
    found = forests.grown_sums(own.filter("v is not null"), asked.filter("v is not null"), algorithm, device, key, seed)
    scores = settled(found.select(device, key, "learned", F.round(forests.score_of(F.col("_value"), F.col("trees"), F.col("sample")), DIGITS).alias("score")), "forest-scores")
    if share is None:
        cut = scores.withColumn("cut", F.lit(0.5))
    else:
        cuts = quantile(scores.filter("learned"), device, "score", 1 - share).select(device, F.round("value", 9).alias("cut"))
        cut = scores.join(cuts, device)
    out = cut.select(device, key, "learned", "score", (F.col("score") > F.col("cut")).cast("int").alias("prediction"))
    missing = asked.filter("v is null").select(device, key, "learned", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("prediction"))
    out = out.unionByName(missing)
    return (out if with_train else out.filter("not learned")).drop("learned")


def nodes(models: DataFrame, device: str) -> DataFrame:
    """A forest's nodes as rows: device, part, node, tree (of roots, else null), feature (its name; null for leaves), cut, left and value."""
    meta = F.from_json("params", META)
    held = models.filter("arrays is not null").select(device, "part", meta.getField("features").alias("_f"), *(F.col("arrays")[n].alias(f"_{n}") for n in (*forests.ARRAYS, "roots")))
    cells = F.arrays_zip(*(f"_{n}" for n in forests.ARRAYS))
    rows = held.select(device, "part", "_f", "_roots", F.posexplode(cells).alias("node", "c"))
    leaf = F.col("c._feature") < 0
    place = F.array_position("_roots", F.col("node").cast("double"))
    return rows.select(device, "part", "node", F.when(place > 0, place - 1).alias("tree"), F.when(~leaf, F.get("_f", F.col("c._feature").cast("int"))).alias("feature"), F.col("c._cut").alias("cut"), F.when(~leaf, F.col("c._left").cast("int")).alias("left"), F.when(leaf, F.col("c._value")).alias("value"))


__all__ = ["ALGORITHMS", "COLUMNS", "HISTOGRAM", "META", "fit", "learned_scores", "nodes", "score", "sums"]
