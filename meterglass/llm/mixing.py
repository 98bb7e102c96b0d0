"""Mixing to target weights by soft membership.

A classifier learned from the labels table (subword_model.py) predicts for each
document the posterior p_dk of each domain k. Document rates r_d >= 0 are fitted by
least squares so that the expected tokens of each domain, sum over d of
r_d * tokens_d * p_dk, match its target. The gradient in r_d is a function of the
document's posteriors and of one residual per domain, so a step of the (accelerated)
projected gradient is one distributed sum of as many numbers as there are domains;
rates are recomputed from the residuals of all steps and never collected. Steps are
scaled by 1 / tokens_d, so a rate depends on posteriors alone, not on length.

The steps start from a coarse solution: documents whose posteriors round to the same
cell of a grid (at most CELLS of them, whatever the input) share a rate, and the cells'
exact sums of expected tokens are all that a solution of this form needs, so it is found
by thousands of steps of the same projected gradient on one table of cells.
Steps over the documents follow until the largest error is within TOLERANCE of all tokens,
or until a step lowers the squared error by less than STALL of it. What is left is reported: target_error (largest
|expected - target| of a domain, as a share of all expected tokens) and feasible
(target_error <= TOLERANCE); targets beyond any rates, as of a domain of which every
document has a little, are met as far as least squares can.

mixed_documents (and total="supply") reads the weights of the junk domains (all but
clean) as upper bounds instead: documents most likely clean keep a rate of 1, the size
of the mixture follows from the clean tokens and clean's weight, and the other documents
are thinned only as far as a junk domain is over its share of that size. Junk tokens that
are scarce are all kept, and take nothing from the clean documents.

Domains, from labels: toxic (toxic = 1), low (quality = 0), clean (all others).

Defined cases: where no document is labelled clean there is nothing to size the mixture by, and
mixed_documents keeps every document, as it does without labels; null and empty texts have no tokens and the posteriors of a text
without features; a null doc_id is kept as null; repeated rows count each; without
labels all domains are equally likely, and no rates reach unequal targets (feasible is false);
an empty table gives an empty result; columns other than doc_id and text are ignored by
mixing_rates and kept, under any names, by mixed_documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.subword_model import SAMPLE_ROWS, fit, score_batches
from meterglass.runtime import settled, ship

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
STEPS, TOLERANCE = 60, 1e-4
GRID, CELLS, COARSE_STEPS = 256, 40_000, 20_000
STALL = 1e-3  # a step that lowers the squared error by a smaller share than this is the last


@dataclass
class Fit:
    """What rates follow from: the coarse rates by cell, step size, residuals by step, an upper bound of rates,
    and whether clean documents stay at 1; and what was reached: expected totals by domain, targets, the error."""

    step: float
    most: float
    targets: np.ndarray
    fitted: np.ndarray  # 1 for each domain whose residual counts
    grid: int
    clean_stays: bool = False
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    residuals: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None
    error: float = 0.0


def grid_for(domains: int) -> int:
    """Steps of a grid over the posteriors that has at most CELLS cells."""
    grid = GRID
    while grid > 1 and (grid + 1) ** (domains - 1) // 2 > CELLS:
        grid //= 2
    return grid


def cell_of(p: np.ndarray, grid: int) -> np.ndarray:
    """The cell of each row of posteriors."""
    at = np.zeros(len(p), np.int64)
    for k in range(p.shape[1] - 1):
        at = at * (grid + 1) + np.rint(p[:, k] * grid).astype(np.int64)
    return at


def stays_of(p: np.ndarray, clean_stays: bool) -> np.ndarray:
    """Which documents keep a rate of 1."""
    return p[:, 0] >= p.max(axis=1) if clean_stays else np.zeros(len(p), bool)


def rates_of(p: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(rate, point of the next gradient) of documents with posteriors p, after all steps so far."""
    rate = np.full(len(p), min(1.0, fit.most))
    if fit.cells.size:
        cell = cell_of(p, fit.grid)
        at = np.minimum(np.searchsorted(fit.cells, cell), fit.cells.size - 1)
        rate = np.where(fit.cells[at] == cell, fit.rates[at], rate)
    least, most = np.zeros(len(p)), np.full(len(p), fit.most)
    stays = stays_of(p, fit.clean_stays)
    rate[stays] = least[stays] = most[stays] = 1.0
    ahead, t = rate, 1.0
    for e in fit.residuals:
        new = np.clip(ahead - fit.step * (p @ e), least, most)
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t = new + (t - 1) / grown * (new - rate), new, grown
    return rate, ahead


def coarse_rates(sums: np.ndarray, tokens: np.ndarray, targets: np.ndarray, fitted: np.ndarray, step: float, most: float, whole: float) -> np.ndarray:
    """A rate for each cell by projected gradient. sums: expected tokens of each cell by domain; targets: without what is fixed."""
    mean = sums / np.maximum(tokens, 1e-300)[:, None]
    rate = np.full(len(sums), min(1.0, most))
    ahead, t, last = rate, 1.0, np.inf
    for i in range(COARSE_STEPS):
        new = np.clip(ahead - step * (mean @ (fitted * (ahead @ sums - targets))), 0.0, most)
        left = fitted * (new @ sums - targets)
        error = float(left @ left)
        t = 1.0 if error > last else t
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t, last = new + (t - 1) / grown * (new - rate), new, grown, error
        if np.abs(left).max() <= TOLERANCE / 4 * whole:
            break
        if i % 50 == 0 and np.isfinite(most):
            slope = mean @ left
            if 2 * (tokens * np.maximum(slope * rate, slope * (rate - most))).sum() <= (TOLERANCE / 4 * whole) ** 2:
                break
    return rate


def domain_labels(labels: DataFrame) -> DataFrame:
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic == 1, 2).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 0).alias("label"))


def posteriors(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_tokens and the posterior of each domain. docs: doc_id, text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p, words in score_batches(held, batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(words), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], axis=1), batch.column("n_tokens").to_numpy().astype(float)


def fit_rates(table: DataFrame, weights: dict[str, float], most: float = float("inf"), total: str = "corpus", steps: int = STEPS) -> Fit:
    """Projected-gradient least squares over a table of posteriors.

    total: tokens of the mixture - "corpus": as many as there are; "supply": as many as all clean tokens are clean's share of.
    With "supply" documents most likely clean have a rate of 1, and the weights of the other domains are upper bounds."""
    k = len(DOMAINS)
    share = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    share = share / share.sum()
    supply = total == "supply"
    if supply and share[0] <= 0:
        raise ValueError("a mixture sized by its clean documents needs a positive weight of clean")
    grid = grid_for(k)
    pairs = [(i, j) for i in range(k) for j in range(k)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by cell (-1: documents whose rate is fixed): tokens by domain, tokens, and the Gramian in all."""
        for batch in batches:
            p, tokens = matrix(batch)
            cell = np.where(stays_of(p, supply), -1, cell_of(p, grid))
            cells, at = np.unique(cell, return_inverse=True)
            by = lambda x: pa.array(np.bincount(at, weights=x, minlength=cells.size))  # noqa: B023,E731
            yield pa.record_batch([pa.array(cells), by(tokens), *(by(tokens * p[:, i]) for i in range(k)), *(by(tokens * p[:, i] * p[:, j]) for i, j in pairs)], names=["cell", "n", *(f"t{i}" for i in range(k)), *(f"g{i}{j}" for i, j in pairs)])

    numbers = ["n", *(f"t{i}" for i in range(k)), *(f"g{i}{j}" for i, j in pairs)]
    summed = table.mapInArrow(partial, "cell long, " + ", ".join(f"{c} double" for c in numbers)).groupBy("cell").agg(*(F.sum(c).alias(c) for c in numbers))
    # at most CELLS rows, whatever the input
    rows = np.array([[float(x) for x in r] for r in summed.orderBy("cell").collect()]).reshape(-1, 1 + len(numbers))
    free = rows[:, 0] >= 0
    sums = rows[:, 2 : 2 + k]
    fixed, now = sums[~free].sum(axis=0), sums.sum(axis=0)
    gram = rows[free, 2 + k :].sum(axis=0).reshape(k, k)
    whole = float(now.sum()) or 1.0
    targets = share * whole
    fitted = np.ones(k)  # domains whose residuals count
    if supply:
        whole = now[0] / share[0] or 1.0
        targets = np.append(now[:1], np.maximum(fixed, np.minimum(now, share * whole))[1:])
        fitted[0] = 0.0
    step = 1.0 / max(float(np.linalg.eigvalsh(gram * np.outer(fitted, fitted))[-1]), 1e-300)
    found = Fit(step, most, targets, fitted, grid, supply, rows[free, 0].astype(np.int64))
    found.rates = coarse_rates(sums[free], rows[free, 1], targets - fixed, fitted, step, most, whole)
    schema = ", ".join(f"s{i} double, a{i} double" for i in range(k))

    def expected(own: Fit) -> np.ndarray:
        """Expected tokens by domain at the rates, and at the point of the next gradient."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, 2))
            for batch in batches:
                p, tokens = matrix(batch)
                rate, ahead = rates_of(p, own)
                out[:, 0] += (rate * tokens) @ p
                out[:, 1] += (ahead * tokens) @ p
            yield pa.record_batch([pa.array([x]) for x in out.ravel()], names=[f"{c}{i}" for i in range(k) for c in "sa"])

        got = table.mapInArrow(run, schema).agg(*(F.coalesce(F.sum(f"{c}{i}"), F.lit(0.0)).alias(f"{c}{i}") for i in range(k) for c in "sa")).first()
        return np.array([float(x) for x in got]).reshape(k, 2)

    last = np.inf
    for _ in range(steps + 1):
        at = expected(found)
        found.totals, left = at[:, 0], fitted * (at[:, 0] - targets)
        found.error = float(np.abs(left).max() / whole)
        if found.error <= TOLERANCE or float(left @ left) > (1 - STALL) * last:
            break
        last = float(left @ left)
        found.residuals = [*found.residuals, fitted * (at[:, 1] - targets)]
    return found


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, sample_rows: int = SAMPLE_ROWS, most: float = float("inf"), total: str = "corpus") -> DataFrame:
    """One row per document: doc_id, n_tokens, the posterior of each domain, its rate, and target_error and feasible of the whole fit."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = settled(posteriors(source, fit(source, domain_labels(labels), len(DOMAINS), sample_rows)), "posteriors")
    found = fit_rates(table, weights or WEIGHTS, most, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = rates_of(matrix(batch)[0], found)
            yield pa.record_batch([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    rated = table.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", rate double")
    return rated.withColumns({"target_error": F.lit(found.error), "feasible": F.lit(found.error <= TOLERANCE)})


def mixed_documents(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the mixture keeps, with all their columns.

    Rates are bounded by 1 (no document is repeated); documents most likely clean all stay, and the
    weights of the other domains are upper bounds. A document with rate r stays if a hash of its id and
    text, as a number from 0 to 1, is below r. learn_from: the documents that labels belong to."""
    spark = docs.sparkSession
    ship(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    domains = domain_labels(labels)
    if domains.filter("label = 0").join(learn_from.select(columns[0]), "doc_id", "left_semi").isEmpty():
        return docs
    model = fit(learn_from.select(*columns), domains, len(DOMAINS), sample_rows)
    found = fit_rates(settled(posteriors(docs.select(*columns), model), "posteriors"), weights or WEIGHTS, 1.0, "supply")
    held = spark.sparkContext.broadcast(model)
    # columns by place, whatever their names; each text passes once
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    key = [F.col(own[docs.columns.index("doc_id")]).cast("long"), F.col(own[at]).cast("string")]
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), *key), 11) / F.lit(float(1 << 53))
    wide = docs.toDF(*own).withColumn("unit", unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p, _ in score_batches(held, batches, at):
            stays = part.column(len(own)).to_numpy() < rates_of(p, found)[0]
            yield pa.record_batch(part.columns[:-1], names=own).filter(pa.array(stays))

    return wide.mapInArrow(run, wide.drop("unit").schema).toDF(*docs.columns)
