"""Quality classifier: supervised subword embeddings (subword_model.py) on labels.quality.

Labels are learned only from rows whose crc32(doc_id as text) modulo 3 is not 1, and at
most SAMPLE_ROWS of them; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts get the score of a text without features; a null
doc_id has no label and is not held out; a doc_id that is labelled twice counts once,
with its lower label; without labels every score is 0.5; repeated rows get the same
score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.subword_model import SAMPLE_ROWS, fit, score_batches


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    model = fit(source, known.filter(~held_out(F.col("doc_id"))), 2, sample_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p, _ in score_batches(held, batches):
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(p[:, 1]), pa.array((p[:, 1] >= 0.5).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    return source.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
