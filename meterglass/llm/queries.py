"""The corpus operators as queries over the driver's tables, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterglass.llm import exact_dedup as exact
from meterglass.llm import fertility, importance, piecewise, secrets, spelling, warc
from meterglass.llm.bagminhash import near_duplicates
from meterglass.llm.exact_dedup import exact_dedup
from meterglass.llm.fertility import quality_rules
from meterglass.llm.mixing import mixing_rates
from meterglass.llm.quality_model import quality_scores
from meterglass.llm.secrets import secret_scan
from meterglass.llm.sentencepiece_codec import sentencepiece_encode
from meterglass.llm.substring_dedup import substring_dedup
from meterglass.llm.suffix_dedup import suffix_dedup
from meterglass.runtime import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), misspell=spelling.MISSPELL)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edited_likeness(table(spark, sf_dir, "documents"))


def fingerprint_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the fingerprints' query that SQL can express."""
    return op13_piecewise_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the quality rules, which SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *(x.split()[0] for x in fertility.BASE.split(", ")))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the secret scan, which SQL can express."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_substring_dedup, op3_exact_dedup, op4_suffix_dedup, op5_secret_scan, op6_quality_classifier, op7_quality_rules, op8_bagminhash, op9_warc, op10_mixing, op11_spelling_variants, op12_importance_resampling, op13_piecewise_fingerprints, fingerprint_base, quality_base, secret_base)
}
ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": exact.ORACLE, "op9_warc": warc.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_importance_resampling": importance.ORACLE, "fingerprint_base": piecewise.BASE_ORACLE, "quality_base": fertility.BASE_ORACLE, "secret_base": secrets.BASE_ORACLE}
