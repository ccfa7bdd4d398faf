"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, lm_score, minhash, packing, quality, substrings, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_read(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judged(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where("quality = 1"))
    # Sums come in any order; six digits are the same in each.
    return rows.select("doc_id", "n_tokens", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("loss_target", "loss_background", "score")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_url_filter, op3_language, op4_substrings, op5_decontaminate, op6_toxicity, op7_exact_dedup, op8_lm_score, op9_quality, op10_packing)
}
ORACLES: dict[str, str] = {"op4_substrings": substrings.SQL, "op5_decontaminate": decontaminate.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_lm_score": lm_score.SQL}
