"""The operators of this subpackage as queries over the driver's tables, with the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, oracles, quality, toxicity
from .ann import nearest
from .decontaminate import contamination
from .html import extract_pages
from .langid import identify_held_out
from .lm import score_texts
from .mixing import curriculum_mix
from .near import near_duplicates
from .repeats import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op3_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(_table(spark, sf_dir, "documents"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix(_table(spark, sf_dir, "documents"))


def op5_bucket_pointer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_main_text": op1_crf_main_text,
    "op2_maxent_lm": op2_maxent_lm,
    "op3_naive_bayes_language": op3_naive_bayes_language,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_bucket_pointer_repeats": op5_bucket_pointer_repeats,
    "op6_positional_decontamination": op6_positional_decontamination,
    "op7_noisy_or_toxicity": op7_noisy_or_toxicity,
    "op8_crf_quality": op8_crf_quality,
    "op9_balanced_posting_lists": op9_balanced_posting_lists,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op4_curriculum_mix": mixing.ORACLE,
    "op5_bucket_pointer_repeats": oracles.REPEATS,
    "op6_positional_decontamination": oracles.CONTAMINATION,
    "op10_minhash_near_dedup": oracles.NEAR,
}
