"""From raw documents to a mixed training order: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the folder
the executors share and gives the next stage the table read back. All but the last keep the columns of ``documents``.

Rows with a null id are judged by their text alone and never taken for anything's copy. Rows repeated under one id stay
or go together. An empty table gives none at every stage. Texts of any length are read whole; other columns, whatever
their names, go along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscle.llm import quality
from corpuscle.llm.decontaminate import keep_clean
from corpuscle.llm.mixing import curriculum_mix
from corpuscle.llm.near import keep_one_of_each
from corpuscle.llm.repeats import keep_first_strings
from corpuscle.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose lines the conditional random field finds bad: a score under 0.3. Null and empty texts are scored as bad lines alone are, so they go where the model tells good from bad."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by 5-word shingle sets of similarity 0.8 or more. Null and empty texts, and rows with a null id, are nobody's copies and stay."""
    return keep_one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes covered by 100-byte strings of an earlier place; ``n_chars`` follows the text. No document goes; a null text stays null, one under 100 bytes as it is."""
    out = keep_first_strings(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one. Null and empty texts stay."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighs the sources, with one row for each document: words taken and positions in training; a null text has size 0, a null source is one of its own."""
    return curriculum_mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: Stages 1 to 3 have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name.replace(" ", "-"))
    return docs
