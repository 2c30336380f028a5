"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Text that a classifier is fitted on.
MAX_BYTES = 64 << 20


def held_out(mod: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``held``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % mod == held


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, mod: int = 5, held: int = 0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``text, label`` of at most ``bound`` labelled documents whose crc32(doc_id as text) mod ``mod`` is not ``held``.

    The labels with the smallest xxhash64 of their id are taken, so reruns agree; of these, in the same order, all
    documents with which the texts stay within ``max_bytes``. Being at most ``bound`` rows of two numbers, they are
    broadcast to the documents, which are scanned once for sizes and once for texts. Null ids and labels are left out."""
    spark = docs.sparkSession
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    picked = picked.where(~held_out(mod, held)).select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label").limit(bound).collect()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, label int"
    ids = spark.createDataFrame([(i,) for i in sorted({r["doc_id"] for r in picked})], "doc_id long")
    size = dict(texts.select("doc_id", F.octet_length("text").cast("long").alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.sum("n")).collect())
    total, fit = 0, []
    for r in picked:
        n = size.get(r["doc_id"])
        if n is not None and total + n <= max_bytes:
            total += n
            fit.append((r["doc_id"], r["label"]))
    return texts.join(F.broadcast(spark.createDataFrame(fit, schema)), "doc_id").select("doc_id", "text", "label")
