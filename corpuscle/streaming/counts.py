"""Word counts of arriving documents, kept up to date. Counts add up, so the merge is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import word_array


def stream_word_counts(documents: DataFrame, out: str, checkpoint: str, doc: str = "doc_id", min_paragraph_len: int = 5) -> StreamingQuery:
    """Write ``batch, word, count, doc_count`` of each micro-batch of ``documents(doc, text)``; a batch run again replaces its own rows."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(doc).alias("doc"), F.explode(F.split("text", "\n")).alias("text")).select("doc", word_array(F.col("text")).alias("w"))
        rows = rows.where(F.size("w") >= min_paragraph_len).select("doc", F.explode("w").alias("word")).withColumn("word", F.lower("word"))
        counts = rows.groupBy("doc", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("count"), F.count("*").alias("doc_count"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(batches: DataFrame) -> DataFrame:
    """Totals over all micro-batches; a document comes in one batch, so document counts add up."""
    return batches.groupBy("word").agg(F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count"))
