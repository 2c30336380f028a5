"""Saving and loading dictionaries, link graphs, mention tables and models as Parquet folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dictionary import Dictionary
from ..operators.graph import LinkGraph
from ..operators.mentions import MentionDB
from ..operators.vectors import Embedding


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    _write(spark.createDataFrame([(json.dumps(meta),)], "json string"), f"{path}/meta")


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/meta").first()["json"])


def save_dictionary(d: Dictionary, path: str) -> None:
    for name in ("words", "entities", "redirect_idx"):
        _write(getattr(d, name), f"{path}/{name}")
    _write_meta(d.words.sparkSession, d.meta, path)


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(*(spark.read.parquet(f"{path}/{n}") for n in ("words", "entities", "redirect_idx")), _meta(spark, path))


def _checked(meta: dict, dictionary: Dictionary) -> dict:
    if meta["dictionary"] != dictionary.uuid:
        raise RuntimeError("it was built with another dictionary")
    return meta


def save_graph(g: LinkGraph, path: str) -> None:
    _write(g.edges, f"{path}/edges")
    _write_meta(g.edges.sparkSession, g.meta, path)


def load_graph(spark: SparkSession, path: str, dictionary: Dictionary) -> LinkGraph:
    return LinkGraph(spark.read.parquet(f"{path}/edges"), dictionary, _checked(_meta(spark, path), dictionary))


def save_mentions(m: MentionDB, path: str) -> None:
    _write(m.mentions, f"{path}/mentions")
    _write_meta(m.mentions.sparkSession, m.meta, path)


def load_mentions(spark: SparkSession, path: str, dictionary: Dictionary) -> MentionDB:
    return MentionDB(spark.read.parquet(f"{path}/mentions"), dictionary, _checked(_meta(spark, path), dictionary))


def save_model(m: Embedding, path: str) -> None:
    _write(m.items, f"{path}/items")
    _write_meta(m.items.sparkSession, m.train_params, path)


def load_model(spark: SparkSession, path: str) -> Embedding:
    return Embedding(spark.read.parquet(f"{path}/items"), _meta(spark, path))


def text_lines(items: DataFrame, out_format: str = "default", column: str = "syn0") -> DataFrame:
    """``pos, line`` of the text form: most frequent items by document first, words before entities; entities get the prefix ENTITY/.

    Formats: 'default' (name TAB values), 'word2vec' (a header, '_' for a space), 'glove' (no header). Values have three
    decimals. Single numbers are formatted as FLOAT, as rounding of DOUBLE differs at ties."""
    if out_format not in ("default", "word2vec", "glove"):
        raise NotImplementedError(out_format)
    name = F.replace(F.when(F.col("kind") == "entity", F.concat(F.lit("ENTITY/"), F.col("name"))).otherwise(F.col("name")), F.lit("\t"), F.lit(" "))
    values = F.concat_ws(" ", F.transform(F.col(column).cast("array<float>"), lambda x: F.format_string("%.3f", x)))
    sep = "\t" if out_format == "default" else " "
    if out_format != "default":
        name = F.replace(name, F.lit(" "), F.lit("_"))
    lines = items.select((-F.col("doc_count")).cast("long").alias("k1"), F.col("idx").cast("long").alias("k2"), F.concat(name, F.lit(sep), values).alias("line"))
    if out_format == "word2vec":
        head = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("d"))
        lines = lines.unionByName(head.select(F.lit(-(2**62)).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.concat_ws(" ", "n", "d").alias("line")))
    return lines


def save_text(items: DataFrame, path: str, out_format: str = "default") -> None:
    """Write one sorted text file; the sort is distributed, the single file is what the format asks for."""
    text_lines(items, out_format).orderBy("k1", "k2").select("line").coalesce(1).write.mode("overwrite").text(path)


def parse_text(lines: DataFrame) -> DataFrame:
    """``kind, name, syn0, count, doc_count`` of ``lines(pos, line)``: the last of several lines of one name counts; statistics are zero.

    The second line tells the separator (TAB, else space); a first line of two numbers is a header."""
    second = lines.orderBy("pos").limit(2).agg(F.max_by("line", "pos").alias("l")).select(F.coalesce(F.contains("l", F.lit("\t")), F.lit(False)).alias("tab"))
    first = lines.agg(F.min("pos").alias("p0"))
    rows = lines.join(F.broadcast(second.join(first, F.lit(True))), F.lit(True))  # one row
    rows = rows.where(~((F.col("pos") == F.col("p0")) & F.col("line").rlike(r"^\d+\s\d+$")))
    name = F.expr("substring_index(line, case when tab then '\\t' else ' ' end, 1)")
    values = F.transform(F.split(F.trim(F.expr("substring(line, length(substring_index(line, case when tab then '\t' else ' ' end, 1)) + 2)")), r"\s+"), lambda x: x.cast("double"))
    rows = rows.select("pos", name.alias("raw"), values.alias("v")).groupBy("raw").agg(F.max_by("v", "pos").alias("syn0"))
    entity = F.startswith("raw", F.lit("ENTITY/"))
    shown = F.when(entity, F.replace(F.substring(F.col("raw"), 8, 2**31 - 1), F.lit("_"), F.lit(" "))).otherwise(F.col("raw"))
    zero = F.lit(0).cast("long")
    return rows.select(F.when(entity, F.lit("entity")).otherwise(F.lit("word")).alias("kind"), shown.alias("name"), "syn0", zero.alias("count"), zero.alias("doc_count"))


def load_text(spark: SparkSession, path: str) -> Embedding:
    """Read a text form back. Lines keep their order by file position, which needs the file as it was written: one file."""
    from ..operators.dictionary import dense_index

    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).select("pos", F.col("value").alias("line"))
    items = parse_text(lines).withColumn("_k", F.concat(F.when(F.col("kind") == "word", F.lit("0")).otherwise(F.lit("1")), F.col("name")))
    return Embedding(dense_index(items, "_k").select("idx", "kind", "name", "count", "doc_count", "syn0"), {})
