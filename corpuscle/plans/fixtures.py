"""Paragraphs, links, redirects and items derived from plain document, page and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.titles import normalize_title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Raw rows dealt out to all cores where files have fewer splits than there are cores; larger tables stay as they are.

    Whatever multiplies rows (lines, tokens, spans) should come after this, so that it runs on every core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, para_no, text``: the lines of each document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_no", "text"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, lang, title, pos, text, target``: anchors of each page, whose title is the first word of its heading."""
    anchors = F.lit(r'<a href="/([^"]*)">([^<]*)</a>')
    pair = F.arrays_zip(F.regexp_extract_all("html", anchors, F.lit(1)).alias("x"), F.regexp_extract_all("html", anchors, F.lit(2)).alias("t"))
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        "page_id",
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
        normalize_title(F.regexp_extract("html", r"<h1>([^<\s]*)", 1)).alias("title"),
        F.posexplode(pair).alias("pos", "p"),
    )
    return p.select("page_id", "lang", "title", "pos", F.col("p.t").alias("text"), normalize_title(F.col("p.x")).alias("target"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: titles that end in a full stop or comma lead to those without."""
    t = page_links(spark, sf_dir).select(F.explode(F.array("title", "target")).alias("src")).distinct()
    return t.where(F.col("src").rlike(r"[.,]$") & (F.length("src") > 1)).select("src", F.expr("substring(src, 1, length(src) - 1)").alias("dst"))


def disambiguations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages whose number is a multiple of seven."""
    return page_links(spark, sf_dir).where("page_id % 7 = 0").select("title").distinct()


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, kind, name, count, doc_count, syn0``: even vectors are words."""
    word = F.col("vec_id") % 2 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.when(word, "word").otherwise("entity").alias("kind"),
        F.concat(F.when(word, "w ").otherwise("e "), F.col("vec_id")).alias("name"),
        (F.col("label") * 10 + 1).cast("long").alias("count"),
        (F.col("label") + 1).cast("long").alias("doc_count"),
        F.col("embedding").alias("syn0"),
    )


def wiki_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, wiki_text``: small pieces of wikitext made of part names."""
    t: Column = F.concat(
        F.lit("'''"), F.col("p_brand"), F.lit("''' is a [["), F.col("p_type"), F.lit("|"), F.col("p_name"), F.lit("]]"),
        F.when(F.col("p_partkey") % 5 == 0, " {{Disambig|x}}").otherwise(" {{Infobox|x}}"),
        F.when(F.col("p_partkey") % 3 == 0, "[[Category:Parts]]").when(F.col("p_partkey") % 3 == 1, "[[File:a.png]]").otherwise(""),
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", t.alias("wiki_text"))
