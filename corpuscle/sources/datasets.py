"""Readers of gold sets and of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

R8_LABELS = ("acq", "crude", "earn", "grain", "interest", "money-fx", "ship", "trade")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a small gold file; line ends of either kind are cut."""
    rows = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return rows.select((F.row_number().over(Window.orderBy("_at")) - 1).alias("line_no"), F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("value"))


def similarity_pairs(lines: DataFrame) -> DataFrame:
    """``w1, w2, gold`` of lines of two words and a number."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.get(p, 0).alias("w1"), F.get(p, 1).alias("w2"), F.get(p, 2).cast("double").alias("gold"))


def analogy_questions(lines: DataFrame, lowercase: bool = True) -> DataFrame:
    """``qid, a, b, c, d``; lines that begin with a colon name sections."""
    p = F.split(F.trim(F.lower("value") if lowercase else F.col("value")), r"\s+")
    rows = lines.where(~F.startswith("value", F.lit(":")) & (F.trim("value") != ""))
    return rows.select(F.col("line_no").cast("long").alias("qid"), *[F.get(p, i).alias(c) for i, c in enumerate("abcd")])


def relatedness_lists(lines: DataFrame) -> DataFrame:
    """``seed, rank, title``: a seed line, then its titles, indented by a TAB, from the most related on (rank 0)."""
    is_seed = ~F.startswith("value", F.lit("\t"))
    w = Window.orderBy("line_no")  # a small file
    rows = lines.where(F.trim("value") != "").withColumn("_s", F.sum(is_seed.cast("int")).over(w)).withColumn("_seed", is_seed)
    seeds = rows.where("_seed").select("_s", F.trim("value").alias("seed"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("line_no")) - 1
    return rows.where("not _seed").withColumn("rank", rank).select("_s", "rank", F.trim(F.replace("value", F.lit("\t"), F.lit(""))).alias("title")).join(seeds, "_s").select("seed", "rank", "title")


def relatedness_pairs(lines: DataFrame) -> DataFrame:
    """``title1, title2, gold`` of the seven-column table with a header; underscores are spaces."""
    p = F.split("value", "\t")
    space = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    return lines.where((F.col("line_no") > 0) & (F.trim("value") != "")).select(space(F.get(p, 1)).alias("title1"), space(F.get(p, 3)).alias("title2"), F.get(p, 6).cast("double").alias("gold"))


def reuters_r8(spark: SparkSession, path: str, dev_size: float = 0.05, seed: int = 0) -> DataFrame:
    """``text, label, fold`` of the single-topic stories with one of eight topics in a folder of SGML files."""
    whole = spark.read.text(path, wholetext=True)
    story = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<REUTERS .*?</REUTERS>)"), F.lit(1))).alias("s")
    rows = whole.select(story)
    topics = F.regexp_extract_all(F.regexp_extract("s", r"(?s)<TOPICS>(.*?)</TOPICS>", 1), F.lit(r"<D>(.*?)</D>"), F.lit(1))
    rows = rows.select("s", topics.alias("t"), F.regexp_extract("s", r'LEWISSPLIT="([A-Z-]*)"', 1).alias("split"), F.regexp_extract("s", r'TOPICS="([A-Z]*)"', 1).alias("has"))
    rows = rows.where((F.size("t") == 1) & F.col("split").isin("TRAIN", "TEST") & (F.col("has") == "YES")).withColumn("name", F.get("t", 0)).where(F.col("name").isin(*R8_LABELS))
    body = F.regexp_extract("s", r"(?s)<BODY>(.*?)</BODY>", 1)
    title = F.regexp_extract("s", r"(?s)<TITLE>(.*?)</TITLE>", 1)
    label = F.array_position(F.array(*map(F.lit, R8_LABELS)), F.col("name")) - 1
    dev = F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(10_000)) < int(dev_size * 10_000)
    return rows.select(F.concat_ws("\n", title, body).alias("text"), label.cast("int").alias("label"), F.when(F.col("split") == "TEST", "test").when(dev, "dev").otherwise("train").alias("fold"))
