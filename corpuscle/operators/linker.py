"""Entity linking by names from links, titles and redirects, keeping every candidate of a matched name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_text
from ..functions.titles import strip_disambiguator
from ..params import LinkerParams
from .dictionary import resolve_redirects
from .mentions import longest_matches, mention_statistics, name_document_counts, name_spans, with_probabilities


def entity_names(links: DataFrame, titles: DataFrame, redirects: DataFrame, max_len: int, normalize: Column | None = None) -> DataFrame:
    """``name, title, own``: a row for each link (to its resolved target), page title and redirect; ``own`` is 1 for the last two.

    Titles and sources lose a trailing '(…)' and are normalised; link texts are taken as they are."""
    clean = lambda c: normalize_text(strip_disambiguator(F.col(c)))
    linked = resolve_redirects(links.where((F.length("text") <= max_len) & (F.col("text") != "")).select(F.col("text").alias("name"), "target"), redirects, "target")
    out = linked.select("name", F.col("resolved").alias("title"), F.lit(0).alias("own"))
    out = out.unionByName(titles.select(clean("title").alias("name"), "title", F.lit(1).alias("own")))
    return out.unionByName(redirects.select(clean("src").alias("name"), F.col("dst").alias("title"), F.lit(1).alias("own")))


@dataclass
class EntityLinker:
    mentions: DataFrame
    params: LinkerParams

    @staticmethod
    def build(paragraphs: DataFrame, links: DataFrame, titles: DataFrame, redirects: DataFrame, params: LinkerParams = LinkerParams(), doc: str = "title", keys: list[str] | None = None) -> EntityLinker:
        names = entity_names(links, titles, redirects, params.max_mention_len)
        # a title or redirect is itself one more occurrence of its name
        own = names.where("own = 1").groupBy("name").agg(F.count("*").alias("doc_count"))
        seen = name_document_counts(paragraphs, names, doc, keys or [doc, "para_no"], params.max_mention_len, case_sensitive=True)
        counts = own.unionByName(seen).groupBy("name").agg(F.sum("doc_count").alias("doc_count"))
        table = mention_statistics(names.select("name", F.col("title").alias("entity")), counts, "entity", params.min_link_prob, params.min_prior_prob, params.min_link_count)
        return EntityLinker(table.withColumnRenamed("entity", "title"), params)

    def detect(self, docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """``keys, start, end, name, title, …counts, prior_prob``: all candidates of the longest matching names."""
        src = docs.select(*keys, F.col(text).alias("text"))
        spans = name_spans(src, keys, self.mentions, self.params.max_mention_len, case_sensitive=True)
        taken = longest_matches(spans, self.mentions, keys).join(src.withColumnRenamed("text", "_t"), keys)
        taken = taken.withColumn("name", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("_t")
        return with_probabilities(taken.join(self.mentions.select("name", "title", "link_count", "total_link_count", "doc_count"), "name"))

    def save(self, path: str) -> None:
        self.mentions.write.mode("overwrite").parquet(f"{path}/mentions")
        self.mentions.sparkSession.createDataFrame([tuple(vars(self.params).values())], list(vars(self.params))).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> EntityLinker:
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        return EntityLinker(spark.read.parquet(f"{path}/mentions"), LinkerParams(**meta))
