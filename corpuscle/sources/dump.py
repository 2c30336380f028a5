"""Reading page dumps and keeping them as tables of pages, paragraphs and redirects."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.titles import is_disambiguation, is_redirect, normalize_title
from ..functions.wikitext import parse_page
from ..schemas import DUMP_PAGE

_PARSED = "title string, ok boolean, paragraphs array<struct<text:string,wiki_links:array<struct<title:string,text:string,start:int,end:int>>,abstract:boolean>>"


def dump_language(spark: SparkSession, path: str) -> str:
    """The xml:lang of the dump's first line."""
    row = spark.read.text(path).limit(1).select(F.regexp_extract("value", r'xml:lang="([^"]*)"', 1).alias("l")).first()
    return row["l"] if row else ""


def read_dump(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """``title, lang, wiki_text, redirect`` of the pages in the main namespace of a (bz2) XML dump. Redirect targets are normalised, titles are not."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(DUMP_PAGE).load(path)
    lang = dump_language(spark, path) if language is None else language
    target = F.when(F.col("redirect._title") != "", normalize_title(F.col("redirect._title")))
    return pages.where("ns = '0'").select("title", F.lit(lang).alias("lang"), F.coalesce("revision.text._VALUE", F.lit("")).alias("wiki_text"), target.alias("redirect"))


def parse_pages(raw: DataFrame, preprocess: Callable[[str], str] | None = None) -> DataFrame:
    """``title, ok, paragraphs`` of pages that aren't redirects. A page that can't be parsed is kept with ``ok`` false, so it fails no task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for title, lang, text in zip(pdf["title"], pdf["lang"], pdf["wiki_text"], strict=True):
                try:
                    got = [{"text": p.text, "wiki_links": [k._asdict() for k in p.links], "abstract": p.abstract} for p in parse_page(text or "", lang or "en", preprocess)]
                    rows.append((title, True, got))
                except Exception:  # noqa: BLE001 - one bad page must not stop a dump
                    rows.append((title, False, []))
            yield pd.DataFrame(rows, columns=["title", "ok", "paragraphs"])

    return raw.where(~is_redirect(F.col("redirect"))).select("title", "lang", "wiki_text").mapInPandas(run, _PARSED)


@dataclass
class PageStore:
    """Pages, paragraphs, redirects and rejected titles of one dump, as tables."""

    pages: DataFrame
    paragraphs: DataFrame
    redirects: DataFrame
    rejects: DataFrame
    meta: dict = field(default_factory=dict)

    @staticmethod
    def build(raw: DataFrame, path: str, dump_file: str = "", language: str | None = None, preprocess: Callable[[str], str] | None = None) -> PageStore:
        """Parse raw pages once, write the tables under ``path`` and open them."""
        spark = raw.sparkSession
        if language is None:
            first = raw.select("lang").first()
            language = first["lang"] if first else ""
        raw.where(is_redirect(F.col("redirect"))).select(F.col("title").alias("src"), F.col("redirect").alias("dst")).write.mode("overwrite").parquet(f"{path}/redirects")
        parse_pages(raw, preprocess).write.mode("overwrite").parquet(f"{path}/parsed")
        flags = raw.where(~is_redirect(F.col("redirect"))).select("title", is_disambiguation(F.col("wiki_text")).alias("is_disambiguation"))
        flags.write.mode("overwrite").parquet(f"{path}/flags")
        spark.createDataFrame([(uuid.uuid4().hex, dump_file, language)], "uuid string, dump_file string, language string").write.mode("overwrite").parquet(f"{path}/meta")
        return PageStore.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> PageStore:
        parsed = spark.read.parquet(f"{path}/parsed")
        good = parsed.where("ok")
        paragraphs = good.select("title", F.posexplode("paragraphs").alias("para_no", "p")).select("title", "para_no", "p.text", "p.wiki_links", "p.abstract")
        pages = good.select("title").join(spark.read.parquet(f"{path}/flags"), "title")
        return PageStore(pages, paragraphs, spark.read.parquet(f"{path}/redirects"), parsed.where("not ok").select("title"), spark.read.parquet(f"{path}/meta").first().asDict())

    @property
    def uuid(self) -> str:
        return self.meta["uuid"]

    @property
    def dump_file(self) -> str:
        return self.meta["dump_file"]

    @property
    def language(self) -> str:
        return self.meta["language"]

    def page_size(self) -> int:
        return self.pages.count()

    def titles(self) -> DataFrame:
        """In the binary order of their UTF-8 bytes."""
        return self.pages.select("title").orderBy("title")

    def links(self) -> DataFrame:
        """``title, para_no, target, text, start, end``: one row a link."""
        k = F.explode("wiki_links").alias("k")
        return self.paragraphs.select("title", "para_no", k).select("title", "para_no", F.col("k.title").alias("target"), F.col("k.text").alias("text"), F.col("k.start").alias("start"), F.col("k.end").alias("end"))

    def disambiguations(self) -> DataFrame:
        return self.pages.where("is_disambiguation").select("title")

    def get_paragraphs(self, title: str) -> list:
        if self.pages.where(F.col("title") == title).isEmpty():
            raise KeyError(title)
        return self.paragraphs.where(F.col("title") == title).orderBy("para_no").collect()

    def resolve_redirect(self, start: str, max_steps: int = 10) -> str:
        from ..operators.dictionary import resolve_redirects

        one = self.redirects.sparkSession.createDataFrame([(start,)], "title string")
        return resolve_redirects(one, self.redirects, "title", max_steps).first()["resolved"]

    def is_redirect(self, title: str) -> bool:
        return not self.redirects.where(F.col("src") == title).isEmpty()

    def is_disambiguation(self, title: str) -> bool:
        return not self.pages.where((F.col("title") == title) & F.col("is_disambiguation")).isEmpty()
