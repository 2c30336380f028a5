"""The undirected link graph between entities."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .dictionary import Dictionary


def page_edges(links: DataFrame, dictionary: Dictionary, page: str = "title", target: str = "target") -> DataFrame:
    """``src, dst`` for every link whose page and target both resolve to entities."""
    e = dictionary.entity_index(links.select(F.col(page).alias("_page"), F.col(target).alias("_target")), "_page", "src")
    return dictionary.entity_index(e.where("src >= 0"), "_target", "dst").where("dst >= 0").select("src", "dst")


def symmetric_distinct(edges: DataFrame) -> DataFrame:
    """Both directions, each once; loops stay."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.src", "e.dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


@dataclass
class LinkGraph:
    edges: DataFrame
    dictionary: Dictionary
    meta: dict = field(default_factory=dict)

    @staticmethod
    def build(links: DataFrame, dictionary: Dictionary, page: str = "title", target: str = "target") -> LinkGraph:
        return LinkGraph(symmetric_distinct(page_edges(links, dictionary, page, target)), dictionary, {"uuid": uuid.uuid4().hex, "dictionary": dictionary.uuid})

    def neighbor_lists(self) -> DataFrame:
        """``src, neighbors``: sorted indices."""
        return self.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))

    def neighbor_indices(self, idx: int) -> list[int]:
        """Indices of one item's neighbours; none for an item without links."""
        return [r["dst"] for r in self.edges.where(F.col("src") == idx).orderBy("dst").select("dst").collect()]

    def neighbors(self, idx: int) -> DataFrame:
        e = self.edges.where(F.col("src") == idx).select(F.col("dst").alias("idx"))
        return self.dictionary.entities.join(e, "idx", "left_semi")
