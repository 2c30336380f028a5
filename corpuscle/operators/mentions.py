"""Names of entities with link statistics, and greedy longest-match detection.

Every place where a name could stand is a span from a token's start to a token's end, of bounded length; so a name
lookup is an equality join of spans with names, and no trie is needed. Spans that a filter of the names' hashes keeps out
are dropped where they are made.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import kernels as K
from ..functions.text import Tokenizer
from ..params import MentionParams, as_dict
from .dictionary import Dictionary, count_lists


def _fold(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def token_spans(df: DataFrame, keys: list[str], max_len: int, case_sensitive: bool = False, text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """``keys, start, end, name``: all spans over whole tokens of at most ``max_len`` characters.

    Tokens have a character at least, so the next ``max_len`` ones hold every end."""
    tok = (tokenizer or Tokenizer()).tokens(df, keys, text)
    frame = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, max_len - 1)
    ends = F.filter(F.collect_list("end").over(frame), lambda e: e - F.col("start") <= max_len)
    spans = tok.withColumn("ends", ends).select(*keys, "start", F.explode("ends").alias("end"))
    return spans.join(df.select(*keys, _fold(F.col(text), case_sensitive).alias("_t")), keys).select(*keys, "start", "end", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("name"))


def name_filter(names: DataFrame) -> Broadcast:
    """Bits at the hashes of all names, 4 MB for any number of them. It lets every name through and few other spans, so what passes is still to be joined with the names."""
    bits = np.zeros(1 << K.BITS - 3, np.uint8)
    for row in names.select("name").where("name is not null").mapInArrow(K.name_places, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return names.sparkSession.sparkContext.broadcast(bits.tobytes())


def name_spans(df: DataFrame, keys: list[str], names: DataFrame, max_len: int, case_sensitive: bool = False, text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """``keys, start, end, name``: of the spans of ``token_spans`` all that are in ``names``, and few others. Rows with a null key have none."""
    scanner = (tokenizer or Tokenizer()).scanner()
    if scanner is None:
        return token_spans(df, keys, max_len, case_sensitive, text, tokenizer)
    rows = df.dropna(subset=keys).select(*keys, F.col(text).alias("text"), _fold(F.col(text), case_sensitive).alias("fold"))
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("name", T.StringType())))])
    return rows.mapInArrow(K.likely_spans(scanner, name_filter(names), max_len, keys), schema)


def link_names(links: DataFrame, dictionary: Dictionary, max_len: int, case_sensitive: bool = False, text: str = "text", target: str = "target") -> DataFrame:
    """``name, entity_idx`` of links to known entities whose text has at most ``max_len`` characters before folding; empty texts are left out."""
    rows = links.where((F.length(text) <= max_len) & (F.col(text) != "")).select(_fold(F.col(text), case_sensitive).alias("name"), F.col(target).alias("_target"))
    return dictionary.entity_index(rows, "_target").where("entity_idx >= 0").select("name", "entity_idx")


def name_document_counts(paragraphs: DataFrame, names: DataFrame, doc: str, keys: list[str], max_len: int, case_sensitive: bool = False, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``name, doc_count``: documents in which the name stands on token boundaries."""
    known = names.select("name").distinct()
    scanner = (tokenizer or Tokenizer()).scanner()
    if scanner is not None:
        rows = paragraphs.dropna(subset=[doc, *keys]).select(F.col(doc).alias("doc"), "text", _fold(F.col("text"), case_sensitive).alias("fold"))
        schema = T.StructType([rows.schema["doc"], T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType()))])
        lists = rows.mapInArrow(K.document_names(scanner, name_filter(known), max_len), schema)
        return count_lists(lists, "name").join(known, "name", "left_semi").select("name", "doc_count")
    spans = token_spans(paragraphs, keys, max_len, case_sensitive, "text", tokenizer)
    return spans.join(names.select("name").distinct(), "name", "left_semi").select(doc, "name").distinct().groupBy("name").agg(F.count("*").alias("doc_count"))


def mention_statistics(name_pairs: DataFrame, doc_counts: DataFrame, entity: str, min_link_prob: float, min_prior_prob: float, min_link_count: int = 1) -> DataFrame:
    """Pairs of name and entity with counts, after the thresholds. The total is not recounted after the prior filter."""
    pair = name_pairs.groupBy("name", entity).agg(F.count("*").alias("link_count"))
    total = F.sum("link_count").over(Window.partitionBy("name"))
    out = pair.withColumn("total_link_count", total).join(doc_counts, "name").where("doc_count > 0")
    out = out.where((F.col("total_link_count") / F.col("doc_count") >= min_link_prob) & (F.col("link_count") / F.col("total_link_count") >= min_prior_prob))
    return out.where(F.col("link_count") >= min_link_count).select("name", entity, "link_count", "total_link_count", "doc_count")


def with_probabilities(mentions: DataFrame) -> DataFrame:
    """Add ``link_prob``, ``prior_prob`` and its alias ``commonness``, each at most 1, 0 for a count of 0."""
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col(a) / F.col(b)))
    out = mentions.withColumn("link_prob", ratio("total_link_count", "doc_count")).withColumn("prior_prob", ratio("link_count", "total_link_count"))
    return out.withColumn("commonness", F.col("prior_prob"))


def longest_matches(spans: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Left to right, at each token the longest known name on token boundaries; taken spans don't overlap."""
    hits = spans.join(names.select("name").distinct(), "name", "left_semi").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    listed = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    scan = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("cur"), empty.alias("out")),
        lambda acc, x: F.when(x["start"] >= acc["cur"], F.struct(x["end"].alias("cur"), F.array_append(acc["out"], F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return listed.select(*keys, F.explode(scan).alias("m")).select(*keys, "m.start", "m.end")


def page_entities(links: DataFrame, dictionary: Dictionary, page: str = "title", target: str = "target", own: str | None = None) -> DataFrame:
    """``page, entity_idx``: each page's linked entities and its own (of the title ``own``, by default the page key)."""
    own_col = F.col(own or page)
    titles = links.select(F.col(page).alias("page"), F.explode(F.array(F.col(target), own_col)).alias("_t")).distinct()
    return dictionary.entity_index(titles, "_t").where("entity_idx >= 0").select("page", "entity_idx").distinct()


@dataclass
class MentionDB:
    mentions: DataFrame
    dictionary: Dictionary
    meta: dict = field(default_factory=dict)

    @staticmethod
    def build(paragraphs: DataFrame, links: DataFrame, dictionary: Dictionary, params: MentionParams = MentionParams(), doc: str = "title", keys: list[str] | None = None, tokenizer: Tokenizer | None = None) -> MentionDB:
        keys = keys or [doc, "para_no"]
        pairs = link_names(links, dictionary, params.max_mention_len, params.case_sensitive)
        counts = name_document_counts(paragraphs, pairs, doc, keys, params.max_mention_len, params.case_sensitive, tokenizer)
        table = mention_statistics(pairs, counts, "entity_idx", params.min_link_prob, params.min_prior_prob)
        return MentionDB(table, dictionary, {"uuid": uuid.uuid4().hex, "dictionary": dictionary.uuid, "build_params": as_dict(params)})

    @property
    def params(self) -> MentionParams:
        return MentionParams(**self.meta["build_params"])

    def query(self, text: str) -> DataFrame:
        """The name's entities; KeyError where it isn't a name."""
        name = text if self.params.case_sensitive else text.lower()
        out = self.mentions.where(F.col("name") == name)
        if out.isEmpty():
            raise KeyError(text)
        return out

    def prefix_search(self, df: DataFrame, text: str = "text", start: int = 0) -> DataFrame:
        """Adds ``name`` and ``len``: every name that begins at ``start``, on token boundaries or not; longest first within a row."""
        p = self.params
        cutout = F.substring(_fold(F.col(text), p.case_sensitive), start + 1, p.max_mention_len)
        sizes = F.filter(F.sequence(F.lit(1), F.lit(p.max_mention_len)), lambda k: k <= F.length("_c"))
        keys = df.withColumn("_c", cutout).withColumn("len", F.explode(sizes)).withColumn("name", F.substring(F.col("_c"), F.lit(1), F.col("len")))
        return keys.join(self.mentions.select("name").distinct(), "name", "left_semi").drop("_c")

    def detect(self, paragraphs: DataFrame, keys: list[str], entities: DataFrame | None = None, page: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
        """``keys, start, end, text, name, entity_idx, …counts``: unambiguous mentions.

        The longest name takes its span even if it is ambiguous. It is a mention if it has one entity, else if just one
        of its entities is among ``entities(page, entity_idx)`` of the row's ``page``; otherwise it yields nothing."""
        p = self.params
        spans = name_spans(paragraphs, keys, self.mentions, p.max_mention_len, p.case_sensitive, "text", tokenizer)
        taken = longest_matches(spans, self.mentions, keys)
        taken = taken.join(paragraphs.select(*keys, F.col("text").alias("_t"), *([page] if page and page not in keys else [])), keys)
        taken = taken.withColumn("text", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("name", _fold_span(p.case_sensitive)).drop("_t")
        cand = taken.join(self.mentions, "name")
        here = F.lit(False)
        if entities is not None:
            e = entities.select(F.col("page").alias("_p"), F.col("entity_idx").alias("_e")).distinct().withColumn("_here", F.lit(True))
            cand = cand.join(e, (F.col(page or keys[0]) == F.col("_p")) & (F.col("entity_idx") == F.col("_e")), "left")
            here = F.coalesce("_here", F.lit(False))
        w = Window.partitionBy(*keys, "start")
        cand = cand.withColumn("_n", F.count("*").over(w)).withColumn("_h", here).withColumn("_k", F.sum(F.col("_h").cast("int")).over(w))
        out = cand.where((F.col("_n") == 1) | ((F.col("_k") == 1) & F.col("_h")))
        return out.select(*keys, "start", "end", "text", "name", "entity_idx", "link_count", "total_link_count", "doc_count")


def _fold_span(case_sensitive: bool) -> Column:
    """The name of a span: a slice of the folded text, as names are."""
    return F.substring(_fold(F.col("_t"), case_sensitive), F.col("start") + 1, F.col("end") - F.col("start"))
