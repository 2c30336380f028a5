"""The dictionary: counts of words and entities, filters, indices and lookups."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import kernels as K
from ..functions.text import Tokenizer
from ..functions.titles import is_category_title
from ..params import DictionaryParams, as_dict
from ..plans.lineage import cut


def paragraph_words(paragraphs: DataFrame, doc: str = "title", text: str = "text", lowercase: bool = True, min_paragraph_len: int = 5, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``doc, word``, a row for every token of paragraphs with at least ``min_paragraph_len`` tokens. A map: no shuffle."""
    words = (tokenizer or Tokenizer()).words(F.col(text))
    rows = paragraphs.select(F.col(doc).alias("doc"), words.alias("w")).where(F.size("w") >= min_paragraph_len).select("doc", F.explode("w").alias("word"))
    return rows.withColumn("word", F.lower("word")) if lowercase else rows


def count_in_documents(rows: DataFrame, item: str, doc: str = "doc") -> DataFrame:
    """``item, count, doc_count``: occurrences, and documents with at least one. Two aggregates, both combined map-side."""
    per = rows.groupBy(doc, item).agg(F.count("*").alias("n"))
    return per.groupBy(item).agg(F.sum("n").alias("count"), F.count("*").alias("doc_count"))


def count_lists(lists: DataFrame, item: str) -> DataFrame:
    """``item, count, doc_count`` from ``doc, items, n``: what each document holds, in one row or several.

    A document's rows meet in a shuffle of its lists, not of a row for each of its words; what tasks find is summed."""
    whole = lists.groupBy("doc").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("n")).alias("n")).select("items", "n")
    return whole.mapInArrow(K.summed, "item string, count long, doc_count long").groupBy(F.col("item").alias(item)).agg(F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count"))


def word_counts(paragraphs: DataFrame, doc: str = "title", text: str = "text", lowercase: bool = True, min_paragraph_len: int = 5, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``word, count, doc_count`` over paragraphs with at least ``min_paragraph_len`` tokens."""
    scanner = (tokenizer or Tokenizer()).scanner()
    if scanner is None:
        return count_in_documents(paragraph_words(paragraphs, doc, text, lowercase, min_paragraph_len, tokenizer), "word")
    rows = paragraphs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType()))])
    return count_lists(rows.mapInArrow(K.document_words(scanner, lowercase, min_paragraph_len), schema), "word")


def entity_counts(links: DataFrame, doc: str = "doc", title: str = "title") -> DataFrame:
    """Counts of link targets; titles with a '#' are left out. Links of short paragraphs count too."""
    return count_in_documents(links.where(~F.contains(F.col(title), F.lit("#"))), title, doc)


def fold_targets(redirects: DataFrame) -> DataFrame:
    """Where the count of each redirect source ends: ``src, dst``; a null ``dst`` means it is lost.

    The sources are folded once each, in the binary order of their titles: a count moves to the target and on from there
    only while the target is itself a source that comes later. A source that targets itself loses its count."""
    red = cut(redirects.select("src", "dst").dropDuplicates(["src"]))  # every turn reads it
    nxt = red.select(F.col("src").alias("key"), F.col("dst").alias("d"))
    state = red.withColumn("key", F.col("src"))
    while True:
        # a source that targets itself loses what it holds, wherever that came from
        step = state.join(nxt, (state["dst"] == nxt["key"]) & (state["dst"] > state["key"]), "left")
        moved = cut(step.select("src", F.when(F.col("d").isNotNull(), F.col("d")).otherwise(F.col("dst")).alias("dst"), F.when(F.col("d").isNotNull(), nxt["key"]).otherwise(state["key"]).alias("key"), F.col("d").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            break
        state = moved.drop("moved")
    return state.select("src", F.when(F.col("dst") != F.col("key"), F.col("dst")).alias("dst"))


def fold_redirects(counts: DataFrame, redirects: DataFrame, title: str = "title", chains: bool = True) -> DataFrame:
    """Move the counts of redirect sources to their targets. Document counts add up; without ``chains`` every map is one hop."""
    to = fold_targets(redirects) if chains else redirects.dropDuplicates(["src"]).select("src", F.when(F.col("src") != F.col("dst"), F.col("dst")).alias("dst"))
    folded = counts.join(to.withColumn("is_src", F.lit(True)), F.col(title) == F.col("src"), "left")
    folded = folded.withColumn("to", F.when(F.col("is_src"), F.col("dst")).otherwise(F.col(title))).where("to is not null")
    return folded.groupBy(F.col("to").alias(title)).agg(F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count"))


def filter_entities(counts: DataFrame, disambiguations: DataFrame | None, language: str, params: DictionaryParams) -> DataFrame:
    """Entities frequent enough, without categories and disambiguation pages (``title``) unless asked for."""
    out = counts.where(F.col("count") >= params.min_entity_count)
    if not params.category:
        out = out.where(~is_category_title(F.col("title"), language))
    if not params.disambi and disambiguations is not None:
        out = out.join(disambiguations.select("title").distinct(), "title", "left_anti")
    return out


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with ``_part`` and their place in it, ``_at``. The partitioning is checkpointed, so whatever is computed from it is of the same one."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def _before(placed: DataFrame, total: Column) -> DataFrame:
    """``_p, _lead``: a total over the partitions before each; one row a partition, so it is broadcast."""
    lead = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(placed.groupBy("_part").agg(total.alias("_total")).select(F.col("_part").alias("_p"), lead.alias("_lead")))


def number_rows(df: DataFrame, order: list[str], start: int | Column = 0, name: str = "idx", kind: str = "long") -> DataFrame:
    """Number rows from ``start`` in the order of some columns, unique together, without one task seeing them all.

    Each partition of a range partitioning numbers its own rows and adds the sizes of those before it."""
    placed = _in_ranges(df, order)
    first = start if isinstance(start, Column) else F.lit(start)
    out = placed.join(_before(placed, F.count("*")), F.col("_part") == F.col("_p"))
    return out.withColumn(name, (F.col("_at") + F.col("_lead") + first).cast(kind)).drop("_at", "_part", "_p", "_lead")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row in the order of some columns, partition by partition of their ranges."""
    placed = _in_ranges(df, order)
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_at"))
    out = placed.withColumn("_own", own).join(_before(placed, F.sum(value)), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_own") + F.col("_lead")).drop("_at", "_part", "_p", "_lead", "_own")


def dense_index(df: DataFrame, order: str, start: int | Column = 0, name: str = "idx") -> DataFrame:
    """Number rows from ``start`` in the order of a unique column."""
    return number_rows(df, [order], start, name, "int")


@dataclass
class Dictionary:
    """Words with indices from 0, entities after them, and redirect sources of kept entities."""

    words: DataFrame
    entities: DataFrame
    redirect_idx: DataFrame
    meta: dict = field(default_factory=dict)

    @staticmethod
    def build(paragraphs: DataFrame, links: DataFrame, redirects: DataFrame, disambiguations: DataFrame | None = None, language: str = "en", params: DictionaryParams = DictionaryParams(), tokenizer: Tokenizer | None = None, paragraph_doc: str = "title", link_doc: str = "title") -> Dictionary:
        """``paragraphs(doc, text)``, ``links(doc, target)``, ``redirects(src, dst)``, ``disambiguations(title)``."""
        words = word_counts(paragraphs, paragraph_doc, "text", params.lowercase, params.min_paragraph_len, tokenizer).where(F.col("count") >= params.min_word_count).withColumnRenamed("word", "text")
        words = cut(dense_index(words, "text").select("idx", "text", "count", "doc_count"))
        n_words = words.count()
        redirects = cut(redirects.select("src", "dst").dropDuplicates(["src"]))
        raw = entity_counts(links.select(F.col(link_doc).alias("doc"), F.col("target").alias("title")))
        if params.min_entity_count <= 0:  # folding makes a target exist even where nothing links to it
            zero = redirects.select(F.col("dst").alias("title"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("doc_count"))
            raw = raw.unionByName(zero).groupBy("title").agg(F.sum("count").alias("count"), F.sum("doc_count").alias("doc_count"))
        ents = filter_entities(fold_redirects(raw, redirects), disambiguations, language, params)
        ents = cut(dense_index(ents, "title", n_words).select("idx", "title", "count", "doc_count"))
        red = redirects.join(ents, F.col("dst") == F.col("title")).select("src", F.col("idx").alias("entity_idx"))
        meta = {"uuid": uuid.uuid4().hex, "language": language, "lowercase": params.lowercase, "min_paragraph_len": params.min_paragraph_len, "build_params": as_dict(params), "word_size": n_words, "entity_size": ents.count()}
        return Dictionary(words, ents, red, meta)

    @property
    def uuid(self) -> str:
        return self.meta["uuid"]

    @property
    def language(self) -> str:
        return self.meta["language"]

    @property
    def entity_offset(self) -> int:
        return self.meta["word_size"]

    word_size = entity_offset

    @property
    def entity_size(self) -> int:
        return self.meta["entity_size"]

    def __len__(self) -> int:
        return self.word_size + self.entity_size

    def items(self) -> DataFrame:
        """``idx, kind, name, count, doc_count``: words, then entities."""
        w = self.words.select("idx", F.lit("word").alias("kind"), F.col("text").alias("name"), "count", "doc_count")
        return w.unionByName(self.entities.select("idx", F.lit("entity").alias("kind"), F.col("title").alias("name"), "count", "doc_count"))

    def word_index(self, df: DataFrame, column: str, out: str = "word_idx") -> DataFrame:
        """Add each word's index, -1 for a miss; keys are taken as they are, not lower-cased."""
        w = self.words.select(F.col("text").alias("__w_"), F.col("idx").alias(out))
        return df.join(w, F.col(column) == F.col("__w_"), "left").drop("__w_").withColumn(out, F.coalesce(out, F.lit(-1)))

    def entity_index(self, df: DataFrame, column: str, out: str = "entity_idx", resolve_redirect: bool = True) -> DataFrame:
        """Add each title's index: its redirect's target before the title itself, one hop, -1 for a miss."""
        e = self.entities.select(F.col("title").alias("__t_"), F.col("idx").alias("__e_"))
        out_df = df.join(e, F.col(column) == F.col("__t_"), "left")
        found = F.col("__e_")
        if resolve_redirect:
            r = self.redirect_idx.select(F.col("src").alias("__s_"), F.col("entity_idx").alias("__r_"))
            out_df = out_df.join(r, F.col(column) == F.col("__s_"), "left")
            found = F.coalesce("__r_", "__e_")
        return out_df.withColumn(out, F.coalesce(found, F.lit(-1))).drop("__t_", "__e_", "__s_", "__r_")

    def get_word(self, word: str, default: object = None):
        row = self.words.where(F.col("text") == word).first()
        return default if row is None else row

    def get_word_index(self, word: str) -> int:
        row = self.get_word(word)
        return -1 if row is None else row["idx"]

    def get_entity_index(self, name: str, resolve_redirect: bool = True):
        """The index of a title, -1 for a miss; a redirect's target goes before the title itself."""
        hit = self.redirect_idx.where(F.col("src") == name).select(F.col("entity_idx").alias("idx")).first() if resolve_redirect else None
        hit = hit or self.entities.where(F.col("title") == name).select("idx").first()
        return hit["idx"] if hit else -1

    def get_entity(self, name: str, resolve_redirect: bool = True, default: object = None):
        at = self.get_entity_index(name, resolve_redirect)
        return self.get_entity_by_index(at) if at >= 0 else default

    def _by_index(self, df: DataFrame, idx: int):
        row = df.where(F.col("idx") == idx).first()
        if row is None:
            raise KeyError(idx)
        return row

    def get_word_by_index(self, idx: int):
        return self._by_index(self.words, idx)

    def get_entity_by_index(self, idx: int):
        return self._by_index(self.entities, idx)

    def get_item_by_index(self, idx: int):
        return self._by_index(self.items(), idx)


def resolve_redirects(titles: DataFrame, redirects: DataFrame, column: str = "title", max_steps: int = 10) -> DataFrame:
    """Follow redirects, at most ``max_steps`` hops: adds ``resolved``. A loop gives the title itself, the limit the last title reached."""
    red = redirects.dropDuplicates(["src"]).select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    state = titles.withColumn("_cur", F.col(column)).withColumn("_seen", F.array(F.col(column))).withColumn("_loop", F.lit(False))
    for step in range(max_steps):
        j = state.join(red, (F.col("_cur") == F.col("_s")) & ~F.col("_loop"), "left")
        loop = F.col("_loop") | F.coalesce(F.array_contains("_seen", F.col("_d")), F.lit(False))
        state = j.select(*titles.columns, F.coalesce("_d", "_cur").alias("_cur"), F.when(F.col("_d").isNotNull(), F.array_append("_seen", F.col("_d"))).otherwise(F.col("_seen")).alias("_seen"), loop.alias("_loop"), F.col("_d").isNotNull().alias("_moved"))
        state = cut(state)
        if state.where("_moved and not _loop").isEmpty():
            break
        state = state.drop("_moved")
    return state.select(*titles.columns, F.when(F.col("_loop"), F.col(column)).otherwise(F.col("_cur")).alias("resolved"))


def mark_redirects(titles: DataFrame, redirects: DataFrame, column: str = "title") -> DataFrame:
    src = redirects.select(F.col("src").alias("_s")).distinct().withColumn("is_redirect", F.lit(True))
    return titles.join(src, F.col(column) == F.col("_s"), "left").drop("_s").withColumn("is_redirect", F.coalesce("is_redirect", F.lit(False)))


def mark_disambiguations(titles: DataFrame, pages: DataFrame, column: str = "title") -> DataFrame:
    """A title without a page is no disambiguation page."""
    flag = pages.select(F.col("title").alias("_t"), F.col("is_disambiguation").alias("_f")).groupBy("_t").agg(F.max("_f").alias("is_disambiguation"))
    return titles.join(flag, F.col(column) == F.col("_t"), "left").drop("_t").withColumn("is_disambiguation", F.coalesce("is_disambiguation", F.lit(False)))
