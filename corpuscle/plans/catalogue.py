"""Queries over the driver's tables, one or more for each operator, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions import titles as H
from ..functions.wikitext import parse_page
from ..operators import classify, dictionary as D, evaluate as Q, graph as G, mentions as N, training as E, vectors as V
from ..operators.linker import entity_names
from ..params import DictionaryParams, MentionParams, TrainParams
from ..sources import artefacts, datasets
from . import fixtures as X
from .lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

W = r"[\p{L}\p{N}_]+"
PARA = "para AS (SELECT doc_id, i - 1 AS para_no, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
TOK = PARA + f", tok AS (SELECT doc_id, para_no, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM (SELECT doc_id, para_no, regexp_extract_all(text, '{W}') AS w FROM para))"
SPAN = PARA + f""", piece AS (SELECT doc_id, para_no, unnest(w) AS token, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) - 1 AS pos FROM
 (SELECT doc_id, para_no, regexp_extract_all(text, '{W}') AS w, regexp_split_to_array(text, '{W}') AS g FROM para) WHERE len(w) > 0),
span AS (SELECT doc_id, para_no, pos, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, para_no ORDER BY pos) - length(token) AS INTEGER) AS s,
 CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, para_no ORDER BY pos) AS INTEGER) AS e FROM piece)"""
NORM = "replace(replace(replace(upper(substr({0}, 1, 1)), 'ß', 'SS'), 'ẞ', 'SS') || substr({0}, 2), '_', ' ')"
LINK = """anchor AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<h1>([^<\\s]*)', 1) AS h,
 regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1) AS x, regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
flat AS (SELECT page_id, lang, h, unnest(x) AS x, unnest(t) AS text, generate_subscripts(x, 1) - 1 AS pos FROM anchor WHERE len(x) > 0),
link AS (SELECT page_id, lang, """ + NORM.format("h") + " AS title, pos, text, " + NORM.format("x") + " AS target FROM flat)"
REDIR = LINK + """, redir AS (SELECT src, substr(src, 1, length(src) - 1) AS dst FROM (SELECT DISTINCT unnest([title, target]) AS src FROM link) WHERE regexp_matches(src, '[.,]$') AND length(src) > 1)"""
# in these tables every map is one hop or a chain of rising titles no longer than the string of stops
ENT = REDIR + """, raw AS (SELECT title, sum(n) AS c, count(*) AS d FROM (SELECT page_id, target AS title, count(*) AS n FROM link WHERE position('#' IN target) = 0 GROUP BY ALL) GROUP BY title),
folded AS (SELECT coalesce(r.dst, raw.title) AS title, CAST(sum(c) AS BIGINT) AS count, CAST(sum(d) AS BIGINT) AS doc_count FROM raw LEFT JOIN redir r ON r.src = raw.title GROUP BY 1),
dis AS (SELECT DISTINCT title FROM link WHERE page_id % 7 = 0),
ent AS (SELECT * FROM folded WHERE count >= 3 AND NOT regexp_matches(title, '(?i)^(?:Category):') AND title NOT IN (SELECT title FROM dis)),
ridx AS (SELECT r.src, e.title AS entity FROM redir r JOIN ent e ON e.title = r.dst)"""
EDGE = ENT + """, known AS (SELECT src AS t, entity FROM ridx UNION ALL SELECT title, title FROM ent WHERE title NOT IN (SELECT src FROM ridx)),
e1 AS (SELECT a.entity AS src, b.entity AS dst FROM link l JOIN known a ON a.t = l.title JOIN known b ON b.t = l.target),
edge AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1))"""
AMB = SPAN + ", " + LINK + """, pair AS (SELECT lower(text) AS name, target || ' (' || lang || ')' AS entity FROM link WHERE length(text) <= 20 AND text <> ''),
cnt AS (SELECT name, entity, count(*) AS link_count FROM pair GROUP BY ALL),
cand AS (SELECT a.doc_id, a.para_no, a.s, b.e, substr(lower(p.text), a.s + 1, b.e - a.s) AS name FROM span a JOIN span b ON a.doc_id = b.doc_id AND a.para_no = b.para_no AND b.pos >= a.pos AND b.pos < a.pos + 20 AND b.e - a.s <= 20
 JOIN para p ON p.doc_id = a.doc_id AND p.para_no = a.para_no),
df AS (SELECT name, count(DISTINCT doc_id) AS doc_count FROM cand WHERE name IN (SELECT name FROM cnt) GROUP BY name),
tot AS (SELECT c.*, CAST(sum(link_count) OVER (PARTITION BY c.name) AS BIGINT) AS total_link_count, df.doc_count FROM cnt c JOIN df USING (name)),
mention AS (SELECT * FROM tot WHERE total_link_count / doc_count >= 0.05 AND link_count / total_link_count >= 0.1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _dictionary(spark: SparkSession, sf: str, min_words: int = 5) -> D.Dictionary:
    p = DictionaryParams(min_word_count=min_words, min_entity_count=3)
    return D.Dictionary.build(X.paragraphs(spark, sf), X.page_links(spark, sf), X.redirects(spark, sf), X.disambiguations(spark, sf), "en", p, paragraph_doc="doc_id", link_doc="page_id")


def _ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return X.page_links(spark, sf).where("length(text) <= 20 and text <> ''").select(F.lower("text").alias("name"), F.format_string("%s (%s)", "target", "lang").alias("entity"))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _ambiguous(spark, sf)
    counts = N.name_document_counts(X.paragraphs(spark, sf), pairs, "doc_id", ["doc_id", "para_no"], 20)
    return N.mention_statistics(pairs, counts, "entity", 0.05, 0.1)


@query("word_counts", f"WITH {TOK} SELECT lower(token) AS word, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT doc_id) AS BIGINT) AS doc_count FROM tok WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 5")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.word_counts(X.paragraphs(spark, sf), "doc_id").where("count >= 5")


@query("top_words", f"WITH {TOK} SELECT lower(token) AS word, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT doc_id) AS BIGINT) AS doc_count FROM tok WHERE n >= 5 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100")
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return D.word_counts(X.paragraphs(spark, sf), "doc_id").orderBy(F.desc("count"), "word").limit(100)


@query("word_index", f"WITH {TOK} SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS idx FROM (SELECT lower(token) AS word FROM tok WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 5)")
def word_index(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense_index(word_counts(spark, sf).select("word"), "word")


@query("token_offsets", f"WITH {SPAN} SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, CAST(pos AS INTEGER) AS pos, token, s AS start_at, e AS end_at FROM span")
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    t = T.regexp_tokens(X.paragraphs(spark, sf), ["doc_id", "para_no"])
    return t.select("doc_id", "para_no", "pos", "token", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("doc_len_filtered", f"WITH {TOK} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens FROM tok WHERE n >= 5 GROUP BY doc_id")
def doc_len_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraph_words(X.paragraphs(spark, sf), "doc_id").groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_tokens"))


@query("sentence_spans", f"""WITH {PARA}, sen AS (SELECT doc_id, para_no, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS sent FROM (SELECT doc_id, para_no, list_filter(string_split(regexp_replace(text, '([.!?…。！？]+["'')\\]]*\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM para))
SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, CAST(sent AS INTEGER) AS sent, CAST(sum(length(t)) OVER w - length(t) AS INTEGER) AS start_at, CAST(sum(length(t)) OVER w AS INTEGER) AS end_at FROM sen WINDOW w AS (PARTITION BY doc_id, para_no ORDER BY sent)""")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentences(X.paragraphs(spark, sf), ["doc_id", "para_no"])
    return s.select("doc_id", "para_no", "sent", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("normalize_text", "SELECT doc_id, strip_accents(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("normalized_titles", f"WITH {LINK} SELECT DISTINCT target, regexp_matches(target, '(?i)^(?:Category):') AS is_category, regexp_matches(target, '(?i)^(?:File|Image|Media):') AS is_media, regexp_replace(target, '\\s\\(.*\\)$', '') AS plain FROM link")
def normalized_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("target")
    return X.page_links(spark, sf).select("target", H.is_category_title(t, "en").alias("is_category"), H.is_media_title(t, "en").alias("is_media"), H.strip_disambiguator(t).alias("plain")).distinct()


@query("entity_counts", f"WITH {ENT} SELECT title, count, doc_count FROM folded")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = D.entity_counts(X.page_links(spark, sf), "page_id", "target").withColumnRenamed("target", "title")
    return D.fold_redirects(raw, X.redirects(spark, sf))


def _chain_maps(spark: SparkSession) -> DataFrame:
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("z", "y"), ("y", "x"), ("m", "m"), ("k", "m"), ("p", "q"), ("q", "p"), ("s", "s2"), ("s2", "a")]
    return spark.createDataFrame(rows, "src string, dst string")


@query("redirect_fold_chains", """WITH RECURSIVE red(src, dst) AS (VALUES ('a','b'),('b','c'),('c','d'),('z','y'),('y','x'),('m','m'),('k','m'),('p','q'),('q','p'),('s','s2'),('s2','a')),
walk(src, key, dst) AS (SELECT src, src, dst FROM red UNION ALL SELECT w.src, r.src, r.dst FROM walk w JOIN red r ON r.src = w.dst WHERE w.dst > w.key),
stop AS (SELECT src, CASE WHEN dst <> key THEN dst END AS dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY key DESC) AS r FROM walk) WHERE r = 1)
SELECT src, dst FROM stop""")
def redirect_fold_chains(spark: SparkSession, sf: str) -> DataFrame:
    return D.fold_targets(_chain_maps(spark))


@query("resolve_redirect", f"""WITH RECURSIVE {REDIR}, walk(t, cur, n) AS (SELECT src, dst, 1 FROM redir UNION ALL SELECT w.t, r.dst, n + 1 FROM walk w JOIN redir r ON r.src = w.cur WHERE n < 10)
SELECT t AS title, max_by(cur, n) AS resolved FROM walk GROUP BY t""")
def resolve_redirect(spark: SparkSession, sf: str) -> DataFrame:
    r = X.redirects(spark, sf)
    return D.resolve_redirects(r.select(F.col("src").alias("title")), r)


@query("title_flags", f"WITH {REDIR} SELECT DISTINCT target AS title, target IN (SELECT src FROM redir) AS is_redirect, target IN (SELECT title FROM link WHERE page_id % 7 = 0) AS is_disambiguation FROM link")
def title_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = X.page_links(spark, sf).select(F.col("target").alias("title")).distinct()
    pages = X.disambiguations(spark, sf).withColumn("is_disambiguation", F.lit(True))
    return D.mark_disambiguations(D.mark_redirects(t, X.redirects(spark, sf)), pages)


@query("entity_dictionary", f"WITH {ENT} SELECT title, count, doc_count, CAST(row_number() OVER (ORDER BY title) - 1 AS INTEGER) AS place FROM ent")
def entity_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    return d.entities.select("title", "count", "doc_count", (F.col("idx") - d.entity_offset).alias("place"))


@query("dictionary_sizes", f"WITH {TOK}, {ENT} SELECT (SELECT count(*) FROM (SELECT 1 FROM tok WHERE n >= 5 GROUP BY lower(token) HAVING count(*) >= 50)) AS word_size, (SELECT count(*) FROM ent) AS entity_size")
def dictionary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    return d.items().agg(F.sum(F.when(F.col("kind") == "word", 1).otherwise(0)).alias("word_size"), F.sum(F.when(F.col("kind") == "entity", 1).otherwise(0)).alias("entity_size"))


@query("entity_lookup", f"WITH {ENT} SELECT DISTINCT l.target, coalesce(r.entity, e.title) AS entity FROM link l LEFT JOIN ridx r ON r.src = l.target LEFT JOIN ent e ON e.title = l.target")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    t = d.entity_index(X.page_links(spark, sf).select("target").distinct(), "target")
    return t.join(d.entities.select(F.col("idx").alias("entity_idx"), F.col("title").alias("entity")), "entity_idx", "left").select("target", "entity")


@query("word_lookup", f"WITH {TOK}, v AS (SELECT lower(token) AS word, row_number() OVER (ORDER BY lower(token)) - 1 AS i FROM tok WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 50) SELECT DISTINCT token, CAST(coalesce(i, -1) AS INTEGER) AS word_idx FROM tok LEFT JOIN v ON v.word = token")
def word_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    tokens = X.paragraphs(spark, sf).select(F.explode(T.word_array(F.col("text"))).alias("token")).distinct()
    return d.word_index(tokens, "token")


def _named_edges(spark: SparkSession, sf: str, d: D.Dictionary | None = None) -> DataFrame:
    d = d or _dictionary(spark, sf, 50)
    g = G.LinkGraph.build(X.page_links(spark, sf), d)
    name = lambda c: d.entities.select(F.col("idx").alias(c), F.col("title").alias(f"{c}_title"))
    return g.edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_title").alias("src"), F.col("dst_title").alias("dst"))


@query("link_graph_edges", f"WITH {EDGE} SELECT src, dst FROM edge")
def link_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _named_edges(spark, sf)


@query("neighbors", f"WITH {EDGE} SELECT src, string_agg(dst, '|' ORDER BY dst) AS neighbors FROM edge GROUP BY src")
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    lists = G.LinkGraph.build(X.page_links(spark, sf), d).neighbor_lists()
    titles = d.entities.select(F.col("idx").alias("n"), "title")
    flat = lists.select("src", F.posexplode("neighbors").alias("at", "n")).join(titles, "n")
    per = flat.groupBy("src").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda s: s["title"])).alias("neighbors"))
    return per.join(titles.withColumnRenamed("n", "src"), "src").select(F.col("title").alias("src"), "neighbors")


@query("degree_topk", f"WITH {EDGE} SELECT src, CAST(count(*) AS BIGINT) AS degree FROM edge GROUP BY src ORDER BY 2 DESC, 1 LIMIT 20")
def degree_topk(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_named_edges(spark, sf)).orderBy(F.desc("degree"), "src").limit(20)


@query("mention_table", f"WITH {AMB} SELECT name, entity, link_count, total_link_count, doc_count, round(least(1.0, total_link_count / doc_count), 6) AS link_prob, round(least(1.0, link_count / total_link_count), 6) AS prior_prob FROM mention")
def mention_table(spark: SparkSession, sf: str) -> DataFrame:
    m = N.with_probabilities(_mentions(spark, sf))
    return m.select("name", "entity", "link_count", "total_link_count", "doc_count", F.round("link_prob", 6).alias("link_prob"), F.round("prior_prob", 6).alias("prior_prob"))


@query("mention_query", f"WITH {AMB} SELECT name, entity, link_count FROM mention WHERE name IN ('the', 'on', 'der', 'de')")
def mention_query(spark: SparkSession, sf: str) -> DataFrame:
    db = N.MentionDB(cut(_mentions(spark, sf)), None, {"build_params": vars(MentionParams())})
    found = db.mentions.where("false")
    for text in ("The", "ON", "der", "de", "no such name"):  # names are folded
        try:
            found = found.unionByName(db.query(text))
        except KeyError:
            pass
    return found.select("name", "entity", "link_count")


@query("link_name_pairs", f"WITH {EDGE} SELECT lower(l.text) AS name, k.entity, CAST(count(*) AS BIGINT) AS n FROM link l JOIN known k ON k.t = l.target WHERE length(l.text) <= 20 AND l.text <> '' GROUP BY ALL")
def link_name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf)
    pairs = N.link_names(X.page_links(spark, sf), d, 20)
    titles = d.entities.select(F.col("idx").alias("entity_idx"), F.col("title").alias("entity"))
    return pairs.join(titles, "entity_idx").groupBy("name", "entity").agg(F.count("*").alias("n"))


@query("prefix_search", f"WITH {LINK}, name AS (SELECT DISTINCT lower(text) AS name FROM link WHERE length(text) <= 20 AND text <> '') SELECT item_id, name, CAST(length(name) AS INTEGER) AS len FROM benchmark JOIN name ON starts_with(substr(lower(text), 1, 20), name)")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    db = N.MentionDB(_ambiguous(spark, sf), None, {"build_params": vars(MentionParams())})
    return db.prefix_search(X.table(spark, sf, "benchmark")).select("item_id", "name", "len")


def _detect(spark: SparkSession, sf: str, own: bool) -> DataFrame:
    m = cut(_mentions(spark, sf)).withColumnRenamed("entity", "entity_idx")
    db = N.MentionDB(m, None, {"build_params": vars(MentionParams())})
    docs = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    here = X.page_links(spark, sf).select(F.col("page_id").alias("page"), F.format_string("%s (%s)", "target", "lang").alias("entity_idx")) if own else None
    return db.detect(docs, ["doc_id"], here, "doc_id").select(F.col("doc_id").alias("item_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text", F.col("entity_idx").alias("entity"))


_DETECT = (
    "WITH RECURSIVE "
    + AMB
    + f""", bpiece AS (SELECT item_id, unnest(w) AS token, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(text, '{W}') AS w, regexp_split_to_array(text, '{W}') AS g FROM benchmark) WHERE len(w) > 0),
bspan AS (SELECT item_id, pos, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY item_id ORDER BY pos) - length(token) AS INTEGER) AS s, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS e FROM bpiece),
bcand AS (SELECT a.item_id, a.s, b.e, substr(lower(t.text), a.s + 1, b.e - a.s) AS name FROM bspan a JOIN bspan b ON a.item_id = b.item_id AND b.pos >= a.pos AND b.e - a.s <= 20 JOIN benchmark t ON t.item_id = a.item_id),
hit AS (SELECT item_id, s, max(e) AS e FROM bcand WHERE name IN (SELECT name FROM mention) GROUP BY ALL),
lst AS (SELECT item_id, list({{'s': s, 'e': e}} ORDER BY s) AS l FROM hit GROUP BY item_id),
walk(item_id, l, i, cur, taken) AS (SELECT item_id, l, 1, l[1].e, 1 FROM lst UNION ALL SELECT item_id, l, i + 1, CASE WHEN l[i + 1].s >= cur THEN l[i + 1].e ELSE cur END, CASE WHEN l[i + 1].s >= cur THEN 1 ELSE 0 END FROM walk WHERE i < len(l)),
took AS (SELECT w.item_id, l[i].s AS s, l[i].e AS e, substr(t.text, l[i].s + 1, l[i].e - l[i].s) AS text, substr(lower(t.text), l[i].s + 1, l[i].e - l[i].s) AS name FROM walk w JOIN benchmark t ON t.item_id = w.item_id WHERE taken = 1),
here AS (SELECT DISTINCT page_id, target || ' (' || lang || ')' AS entity FROM link),
c AS (SELECT k.*, m.entity, count(*) OVER (PARTITION BY k.item_id, k.s) AS n, h.entity IS NOT NULL AS in_page FROM took k JOIN mention m USING (name) LEFT JOIN here h ON h.page_id = k.item_id AND h.entity = m.entity),
c2 AS (SELECT *, sum(CASE WHEN in_page THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, s) AS k FROM c)
SELECT item_id, s AS start_at, e AS end_at, text, entity FROM c2 WHERE """
)


@query("detect_mentions", _DETECT + "n = 1")
def detect_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _detect(spark, sf, False)


@query("detect_mentions_page", _DETECT + "n = 1 OR (k = 1 AND in_page)")
def detect_mentions_page(spark: SparkSession, sf: str) -> DataFrame:
    return _detect(spark, sf, True)


@query("page_entities", f"WITH {EDGE} SELECT DISTINCT page_id AS page, entity FROM (SELECT page_id, unnest([title, target]) AS t FROM link) JOIN known USING (t)")
def page_entities(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    p = N.page_entities(X.page_links(spark, sf), d, "page_id", own="title")
    return p.join(d.entities.select(F.col("idx").alias("entity_idx"), F.col("title").alias("entity")), "entity_idx").select("page", "entity")


WORDS = f"v AS (SELECT lower(token) AS word, CAST(count(*) AS BIGINT) AS count FROM tok WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 5)"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(spark, sf).select(F.col("word").alias("idx"), "count")


@query("sampling_table", f"WITH {TOK}, {WORDS}, t AS (SELECT *, sum(count) OVER () * 0.0001::DOUBLE AS t FROM v) SELECT word AS idx, round(round(least(1.0::DOUBLE, (sqrt(count / t) + 1) * t / count) * 4294967295) / 4294967295.0, 6) AS keep FROM t")
def sampling_table(spark: SparkSession, sf: str) -> DataFrame:
    return E.sampling_table(_words(spark, sf), 1e-4).select("idx", F.round(F.col("keep") / E.SCALE, 6).alias("keep"))


@query("neg_distribution", f"WITH {TOK}, {WORDS} SELECT 'word' AS kind, word AS idx, round(pow(count, 0.75) / sum(pow(count, 0.75)) OVER (), 6) AS share FROM v UNION ALL SELECT 'entity', word, round(1.0::DOUBLE / count(*) OVER (), 6) FROM v")
def neg_distribution(spark: SparkSession, sf: str) -> DataFrame:
    w = _words(spark, sf)
    rows = E.negative_distribution(w, 0.75).withColumn("kind", F.lit("word")).unionByName(E.negative_distribution(w, 0.0).withColumn("kind", F.lit("entity")))
    return rows.select("kind", "idx", F.round("share", 6).alias("share"))


@query("alpha_schedule", "SELECT page_id, round(greatest(0.0001::DOUBLE, 0.025::DOUBLE * (1 - (row_number() OVER (ORDER BY page_id) - 1 + 2 * (SELECT count(*) FROM pages)) / (5.0::DOUBLE * (SELECT count(*) FROM pages)))), 9) AS alpha FROM pages")
def alpha_schedule(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "pages").select("page_id")
    return E.alpha_schedule(p, F.col("page_id"), p.count(), TrainParams(), 2, "page_id").select("page_id", F.round("alpha", 9).alias("alpha"))


@query("link_schedule", "WITH n AS (SELECT count(*) AS n FROM pages), r AS (SELECT CAST(ceil((SELECT n FROM n) * 5 * 10 / (SELECT count(*) FROM embeddings)) AS INTEGER) AS r) SELECT CAST(floor((row_number() OVER (PARTITION BY turn ORDER BY vec_id) - 1 + turn * (SELECT count(*) FROM embeddings)) / 10) AS BIGINT) AS step, vec_id AS idx FROM embeddings, (SELECT unnest(range(r)) AS turn FROM r)")
def link_schedule(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"))
    return E.link_schedule(e, X.table(spark, sf, "pages").count(), TrainParams(), F.col("idx"))


@query("graph_pairs", f"WITH {EDGE}, o AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS i FROM ent) SELECT CAST(floor(i / 10) AS BIGINT) AS step, src, dst FROM o JOIN edge ON edge.src = o.title")
def graph_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = _dictionary(spark, sf, 50)
    edges = _named_edges(spark, sf, d)
    sched = d.entities.select(F.floor((F.col("idx") - d.entity_offset) / 10).cast("long").alias("step"), F.col("title").alias("idx"))
    return E.graph_pairs(sched, edges)


SKIP = TOK + ", v AS (SELECT lower(token) AS word FROM tok WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 50), k AS (SELECT doc_id, para_no, pos, word FROM tok LEFT JOIN v ON v.word = lower(token) WHERE n >= 5)"


def _indexed(spark: SparkSession, sf: str) -> tuple[D.Dictionary, DataFrame]:
    d = _dictionary(spark, sf, 50)
    return d, E.packed_tokens(X.paragraphs(spark, sf), d, ["doc_id", "para_no"], 5)


def _named_pairs(d: D.Dictionary, per: DataFrame) -> DataFrame:
    held = F.broadcast if d.word_size <= E.HELD_WORDS else lambda df: df
    name = lambda c: held(d.words.select(F.col("idx").alias(c), F.col("text").alias(f"{c}_word")))
    return per.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_word").alias("src"), F.col("dst_word").alias("dst"), "n")


@query("skipgram_pairs", f"WITH {SKIP} SELECT a.word AS src, b.word AS dst, CAST(count(*) AS BIGINT) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.para_no = b.para_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 WHERE a.word IS NOT NULL AND b.word IS NOT NULL GROUP BY 1, 2")
def skipgram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d, tok = _indexed(spark, sf)
    return _named_pairs(d, E.pair_counts(tok, ["doc_id", "para_no"], 2))


@query("sentence_pairs", f"""WITH {SKIP}, {SPAN[len(PARA) + 2:]}, sen AS (SELECT doc_id, para_no, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS sent FROM (SELECT doc_id, para_no, list_filter(string_split(regexp_replace(text, '([.!?…。！？]+["'')\\]]*\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM para)),
ss AS (SELECT doc_id, para_no, sent, sum(length(t)) OVER w - length(t) AS a, sum(length(t)) OVER w AS b FROM sen WINDOW w AS (PARTITION BY doc_id, para_no ORDER BY sent)),
k2 AS (SELECT k.*, ss.sent FROM k JOIN span p USING (doc_id, para_no, pos) JOIN ss ON ss.doc_id = k.doc_id AND ss.para_no = k.para_no AND p.s >= ss.a AND p.s < ss.b)
SELECT a.word AS src, b.word AS dst, CAST(count(*) AS BIGINT) AS n FROM k2 a JOIN k2 b ON a.doc_id = b.doc_id AND a.para_no = b.para_no AND a.sent = b.sent AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 WHERE a.word IS NOT NULL AND b.word IS NOT NULL GROUP BY 1, 2""")
def sentence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d, tok = _indexed(spark, sf)
    keys = ["doc_id", "para_no"]
    tok = E.sentence_of(tok, T.sentences(X.paragraphs(spark, sf), keys), keys, "start")
    return _named_pairs(d, E.pair_counts(tok, keys, 2))


@query("char_to_token", f"WITH {SPAN}, c AS (SELECT doc_id, para_no, unnest(range(0, length(text), 37)) AS at_char FROM para WHERE length(text) > 0) SELECT c.doc_id, CAST(c.para_no AS INTEGER) AS para_no, CAST(at_char AS INTEGER) AS at_char, CAST(coalesce(max(pos), 0) AS INTEGER) AS token FROM c LEFT JOIN span p ON p.doc_id = c.doc_id AND p.para_no = c.para_no AND p.s <= at_char GROUP BY ALL")
def char_to_token(spark: SparkSession, sf: str) -> DataFrame:
    p, keys = X.paragraphs(spark, sf), ["doc_id", "para_no"]
    places = p.where("length(text) > 0").select(*keys, F.explode(F.expr("sequence(0, length(text) - 1, 37)")).alias("at_char"))
    return E.char_to_token(places, E.packed_tokens(p, None, keys), keys, "at_char", "token")


@query("anchor_pairs", f"""WITH {SPAN}, v AS (SELECT lower(token) AS word, row_number() OVER (ORDER BY lower(token)) AS i FROM span s JOIN (SELECT doc_id, para_no FROM span GROUP BY ALL HAVING count(*) >= 5) USING (doc_id, para_no) GROUP BY 1 HAVING count(*) >= 50),
lng AS (SELECT doc_id, para_no, count(*) AS n FROM span GROUP BY ALL HAVING count(*) >= 5),
tgt AS (SELECT doc_id, para_no, CAST(length(text) // 3 AS INTEGER) AS a, CAST(length(text) // 3 + 9 AS INTEGER) AS b FROM para JOIN lng USING (doc_id, para_no) WHERE length(text) >= 30),
t2 AS (SELECT t.*, coalesce((SELECT max(pos) FROM span s WHERE s.doc_id = t.doc_id AND s.para_no = t.para_no AND s.s <= a), 0) AS ta, coalesce((SELECT max(pos) FROM span s WHERE s.doc_id = t.doc_id AND s.para_no = t.para_no AND s.s <= b - 1), 0) AS tb FROM tgt t)
SELECT t.doc_id, CAST(t.para_no AS INTEGER) AS para_no, CAST(s.pos AS INTEGER) AS ctx, v.word FROM t2 t JOIN span s ON s.doc_id = t.doc_id AND s.para_no = t.para_no AND s.pos >= ta - 3 AND s.pos <= tb + 3 AND (s.pos < ta OR s.pos > tb) JOIN v ON v.word = lower(s.token)""")
def anchor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d, tok = _indexed(spark, sf)
    keys = ["doc_id", "para_no"]
    t = X.paragraphs(spark, sf).where("length(text) >= 30").join(tok.select(*keys).distinct(), keys, "left_semi")
    t = t.select(*keys, F.expr("cast(length(text) div 3 as int)").alias("start"), F.expr("cast(length(text) div 3 + 9 as int)").alias("end"), F.lit(0).alias("entity_idx"))
    out = E.anchor_pairs(t, tok, keys, 3)
    return out.join(d.words.select(F.col("idx").alias("word_idx"), F.col("text").alias("word")), "word_idx").select(*keys, "ctx", "word")


@query("most_similar", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id AS idx, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 50")
def most_similar(spark: SparkSession, sf: str) -> DataFrame:
    return V.most_similar(X.vector_items(spark, sf), 7, 50).select("idx", F.round("score", 6).alias("score"))


@query("most_similar_min_count", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 8), s AS (SELECT vec_id, CASE WHEN label * 10 + 1 >= 50 THEN list_cosine_similarity(embedding::DOUBLE[], q.v) ELSE -100 END AS x FROM embeddings, q) SELECT vec_id AS idx, round(x, 6) AS score FROM s ORDER BY x DESC, vec_id LIMIT 400")
def most_similar_min_count(spark: SparkSession, sf: str) -> DataFrame:
    return V.most_similar(X.vector_items(spark, sf), 8, 400, 50).select("idx", F.round("score", 6).alias("score"))


@query("batch_topk", "WITH s AS (SELECT q.vec_id AS query_idx, e.vec_id AS idx, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS x FROM embeddings q, embeddings e WHERE q.vec_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY x DESC, idx) AS rank FROM s) SELECT query_idx, CAST(rank AS INTEGER) AS rank, idx, round(x, 6) AS score FROM r WHERE rank <= 10")
def batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    i = X.vector_items(spark, sf)
    return V.batch_similar(i.where("idx % 10 = 0"), i, 10).select("query_idx", "rank", "idx", F.round("score", 6).alias("score"))


def _export_sql(sep: str, join: str, underscore: bool) -> str:
    name = "CASE WHEN vec_id % 2 = 0 THEN 'w ' ELSE 'ENTITY/e ' END || vec_id"
    name = f"replace({name}, ' ', '_')" if underscore else name
    # values sit on ties of three decimals nowhere in these tables
    return f"SELECT {name} || '{sep}' || array_to_string(list_transform(embedding, lambda x: printf('%.3f', x::DOUBLE)), ' ') AS line FROM embeddings"


@query("export_default", _export_sql("\t", " ", False))
def export_default(spark: SparkSession, sf: str) -> DataFrame:
    return artefacts.text_lines(X.vector_items(spark, sf), "default").select("line")


@query("export_word2vec", _export_sql(" ", " ", True) + " UNION ALL SELECT count(*) || ' 64' FROM embeddings")
def export_word2vec(spark: SparkSession, sf: str) -> DataFrame:
    return artefacts.text_lines(X.vector_items(spark, sf), "word2vec").select("line")


@query("export_glove", _export_sql(" ", " ", True))
def export_glove(spark: SparkSession, sf: str) -> DataFrame:
    return artefacts.text_lines(X.vector_items(spark, sf), "glove").select("line")


@query("import_text", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'word' ELSE 'entity' END AS kind, CASE WHEN vec_id % 2 = 0 THEN 'w_' ELSE 'e ' END || vec_id AS name, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(printf('%.3f', x::DOUBLE) AS DOUBLE))), 6) AS total FROM embeddings")
def import_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = artefacts.text_lines(X.vector_items(spark, sf), "word2vec")
    lines = lines.withColumn("pos", F.row_number().over(Window.orderBy("k1", "k2"))).select("pos", "line")
    total = F.aggregate("syn0", F.lit(0.0), lambda s, x: s + x)
    return artefacts.parse_text(lines).select("kind", "name", F.size("syn0").alias("dim"), F.round(total, 6).alias("total"))


RANK = "rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0"
GOLD = "g AS (SELECT a.vec_id, a.label, abs(a.label - b.label) AS gold, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    a = X.table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    return a.join(b, "vec_id").select("vec_id", "label", F.abs(F.col("label") - F.col("l2")).alias("gold"), V.cosine(F.col("embedding"), F.col("e2")).alias("cos"))


@query("spearman", f"WITH {GOLD}, r AS (SELECT {RANK.format(g='1', c='gold')} AS a, {RANK.format(g='1', c='cos')} AS b FROM g) SELECT round(corr(a, b), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return Q.spearman(_gold(spark, sf), "gold", "cos").select(F.round("rho", 6).alias("rho"), "n")


@query("word_similarity", f"WITH {GOLD}, k AS (SELECT * FROM g WHERE vec_id % 5 <> 0 AND (vec_id + 1) % 5 <> 0), r AS (SELECT {RANK.format(g='1', c='gold')} AS a, {RANK.format(g='1', c='cos')} AS b FROM k) SELECT round(corr(a, b), 6) AS rho, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(*) FROM g) - count(*) AS BIGINT) AS oov FROM r")
def word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    gold = _gold(spark, sf).select(F.concat(F.lit("W"), "vec_id").alias("w1"), F.concat(F.lit("w"), F.col("vec_id") + 1).alias("w2"), "gold")
    words = X.table(spark, sf, "embeddings").where("vec_id % 5 <> 0").select(F.concat(F.lit("w"), "vec_id").alias("name"), F.col("embedding").alias("syn0"))
    return Q.word_similarity(gold, words).select(F.round("rho", 6).alias("rho"), "n", F.col("oov").cast("long").alias("oov"))


@query("relatedness", f"""WITH p AS (SELECT a.vec_id AS seed, b.vec_id - a.vec_id AS rank, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 20 WHERE a.vec_id % 21 = 0 AND b.vec_id % 4 <> 0),
r AS (SELECT seed, {RANK.format(g='seed', c='-rank')} AS a, {RANK.format(g='seed', c='cos')} AS b FROM p) SELECT seed, round(corr(a, b), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY seed HAVING count(*) > 1""")
def relatedness(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings")
    a = e.where("vec_id % 21 = 0").select(F.col("vec_id").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank"))
    ranked = a.withColumn("title", F.col("seed") + F.col("rank"))
    vec = e.where("vec_id % 4 <> 0 or vec_id % 21 = 0").select(F.col("vec_id").alias("name"), F.col("embedding").alias("syn0"))
    out = Q.relatedness(ranked.where("title % 4 <> 0"), vec)
    return out.where("n > 1").select("seed", F.round("rho", 6).alias("rho"), "n")


@query("analogy", """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
q AS (SELECT a.vec_id AS qid, list_transform(range(1, 65), lambda i: b.u[i] - a.u[i] + c.u[i]) AS t FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 JOIN u d ON d.vec_id = a.vec_id + 3 WHERE a.vec_id % 5 = 0),
s AS (SELECT qid, u.vec_id, list_dot_product(t, u.u) AS x FROM q JOIN u ON u.vec_id NOT IN (qid, qid + 1, qid + 2))
SELECT qid, 'w' || max_by(vec_id, x) AS pred FROM s GROUP BY qid""")
def analogy(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings")
    vocab = Q.analogy_vocabulary(e.select(F.concat(F.lit("w"), "vec_id").alias("name"), F.col("embedding").alias("syn0"), F.col("vec_id").alias("idx"), F.col("label").alias("count")))
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), *[F.concat(F.lit("w"), F.col("vec_id") + i).alias(k) for i, k in enumerate("abcd")])
    return Q.analogies(q, vocab).select("qid", "pred")


@query("accuracy_macro_f1", """WITH p AS (SELECT l.quality AS y, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT unnest([0, 1]) AS c), f AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS s, count(*) FILTER (p = c) AS g FROM p, c GROUP BY c)
SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM p), 6) AS accuracy, round(avg(2.0 * tp / (s + g)), 6) AS macro_f1 FROM f""")
def accuracy_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).alias("pred"))
    m = Q.classification_metrics(p)
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("evaluation_report", f"WITH {GOLD} SELECT 'label ' || label || ',' || printf('%.4f', avg(gold)) || ',' || count(*) AS line FROM g GROUP BY label")
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    per = _gold(spark, sf).groupBy("label").agg(F.avg("gold").alias("score"), F.count("*").alias("oov"))
    return Q.report(per.select(F.concat(F.lit("label "), "label").alias("name"), "score", "oov"), "csv")


@query("feature_sequences", f"""WITH t AS (SELECT item_id, unnest(w) AS item, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(text, '{W}') AS w FROM benchmark)),
v AS (SELECT item, row_number() OVER (ORDER BY f, item) AS id FROM (SELECT item, min((item_id, pos)) AS f FROM t GROUP BY item HAVING count(*) >= 2)),
s AS (SELECT item_id, list(id ORDER BY pos) AS l FROM t JOIN v USING (item) GROUP BY item_id)
SELECT item_id, array_to_string((coalesce(l, []) || list_transform(range(16), lambda x: 0))[:16], ' ') AS ids FROM benchmark LEFT JOIN s USING (item_id)""")
def feature_sequences(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "benchmark")
    items = docs.select("item_id", F.posexplode(T.word_array(F.col("text"))).alias("pos", "item"))
    seq = classify.sequences(docs, items, classify.vocabulary(items, ["item_id", "pos"], min_count=2), "item_id", ["pos"], 16)
    return seq.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


CLEAN = "strip_accents(lower(regexp_replace(regexp_replace({0}, '\\s\\(.*\\)$', ''), '\\s+', ' ', 'g')))"


@query("entity_linker_names", f"""WITH {REDIR}, n AS (SELECT text AS name, coalesce(r3.dst, r2.dst, r1.dst, target) AS title, 0 AS own FROM link LEFT JOIN redir r1 ON r1.src = target LEFT JOIN redir r2 ON r2.src = r1.dst LEFT JOIN redir r3 ON r3.src = r2.dst WHERE length(text) <= 30 AND text <> ''
UNION ALL SELECT {CLEAN.format('title')}, title, 1 FROM (SELECT DISTINCT title FROM link) UNION ALL SELECT {CLEAN.format('src')}, dst, 1 FROM redir)
SELECT name, title, CAST(count(*) AS BIGINT) AS link_count, CAST(sum(own) AS BIGINT) AS own FROM n GROUP BY name, title""")
def entity_linker_names(spark: SparkSession, sf: str) -> DataFrame:
    k = X.page_links(spark, sf)
    names = entity_names(k.select("text", "target"), k.select("title").distinct(), X.redirects(spark, sf), 30)
    return names.groupBy("name", "title").agg(F.count("*").alias("link_count"), F.sum("own").alias("own"))


@query("naboe_forward", """WITH d AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS u, b.vec_id - a.vec_id AS k, b.embedding::DOUBLE[] AS e FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 5 WHERE a.vec_id % 10 = 0),
l AS (SELECT vec_id, k, exp(0.7 * (k / 5.0) + 1.3 * list_cosine_similarity(u, e) - 0.1) AS x FROM d) SELECT vec_id, CAST(k AS INTEGER) AS k, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS attention FROM l""")
def naboe_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The attention that the classifier's own forward pass gives five entities of one word each."""
    e = X.table(spark, sf, "embeddings")
    a = e.where("vec_id % 10 = 0").select("vec_id", F.col("embedding").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    d = a.join(e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("e")), F.col("o") == F.col("vec_id") + F.col("k"))
    d = d.groupBy("vec_id").agg(F.first("u").alias("u"), F.array_sort(F.collect_list(F.struct("k", "e"))).alias("near"))

    def attend(batches):
        for pdf in batches:
            out = []
            for key, u, near in zip(pdf["vec_id"], pdf["u"], pdf["near"], strict=True):
                k = np.array([x["k"] for x in near])
                table = lambda rows: np.concatenate([np.zeros((1, len(u))), np.array(rows, float).reshape(-1, len(u))])  # noqa: B023, E731
                model = classify.Naboe(table(list(u)), table([x["e"] for x in near]), np.array([0.7, 1.3]), -0.1, np.zeros((1, len(u))), np.zeros(1))
                found = model.forward(np.array([[1]]), np.arange(1, len(k) + 1)[None], k[None] / 5.0, cache=True)[2][0]
                out += [(key, int(i), round(float(x), 6)) for i, x in zip(k, found, strict=True)]
            yield pd.DataFrame(out, columns=["vec_id", "k", "attention"])

    return d.mapInPandas(attend, "vec_id long, k int, attention double")


KINDS = {"en": ("Category", "File"), "de": ("Kategorie", "Datei"), "fr": ("Catégorie", "Fichier"), "es": ("Categoría", "Archivo")}


@query("namespaces_by_language", "WITH " + LINK + ", p AS (SELECT * FROM (VALUES ('en', 'Category', 'File'), ('de', 'Kategorie', 'Datei'), ('fr', 'Catégorie', 'Fichier'), ('es', 'Categoría', 'Archivo')) t(of, c, m)) SELECT page_id, pos, lang, of, of IN ('en', lang) AS is_category, of IN ('en', lang) AS is_media, text AS rest FROM link, p")
def namespaces_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with the category and media names of four languages, judged by the language of their page."""
    k = X.page_links(spark, sf).withColumn("z", F.explode(F.array(*[F.struct(F.lit(x).alias("of"), F.lit(c).alias("c"), F.lit(m).alias("m")) for x, (c, m) in KINDS.items()])))
    category, media = F.concat("z.c", F.lit(":"), "text"), F.concat("z.m", F.lit(":"), "text")
    by = lambda f: F.coalesce(*[F.when(F.col("lang") == x, f(x)) for x in KINDS])
    rest = F.when(by(lambda x: H.is_category_title(category, x)), by(lambda x: H.strip_category_prefix(category, x))).otherwise(F.col("text"))
    return k.select("page_id", "pos", "lang", F.col("z.of").alias("of"), by(lambda x: H.is_category_title(category, x)).alias("is_category"), by(lambda x: H.is_media_title(media, x)).alias("is_media"), rest.alias("rest"))


@query("disambiguation_by_language", "SELECT p_partkey, p_partkey % 2 = 0 AS is_disambiguation FROM part")
def disambiguation_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Templates that mark a disambiguation page in some language, each in odd case and spacing, against like names that mark none."""
    names = F.array(*map(F.lit, H.DISAMBIGUATION_TEMPLATES))
    name = F.element_at(names, (F.col("p_partkey") / 2 % F.size(names)).cast("int") + 1)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a {{ "), F.initcap(name), F.lit(" |x}} b"))).otherwise(F.concat(F.lit("a {{no "), name, F.lit("}} "), name))
    return X.table(spark, sf, "part").select("p_partkey", H.is_disambiguation(text).alias("is_disambiguation"))


WIKI = "w AS (SELECT p_partkey, '''''''' || p_brand || ''''''' is a [[' || p_type || '|' || p_name || ']]' || CASE WHEN p_partkey % 5 = 0 THEN ' {{Disambig|x}}' ELSE ' {{Infobox|x}}' END || CASE p_partkey % 3 WHEN 0 THEN '[[Category:Parts]]' WHEN 1 THEN '[[File:a.png]]' ELSE '' END AS wiki_text, p_brand, p_type, p_name FROM part)"


@query("page_parse_markup", "WITH " + WIKI + " SELECT p_partkey, regexp_replace(wiki_text, '''''+', '', 'g') AS plain, p_partkey % 5 = 0 AS is_disambiguation FROM w")
def page_parse_markup(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("wiki_text")
    return X.wiki_strings(spark, sf).select("p_partkey", H.strip_quote_markup(t).alias("plain"), H.is_disambiguation(t).alias("is_disambiguation"))


@query("page_parse_paragraphs", "WITH " + WIKI + " SELECT p_partkey, p_brand || ' is a ' || p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'Parts' ELSE '' END AS text, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_links, " + NORM.format("p_type") + " AS first_title, CAST(length(p_brand) + 6 AS INTEGER) AS start_at, CAST(length(p_brand) + 6 + length(p_name) AS INTEGER) AS end_at FROM w")
def page_parse_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["p_partkey"], pdf["wiki_text"], strict=True):
                for p in parse_page(text):
                    rows.append((key, p.text, len(p.links), p.links[0].title, p.links[0].start, p.links[0].end))
            yield pd.DataFrame(rows, columns=["p_partkey", "text", "n_links", "first_title", "start_at", "end_at"])

    return X.wiki_strings(spark, sf).mapInPandas(run, "p_partkey long, text string, n_links int, first_title string, start_at int, end_at int")


@query("gold_files", "SELECT CAST(label AS BIGINT) AS qid, 'a' || label AS a, 'b' AS b, 'c' AS c, 'd' || vec_id AS d FROM (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label)")
def gold_files(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    lines = e.select(F.col("label").alias("line_no"), F.concat(F.lit("A"), "label", F.lit(" b c D"), "vec_id").alias("value"))
    heads = e.select((F.col("label") + 100).alias("line_no"), F.lit(": section").alias("value"))
    return datasets.analogy_questions(lines.unionByName(heads))


@query("train_smoke", f"WITH {TOK}, {ENT.replace('count >= 3', 'count >= 1')} SELECT 'word' AS kind, lower(token) AS name, 16 AS dim, true AS has_vector FROM tok WHERE n >= 5 GROUP BY 2 HAVING count(*) >= 20 UNION ALL SELECT 'entity', title, 16, true FROM ent")
def train_smoke(spark: SparkSession, sf: str) -> DataFrame:
    """One iteration over all documents and pages, with the link graph and detected mentions: the items and whether each has a vector."""
    p = X.paragraphs(spark, sf)
    links = X.page_links(spark, sf).select(F.col("page_id").alias("doc_id"), F.lit(0).alias("para_no"), "title", "target", "text", F.lit(0).alias("start"), F.lit(3).alias("end"))
    d = D.Dictionary.build(p, links, X.redirects(spark, sf), X.disambiguations(spark, sf), "en", DictionaryParams(min_word_count=20, min_entity_count=1), paragraph_doc="doc_id", link_doc="doc_id")
    graph = G.LinkGraph.build(links, d)
    mentions = N.MentionDB.build(p, links, d, MentionParams(min_link_prob=0.05, min_prior_prob=0.1), "doc_id")
    model = E.train(p, links, d, graph, mentions, TrainParams(dim_size=16, iteration=1, window=2), ["doc_id", "para_no"])
    return model.items.select("kind", "name", F.size("syn0").alias("dim"), (V.norm(F.col("syn0")) > 0).alias("has_vector"))
