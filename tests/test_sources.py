import bz2

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators.linker import EntityLinker
from corpuscle.operators.vectors import Embedding
from corpuscle.params import DictionaryParams, LinkerParams, MentionParams, TrainParams
from corpuscle.plans import pipeline
from corpuscle.sources import artefacts, datasets
from corpuscle.sources.dump import PageStore, dump_language, read_dump
from corpuscle.streaming.counts import merged_counts, stream_word_counts

PAGES = [
    ("Tokyo", "0", None, "'''Tokyo''' is the [[capital city|capital]] of [[Japan]] and a big town.\n== Places ==\nThe [[Tokyo Tower|tower]] stands in Tokyo near [[Nippon]]. [[Category:Cities]]"),
    ("Japan", "0", None, "Japan is a country in [[East Asia]]. Its capital is [[Tokyo]] and it has a tower. [[File:flag.png|thumb]]"),
    ("Nippon", "0", "Japan", "#REDIRECT [[Japan]]"),
    ("Old Nippon", "0", "nippon", "#REDIRECT [[nippon]]"),
    ("Loop", "0", "Loop", "#REDIRECT [[Loop]]"),
    ("Tower", "0", None, "{{disambig}} Tower may refer to [[Tokyo Tower]] or to something else entirely."),
    ("Talk:Tokyo", "1", None, "not an article"),
]


def xml(pages):
    rows = []
    for title, ns, red, text in pages:
        text = text.replace("&", "&amp;").replace("<", "&lt;")
        rows.append(f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>1</id>\n" + (f'    <redirect title="{red}" />\n' if red else "") + f'    <revision>\n      <id>2</id>\n      <text bytes="1" xml:space="preserve">{text}</text>\n    </revision>\n  </page>\n')
    return '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10" xml:lang="en">\n' + "".join(rows) + "</mediawiki>\n"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "pages.xml.bz2"
    path.write_bytes(bz2.compress(xml(PAGES).encode()))
    return str(path)


@pytest.fixture(scope="module")
def store(spark, dump, tmp_path_factory):
    return pipeline.build_page_store(spark, dump, str(tmp_path_factory.mktemp("store")))


def test_dump_reader(spark, dump):
    assert dump_language(spark, dump) == "en"
    rows = {r.title: r for r in read_dump(spark, dump).collect()}
    assert set(rows) == {t for t, ns, *_ in PAGES if ns == "0"}
    assert rows["Old Nippon"].redirect == "Nippon" and rows["Tokyo"].redirect is None and rows["Tokyo"].wiki_text == PAGES[0][3]


def test_page_store(store):
    assert store.language == "en" and store.dump_file.endswith("pages.xml.bz2") and len(store.uuid) == 32
    assert store.page_size() == 3 and [r.title for r in store.titles().collect()] == ["Japan", "Tokyo", "Tower"]
    assert sorted(map(tuple, store.redirects.collect())) == [("Loop", "Loop"), ("Nippon", "Japan"), ("Old Nippon", "Nippon")]
    assert store.resolve_redirect("Old Nippon") == "Japan" and store.resolve_redirect("Loop") == "Loop" and store.resolve_redirect("Tokyo") == "Tokyo"
    assert store.is_redirect("Nippon") and not store.is_redirect("Tokyo") and store.is_disambiguation("Tower") and not store.is_disambiguation("Nowhere")
    p = store.get_paragraphs("Tokyo")
    assert len(p) == 2 and p[0].abstract and not p[1].abstract
    assert all(p[i].text[k.start : k.end] == k.text for i in range(2) for k in p[i].wiki_links)
    with pytest.raises(KeyError):
        store.get_paragraphs("Nippon")
    assert store.rejects.count() == 0 and {r.target for r in store.links().collect()} >= {"Capital city", "Japan", "Tokyo Tower", "Category:Cities"}


def test_bad_pages_are_kept_apart(spark, tmp_path):
    def fail(text):
        raise ValueError(text)

    raw = spark.createDataFrame([("A", "en", "some text", None)], "title string, lang string, wiki_text string, redirect string")
    s = PageStore.build(raw, str(tmp_path / "s"), preprocess=fail)
    assert [r.title for r in s.rejects.collect()] == ["A"] and s.page_size() == 0


def test_whole_run_and_artefacts(spark, dump, tmp_path):
    out = str(tmp_path / "model")
    d, m, t = DictionaryParams(min_word_count=1, min_entity_count=1), MentionParams(min_link_prob=0.0, min_prior_prob=0.0), TrainParams(dim_size=4, iteration=1, sample=0)
    model = pipeline.run_all(spark, dump, out, d, m, t)
    dic = artefacts.load_dictionary(spark, out + "_dic")
    assert model.items.count() == len(dic) and dic.get_entity("Nippon").title == "Japan" and model.train_params["dim_size"] == 4
    names = {r.name for r in artefacts.load_mentions(spark, out + "_mention", dic).mentions.collect()}
    assert {"capital", "tower", "japan"} <= names
    assert artefacts.load_graph(spark, out + "_lg", dic).edges.count() > 0
    other = pipeline.build_dictionary(spark, out + "_db", str(tmp_path / "other"), d)
    for load in (artefacts.load_graph, artefacts.load_mentions):
        with pytest.raises(RuntimeError):
            load(spark, out + ("_lg" if load is artefacts.load_graph else "_mention"), other)


def test_command_line(spark, dump, tmp_path):
    store = str(tmp_path / "db")
    pipeline.main(["build-page-store", dump, store], spark)
    pipeline.main(["build-dictionary", store, str(tmp_path / "dic"), "--min-word-count", "1", "--min-entity-count", "1", "--no-lowercase", "--tokenizer", "regexp"], spark)
    dic = artefacts.load_dictionary(spark, str(tmp_path / "dic"))
    assert dic.get_word("The") is not None and dic.meta["build_params"]["lowercase"] is False
    a = pipeline.parser().parse_args(["train", "x", "y", "--dim-size", "7", "--no-link-graph"])
    assert a.dim_size == 7 and a.link_graph is False and a.disambiguate and a.negative == 5


@pytest.mark.parametrize("kind", ["default", "word2vec", "glove"])
def test_text_formats(spark, tmp_path, kind):
    rng = np.random.default_rng(0)
    rows = [(i, "word" if i < 6 else "entity", f"na{'_' if i == 2 else ' ' if i > 6 else ''}me{i}", 1, 10 - i % 4, rng.normal(size=5).astype(np.float32).tolist()) for i in range(10)]
    items = spark.createDataFrame(rows, "idx int, kind string, name string, count long, doc_count long, syn0 array<float>")
    path = str(tmp_path / kind)
    artefacts.save_text(items, path, kind)
    lines = [r.value for r in spark.read.text(path).collect()]
    if kind == "word2vec":
        assert lines[0] == "10 5"
    body = lines[kind == "word2vec" :]
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    assert [line.split("\t" if kind == "default" else " ")[0].replace("ENTITY/", "") for line in body] == [r[2] if kind == "default" else r[2].replace(" ", "_") for r in order]
    back = artefacts.load_text(spark, path)
    assert isinstance(back, Embedding)
    got = {(r.kind, r.name): r.syn0 for r in back.items.collect()}
    assert len(got) == 10
    for _, k, n, _, _, v in rows:
        assert np.allclose(got[(k, n if k == "word" else n.replace("_", " "))], v, atol=1e-3)
    assert [r.kind for r in back.items.orderBy("idx").collect()] == ["word"] * 6 + ["entity"] * 4


def test_last_line_of_a_name_wins(spark):
    lines = spark.createDataFrame([(0, "2 2"), (1, "a 1.0 2.0"), (2, "ENTITY/b_c 3 4"), (3, "a 5 6")], "pos long, line string")
    got = {(r.kind, r.name): r.syn0 for r in artefacts.parse_text(lines).collect()}
    assert got == {("word", "a"): [5.0, 6.0], ("entity", "b c"): [3.0, 4.0]}


def test_gold_files(spark, tmp_path):
    (tmp_path / "sim.txt").write_bytes(b"Tiger cat 7.35\r\nbook  paper 7.46\r\n")
    rows = datasets.similarity_pairs(datasets.numbered_lines(spark, str(tmp_path / "sim.txt"))).collect()
    assert [tuple(r) for r in rows] == [("Tiger", "cat", 7.35), ("book", "paper", 7.46)]
    (tmp_path / "kore.txt").write_text("Seed A\n\tx\n\ty z\nSeed B\n\tw\n")
    rows = datasets.relatedness_lists(datasets.numbered_lines(spark, str(tmp_path / "kore.txt"))).collect()
    assert sorted(map(tuple, rows)) == [("Seed A", 0, "x"), ("Seed A", 1, "y z"), ("Seed B", 0, "w")]
    (tmp_path / "wiki.txt").write_text("h1\th2\th3\th4\th5\th6\th7\r\n1\tA_b\tx\tC\ty\tz\t0.5\r\n")
    assert [tuple(r) for r in datasets.relatedness_pairs(datasets.numbered_lines(spark, str(tmp_path / "wiki.txt"))).collect()] == [("A b", "C", 0.5)]


def test_reuters(spark, tmp_path):
    story = lambda split, topics, body: f'<REUTERS TOPICS="YES" LEWISSPLIT="{split}"><TOPICS>{"".join(f"<D>{t}</D>" for t in topics)}</TOPICS><TEXT><TITLE>T</TITLE><BODY>{body}</BODY></TEXT></REUTERS>\n'
    (tmp_path / "a.sgm").write_text(story("TRAIN", ["earn"], "one") + story("TEST", ["acq"], "two") + story("TRAIN", ["earn", "acq"], "no") + story("TRAIN", ["cocoa"], "no"))
    rows = datasets.reuters_r8(spark, str(tmp_path), dev_size=0.0).collect()
    assert sorted((r.text, r.label, r.fold) for r in rows) == [("T\none", 2, "train"), ("T\ntwo", 0, "test")]


def test_entity_linker(spark, store, tmp_path):
    links = store.links().withColumn("text", F.lower("text"))
    low = store.paragraphs.withColumn("text", F.lower("text"))
    linker = EntityLinker.build(low, links, store.titles(), store.redirects, LinkerParams(min_link_prob=0.0, min_prior_prob=0.0))
    linker.save(str(tmp_path / "el"))
    linker = EntityLinker.load(spark, str(tmp_path / "el"))
    docs = spark.createDataFrame([(1, "the tower of nippon is in tokyo")], "doc_id int, text string")
    got = {(r.name, r.title) for r in linker.detect(docs, ["doc_id"]).collect()}
    assert {("tower", "Tokyo Tower"), ("tower", "Tower"), ("nippon", "Japan"), ("tokyo", "Tokyo")} <= got
    assert linker.params.min_prior_prob == 0.0


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from corpuscle.operators.dictionary import count_in_documents, paragraph_words

    src = str(tmp_path / "in")
    rows = [(i, f"the web number {i % 3} is here today\nshort one") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    stream_word_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, merged_counts(spark.read.parquet(str(tmp_path / "out")).drop("batch")).collect()))
    para = spark.read.parquet(src).select(F.col("doc_id").alias("title"), F.explode(F.split("text", "\n")).alias("text"))
    assert got == sorted(map(tuple, count_in_documents(paragraph_words(para), "word").collect()))
