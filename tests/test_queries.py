"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuscle.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        path = f"{data}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, db, name):
    out = catalogue.QUERIES[name](spark, data)
    got = sorted([plain(r[c]) for c in sorted(out.columns)] for r in out.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = db.sql(catalogue.ORACLES[name])
    cols = rel.columns
    assert sorted(cols) == sorted(out.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == sorted([plain(r[i]) for i in order] for r in rel.fetchall())


def test_training_takes_everything(spark, data, monkeypatch):
    """The training query trains on every paragraph and link, with link-graph pairs and detected mentions."""
    seen = []
    whole = catalogue.E.train

    def spy(paragraphs, links, dictionary, graph=None, mentions=None, params=None, keys=None, **rest):
        seen.append((paragraphs.count(), links.count(), graph is not None and graph.edges.count(), mentions is not None and mentions.detect(paragraphs, keys).count()))
        return whole(paragraphs, links, dictionary, graph, mentions, params, keys, **rest)

    monkeypatch.setattr(catalogue.E, "train", spy)
    assert catalogue.QUERIES["train_smoke"](spark, data).count() > 0
    p, k, edges, found = seen[0]
    assert (p, k) == (catalogue.X.paragraphs(spark, data).count(), catalogue.X.page_links(spark, data).count())
    assert edges > 0 and found > 0


def test_entry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalogue.QUERIES) <= set(q)


def test_pages_are_parsed_on_every_core(spark, data):
    """A table of one split is dealt out before it is parsed."""
    assert catalogue.X.table(spark, data, "part").rdd.getNumPartitions() < 4
    assert catalogue.X.wiki_strings(spark, data).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
