import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions.titles import is_redirect
from corpuscle.operators import classify, dictionary as D, evaluate as Q, graph as G, mentions as N, training as E, vectors as V
from corpuscle.params import DictionaryParams, MentionParams, TrainParams

PARAS = [("p1", 0, "The web is a web service, the Web."), ("p1", 1, "too short"), ("p2", 0, "The World Wide Web and the web of things are here"), ("p3", 0, "A b c d e")]
LINKS = [("p1", 0, "World Wide Web", "web", 4, 7), ("p1", 1, "Short", "short", 4, 9), ("p2", 0, "WWW", "web", 26, 29), ("p2", 0, "Category:X", "x", 0, 1), ("p2", 0, "A#b", "c", 0, 1), ("p3", 0, "Dis", "Web", 0, 3), ("p1", 0, "p2", "The", 0, 3)]
REDIRECTS = [("WWW", "World Wide Web"), ("nothing", "nowhere")]


@pytest.fixture(scope="module")
def tables(spark):
    p = spark.createDataFrame(PARAS, "title string, para_no int, text string")
    k = spark.createDataFrame(LINKS, "title string, para_no int, target string, text string, start int, end int")
    return p, k, spark.createDataFrame(REDIRECTS, "src string, dst string"), spark.createDataFrame([("Dis",)], "title string")


@pytest.fixture(scope="module")
def built(tables):
    return D.Dictionary.build(*tables, params=DictionaryParams(min_word_count=1, min_entity_count=1))


def test_dictionary(built):
    words = {r.text: (r["count"], r.doc_count) for r in built.words.collect()}
    assert words["web"] == (5, 2) and words["the"] == (4, 2) and "too" not in words and "short" not in words
    ents = {r.title: (r["count"], r.doc_count) for r in built.entities.collect()}
    assert ents == {"World Wide Web": (2, 2), "Short": (1, 1), "p2": (1, 1)}
    assert [r.idx for r in built.items().orderBy("idx").collect()] == list(range(len(built))) and built.entity_offset == built.word_size
    assert [r.text for r in built.words.orderBy("idx").collect()] == sorted(words)
    assert built.get_word("nope") is None and built.get_word_index("nope") == -1 and built.get_entity("nope") is None
    assert built.get_entity("WWW").title == "World Wide Web" and built.get_entity("WWW", resolve_redirect=False) is None
    assert built.get_entity_index("nothing") == -1
    assert built.get_item_by_index(built.get_word_index("web")).name == "web"
    for f in (built.get_item_by_index, built.get_word_by_index, built.get_entity_by_index):
        with pytest.raises(KeyError):
            f(10_000)


def test_dictionary_filters(tables):
    d = D.Dictionary.build(*tables, params=DictionaryParams(min_word_count=2, min_entity_count=2, category=True, disambi=True, lowercase=False))
    assert {r.title for r in d.entities.collect()} == {"World Wide Web"} and {r.text for r in d.words.collect()} == {"web", "The", "the", "Web"}
    d = D.Dictionary.build(*tables, params=DictionaryParams(min_entity_count=1, category=True, disambi=True))
    assert {r.title for r in d.entities.collect()} == {"World Wide Web", "Short", "p2", "Category:X", "Dis"}
    d = D.Dictionary.build(*tables, params=DictionaryParams(min_entity_count=0))
    assert "nowhere" in {r.title for r in d.entities.collect()}


def fold_naive(counts, red):
    c = dict(counts)
    for src in sorted(red, key=lambda s: s.encode()):
        if src in c:
            c[red[src]] = c.get(red[src], 0) + c[src]
            del c[src]
    return {k: v for k, v in c.items() if v}


def test_redirect_fold_is_the_ordered_pass(spark):
    rng = random.Random(0)
    for _ in range(4):
        names = [f"t{i}" for i in range(14)]
        red = {s: rng.choice(names) for s in rng.sample(names, 9)}
        counts = {n: rng.randrange(1, 9) for n in rng.sample(names, 10)}
        df = spark.createDataFrame([(k, v, 1) for k, v in counts.items()], "title string, count long, doc_count long")
        got = {r.title: r["count"] for r in D.fold_redirects(df, spark.createDataFrame(list(red.items()), "src string, dst string")).collect()}
        assert got == fold_naive(counts, red)


def test_resolve_redirects(spark):
    red = [(f"a{i}", f"a{i + 1}") for i in range(14)] + [("x", "y"), ("y", "x"), ("s", "s")]
    r = spark.createDataFrame(red, "src string, dst string")
    t = spark.createDataFrame([(x,) for x in ("a0", "a10", "x", "s", "free")], "title string")
    assert {q.title: q.resolved for q in D.resolve_redirects(t, r).collect()} == {"a0": "a10", "a10": "a14", "x": "x", "s": "s", "free": "free"}
    assert {q.title: q.is_redirect for q in D.mark_redirects(t, r).collect()}["free"] is False
    assert [q[0] for q in t.limit(1).select(is_redirect(F.lit(None).cast("string"))).collect()] == [False]


def test_graph(tables, built):
    p, k, _, _ = tables
    k = k.withColumn("title", F.when(F.col("title") == "p1", "WWW").otherwise(F.col("title")))
    g = G.LinkGraph.build(k, built)
    ix = {r.title: r.idx for r in built.entities.collect()}
    edges = {(r.src, r.dst) for r in g.edges.collect()}
    assert edges == {(b, a) for a, b in edges} and (ix["World Wide Web"], ix["World Wide Web"]) in edges
    assert g.neighbor_indices(ix["p2"]) == [ix["World Wide Web"]] and g.neighbor_indices(10_000) == []
    assert {r.title for r in g.neighbors(ix["World Wide Web"]).collect()} == {"Short", "World Wide Web", "p2"}


def test_mention_table_and_lookup(spark, tables, built):
    p, k, _, _ = tables
    db = N.MentionDB.build(p, k, built, MentionParams(min_link_prob=0.0, min_prior_prob=0.0))
    rows = {r.name: r for r in N.with_probabilities(db.mentions).collect()}
    assert rows["web"].link_count == 2 and rows["web"].doc_count == 2 and rows["web"].link_prob == 1.0 and "short" in rows
    assert [r.name for r in db.query("WEB").collect()] == ["web"]
    with pytest.raises(KeyError):
        db.query("nope")
    df = spark.createDataFrame([(1, "this is a web service")], "id int, text string")
    assert [r.name for r in db.prefix_search(df, start=10).collect()] == ["web"] and db.prefix_search(df, start=0).count() == 0
    got = db.detect(df, ["id"]).collect()
    assert [(r.text, r.start, r.end) for r in got] == [("web", 10, 13)]


def test_probabilities(spark):
    r = N.with_probabilities(spark.createDataFrame([(5, 10, 100), (5, 4, 0)], "link_count long, total_link_count long, doc_count long")).collect()
    assert (r[0].link_prob, r[0].prior_prob, r[0].commonness) == (0.1, 0.5, 0.5) and (r[1].link_prob, r[1].prior_prob) == (0.0, 1.0)


def test_greedy_longest_match(spark):
    import re

    rng = random.Random(1)
    names = {" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(8)} | {"a-b"}
    docs = [(i, " ".join(rng.choice(["a", "b", "ab", "a-b"]) for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(docs, "id int, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {}
    for r in N.longest_matches(N.token_spans(df, ["id"], 20), n, ["id"]).collect():
        got.setdefault(r.id, set()).add((r.start, r.end))
    for i, text in docs:
        cur, want = 0, set()
        tok = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        ends = {e for _, e in tok}
        for s, _ in tok:
            if s >= cur:
                e = max((s + len(x) for x in names if text.startswith(x, s) and s + len(x) in ends), default=None)
                if e:
                    want.add((s, e))
                    cur = e
        assert got.get(i, set()) == want


def test_ambiguous_names_take_their_span(spark):
    m = spark.createDataFrame([("a b", "X", 1, 2, 2), ("a b", "Y", 1, 2, 2), ("a", "Z", 1, 1, 1), ("c", "W", 1, 1, 1)], "name string, entity_idx string, link_count long, total_link_count long, doc_count long")
    db = N.MentionDB(m, None, {"build_params": vars(MentionParams())})
    df = spark.createDataFrame([("p", "A b c a")], "id string, text string")
    assert sorted((r.text, r.entity_idx) for r in db.detect(df, ["id"]).collect()) == [("a", "Z"), ("c", "W")]
    here = spark.createDataFrame([("p", "Y")], "page string, entity_idx string")
    assert sorted((r.text, r.entity_idx) for r in db.detect(df, ["id"], here, "id").collect()) == [("A b", "Y"), ("a", "Z"), ("c", "W")]
    both = spark.createDataFrame([("p", "Y"), ("p", "X")], "page string, entity_idx string")
    assert len(db.detect(df, ["id"], both, "id").collect()) == 2


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    x[7] = 0
    items = spark.createDataFrame([(i, "word", f"w{i}", i, v.tolist()) for i, v in enumerate(x)], "idx long, kind string, name string, count long, syn0 array<float>")
    norm = np.linalg.norm(x, axis=1)
    s = x.astype(float) @ x[3] / np.where(norm == 0, 1, norm) / norm[3]
    order = [i for i in np.argsort(-s, kind="stable") if i != 7]
    got = V.most_similar(items, 3, 10).collect()
    assert [r.idx for r in got] == order[:10] and np.allclose([r.score for r in got], s[order[:10]])
    low = V.most_similar(items, 3, 40, 20).collect()
    assert all((r.score == -100) == (r.idx < 20 and r.idx != 7) for r in low) and low[-1].score is None
    batch = V.batch_similar(items.where("idx in (3, 5)"), items, 10, query_block=1).where("query_idx = 3").orderBy("rank").collect()
    assert [r.idx for r in batch] == order[:10]
    e = V.Embedding(items)
    assert np.allclose(e.get_word_vector("w3"), x[3]) and np.allclose(e.get_vector(4), x[4])
    with pytest.raises(KeyError):
        e.get_entity_vector("w3")


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_evaluation(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 2.0, 5.0), (1, 9.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 2.0)]
    out = {r.g: r.rho for r in Q.spearman(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ["g"]).collect()}
    assert np.isclose(out[1], np.corrcoef(ranks([1, 2, 2, 9]), ranks([2, 2, 5, 1]))[0, 1]) and out[2] is None
    m = Q.classification_metrics(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")).first()
    assert m.accuracy == 0.5 and np.isclose(m.macro_f1, (2 / 3 + 0.5 + 0) / 3)
    assert [r.line for r in Q.report(spark.createDataFrame([("x", 0.12345, 3)], "name string, score double, oov int"), "csv").collect()] == ["x,0.1235,3"]


def test_analogies(spark):
    v = {"king": [1.0, 1.0, 0.0], "man": [1.0, 0.0, 0.0], "woman": [0.0, 0.0, 1.0], "queen": [0.0, 1.0, 1.0], "other": [-1.0, 0.2, 0.0]}
    vocab = Q.analogy_vocabulary(spark.createDataFrame([(k, x, i, i) for i, (k, x) in enumerate(v.items())], "name string, syn0 array<double>, idx int, count int"))
    q = spark.createDataFrame([(1, "man", "king", "woman", "queen"), (2, "man", "king", "nobody", "queen")], "qid long, a string, b string, c string, d string")
    assert tuple(Q.analogy_accuracy(q, vocab).first()) == (1.0, 1, 1)


def test_sampling_and_negatives(spark):
    w = spark.createDataFrame([(i, c) for i, c in enumerate([1, 50, 1000, 5])], "idx int, count long")
    total, c = 1056, np.array([1, 50, 1000, 5])
    t = 0.01 * total
    keep = [r.keep for r in E.sampling_table(w, 0.01).orderBy("idx").collect()]
    assert np.allclose(keep, np.minimum(1, (np.sqrt(c / t) + 1) * t / c) * (2**32 - 1), atol=1)
    assert all(r.keep == 2**32 - 1 for r in E.sampling_table(w, 0).collect())
    share = [r.share for r in E.negative_distribution(w, 0.75).orderBy("idx").collect()]
    assert np.allclose(share, c**0.75 / (c**0.75).sum())
    assert all(r.share == 0.25 for r in E.negative_distribution(w, 0).collect())
    assert np.allclose(E.sigmoid_table(), 1 / (1 + np.exp(-np.linspace(-6, 6, 1001)[:-1])), atol=1e-2)


def test_word_pairs_and_windows(spark):
    tok = spark.createDataFrame([("p", 0, i, i * 2, i * 2 + 1, w) for i, w in enumerate([3, -1, 4, 5, 3, 6])], "title string, para_no int, pos int, start int, end int, word_idx int")
    keys = ["title", "para_no"]
    got = sorted((r.pos, r.ctx) for r in E.word_pairs(tok, keys, 2, fixed_window=True).collect())
    known = [0, 2, 3, 4, 5]
    assert got == sorted((i, j) for i in known for j in known if i != j and abs(i - j) <= 2)
    fresh = {(r.pos, r.ctx) for r in E.word_pairs(tok, keys, 3).collect()}
    assert fresh and fresh == {(r.pos, r.ctx) for r in E.word_pairs(tok.repartition(3), keys, 3).collect()}
    shrink = E.word_pairs(tok, keys, 3, window_mode="shrinking").collect()
    reach = {}
    for r in shrink:
        reach[r.pos] = max(reach.get(r.pos, 0), abs(r.pos - r.ctx))
    assert shrink and max(reach.values()) <= 3


def test_targets_and_anchors(spark, tables, built):
    p, k, _, _ = tables
    keys = ["title", "para_no"]
    tok = E.indexed_tokens(p, built, keys, 5)
    assert {(r.title, r.para_no) for r in tok.collect()} == {("p1", 0), ("p2", 0), ("p3", 0)}
    lengths = p.select(*keys, F.length("text").alias("length"))
    found = spark.createDataFrame([("p1", 0, 0, 7, 99), ("p1", 0, 13, 16, 98)], "title string, para_no int, start int, end int, entity_idx int")
    t = E.target_links(k, found, lengths, built, keys)
    got = {(r.title, r.start, r.end) for r in t.collect()}
    assert ("p1", 13, 16) in got and ("p1", 0, 7) not in got and ("p1", 4, 7) in got
    a = E.anchor_pairs(t.where("title = 'p1' and start = 4"), tok, keys, 2).collect()
    assert sorted(r.ctx for r in a) == [0, 2, 3]


def test_schedules(spark):
    p = spark.createDataFrame([(str(i),) for i in range(10)], "title string")
    rows = E.alpha_schedule(p, F.col("title"), 10, TrainParams(), 4).orderBy("n").collect()
    assert np.isclose(rows[0].alpha, 0.025 * (1 - 40 / 50)) and all(r.alpha >= 0.0001 for r in rows)
    e = spark.createDataFrame([(i,) for i in range(7)], "idx int")
    s = E.link_schedule(e, 10, TrainParams(entities_per_page=3, iteration=2)).collect()
    assert len(s) == 7 * 9 and max(sum(1 for r in s if r.step == k) for k in range(21)) == 3


def test_pair_update_and_batches():
    rng = np.random.default_rng(0)
    a0, a1 = rng.normal(size=(5, 4)).astype(np.float32), rng.normal(size=(5, 4)).astype(np.float32)
    b0, b1 = a0.copy(), a1.copy()
    E.pair_update(a0, a1, 0, 1, [2, 1, 3], 0.1)
    E.batch_update(b0, b1, np.array([0]), np.array([1]), np.array([[2, 1, 3]]), np.array([0.1]))
    assert np.allclose(a0, b0, atol=1e-6) and np.allclose(a1, b1, atol=1e-6)
    big0, big1 = np.full((2, 4), 2, np.float32), np.full((2, 4), 2, np.float32)
    E.pair_update(big0, big1, 0, 1, [], 0.1)
    assert (big0 == 2).all() and (big1 == 2).all()
    s0, s1 = E.init_weights(50, 8, 0)
    x, y = rng.integers(0, 25, 2000), rng.integers(25, 50, 2000)
    before = E.loss(s0, s1, x, y)
    for _ in range(20):
        E.batch_update(s0, s1, x, y, rng.integers(0, 25, (2000, 2)), np.full(2000, 0.01))
    assert E.loss(s0, s1, x, y) < before


def test_training_is_repeatable(spark, tables, built):
    p, k, _, _ = tables
    g = G.LinkGraph.build(k, built)
    db = N.MentionDB.build(p, k, built, MentionParams(min_link_prob=0.0, min_prior_prob=0.0))
    params = TrainParams(dim_size=8, iteration=1, sample=0)
    runs = [{r.name: r.syn0 for r in E.train(p, k, built, g, db, params, partitions=2).items.collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(built)


def test_classification_features_and_model(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    items = spark.createDataFrame([(1, 0, "b", 0.5), (1, 1, "a", 0.25), (1, 2, "b", 1.0), (1, 3, "c", 1.0)], "doc_id int, pos int, item string, prior double")
    v = classify.vocabulary(items, ["doc_id", "pos"], min_count=1)
    assert {r.item: r.id for r in v.collect()} == {"b": 1, "a": 2, "c": 3}
    rows = {r.doc_id: (r.ids, r.prior) for r in classify.sequences(docs, items, v, "doc_id", ["pos"], 3, extra="prior").collect()}
    assert rows == {1: ([1, 2, 1], [0.5, 0.25, 1.0]), 2: ([0, 0, 0], [0.0, 0.0, 0.0])}
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 200)
    words = np.where(label[:, None] == 1, rng.integers(1, 10, (200, 6)), rng.integers(8, 20, (200, 6)))
    ents = rng.integers(0, 5, (200, 3))
    data = {"words": words, "entities": ents, "priors": rng.random((200, 3)), "label": label}
    model = classify.fit(classify.Naboe.init(20, 5, 2, 8), data, data, epochs=15, adam=classify.AdamW(0.02, warmup=5))
    assert (model.forward(words, ents, data["priors"]).argmax(1) == label).mean() > 0.9
    feats = spark.createDataFrame([(i, words[i].tolist(), ents[i].tolist(), data["priors"][i].tolist()) for i in range(20)], "doc_id int, words array<int>, entities array<int>, priors array<double>")
    got = {r.doc_id: r.pred for r in classify.predict(feats, model).collect()}
    assert [got[i] for i in range(20)] == model.forward(words[:20], ents[:20], data["priors"][:20]).argmax(1).tolist()


def test_numbers_and_running_sums_follow_the_order(spark):
    rows = [(i * 7919 % 1000, i % 5, float(i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g long, v double").repartition(7)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    got = D.number_rows(df, ["g", "k"], 10, "n").orderBy("n").collect()
    assert [(r.n, r.g, r.k) for r in got] == [(10 + i, g, k) for i, (k, g, _) in enumerate(want)]
    sums = D.running_sum(df, ["g", "k"], "v", "s").orderBy("g", "k").collect()
    total = 0.0
    for r, (_, _, v) in zip(sums, want, strict=True):
        total += v
        assert abs(r.s - total) < 1e-9


def test_classifier_gradient_is_that_of_the_loss():
    """Every kind of weight against finite differences of the loss."""
    rng = np.random.default_rng(0)
    for use_word in (True, False):
        m = classify.Naboe(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), rng.normal(size=2), 0.3, rng.normal(size=(3, 4)), rng.normal(size=3))
        m.use_word = use_word
        m.words[0] = m.entities[0] = 0
        words, ents = rng.integers(0, 9, (5, 6)), rng.integers(0, 7, (5, 3))
        words[:, 0], ents[:, 0] = 1, 2
        batch = words, ents, rng.random((5, 3)), rng.integers(0, 3, 5)
        _, grads = m.gradients(*batch)
        for name, g in grads.items():
            p = np.array(getattr(m, name), float)
            for at in list(np.ndindex(p.shape))[:60]:
                if name in ("words", "entities") and at[0] == 0:
                    continue
                values = []
                for d in (1e-5, -1e-5):
                    q = p.copy()
                    q[at] += d
                    setattr(m, name, q if q.ndim else float(q))
                    values.append(m.gradients(*batch)[0])
                setattr(m, name, p if p.ndim else float(p))
                assert abs((values[0] - values[1]) / 2e-5 - np.asarray(g)[at]) < 1e-6, (name, at)


def test_changes_of_many_partitions_are_averaged_by_row():
    a = np.arange(12, dtype=float).reshape(3, 4)
    raw = lambda x: x.tobytes()
    part = lambda idx, d: {"which": 0, "block": 0, "idx": raw(np.array(idx)), "met": raw(np.ones(len(idx), np.int64)), "delta": raw(d)}
    out = E._sum_changes((pa.scalar(0), pa.scalar(0)), pa.Table.from_pylist([part([2, 5, 7], a), part([5], a[:1])]))
    assert np.frombuffer(out["idx"][0].as_py(), np.int64).tolist() == [2, 5, 7] and np.frombuffer(out["met"][0].as_py(), np.int64).tolist() == [1, 2, 1]
    assert np.allclose(np.frombuffer(out["delta"][0].as_py(), float).reshape(3, 4), [a[0], a[1] + a[0], a[2]])


def test_best_of_blocks_in_bounded_memory(spark, monkeypatch):
    """Ties go to the smaller index, and a task holds a bounded number of scores however large its blocks are."""
    import tracemalloc

    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, (30, 50)).astype(float)
    row, column, score = V._best(s, 7)
    want = np.argsort(-s, axis=1, kind="stable")[:, :7]
    assert [set(column[row == i]) for i in range(30)] == [set(w) for w in want] and (score == s[row, column]).all()

    class Held:
        def applyInArrow(self, f, schema):  # noqa: N802
            self.f = f
            raise StopIteration

    held = Held()
    monkeypatch.setattr(V, "in_grid", lambda *a: held)
    e = spark.createDataFrame([(1, [1.0])], "idx long, syn0 array<double>")
    with pytest.raises(StopIteration):
        V.batch_similar(e, e, 5)
    table = lambda n: pa.table({"idx": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(rng.normal(size=n * 4), 4).cast(pa.list_(pa.float64()))})
    tracemalloc.start()
    out = held.f(table(2048), table(16384))
    assert tracemalloc.get_traced_memory()[1] < 120e6 and out.num_rows == 2048 * 5
    tracemalloc.stop()


ODD = ["", None, "Straße İstanbul ΑΣ ΑΣΑ", "a", "Web of the web, THE web of things", "x" * 300 + " web", "日本語 web の web。 𝔘𝔫𝔦 web 😀web", "ÀÉ é web\tweb-web web_web 12 ١٢ web", "one", " the web ", "Ⅷ ⅷ ǅ web ß"] * 3
GENERAL = r"(?:[\p{L}\p{N}_]+)"  # the same tokens as the built-in rule, by way of the plan for any rule


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [(i // 2 % 7, i, t) for i, t in enumerate(ODD)] + [(None, 99, "null web"), (None, 98, "null web"), (1, 97, " ".join(rng.choice(["the", "Web", "é", "of"]) for _ in range(500)))]
    return spark.createDataFrame(rows, "doc long, para_no int, text string").repartition(3)


def test_kernels_find_the_tokens_and_counts_of_the_general_plan(odd):
    from corpuscle.functions.text import Tokenizer, regexp_tokens

    every = lambda df: sorted(map(str, df.collect()))
    for least in (1, 3):
        want = D.count_in_documents(D.paragraph_words(odd, "doc", min_paragraph_len=least), "word")
        assert every(D.word_counts(odd, "doc", min_paragraph_len=least)) == every(want)
        assert every(D.word_counts(odd, "doc", min_paragraph_len=least, lowercase=False)) == every(D.count_in_documents(D.paragraph_words(odd, "doc", lowercase=False, min_paragraph_len=least), "word"))
    assert every(regexp_tokens(odd, ["para_no"])) == every(regexp_tokens(odd, ["para_no"], rule=GENERAL))
    assert Tokenizer().scanner() and not Tokenizer(GENERAL).scanner()


def test_tokens_of_a_document_are_not_shuffled_one_by_one(odd):
    from corpuscle.functions.text import regexp_tokens

    assert "Exchange" not in regexp_tokens(odd.coalesce(1), ["para_no"])._jdf.queryExecution().executedPlan().toString().split("Coalesce")[0]
    plan = D.word_counts(odd, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_spans_are_dropped_where_they_are_made(spark, odd):
    """Counts and mentions are those of the plan that lists all spans, and only likely names leave the kernel."""
    from corpuscle.functions.text import Tokenizer

    names = spark.createDataFrame([("web",), ("the web",), ("of the web",), ("é",), ("web_web 12",), ("i̇stanbul",), ("straße",), ("no such",), ("web",), (None,), ("ασ",), ("日本語 web の web",), ("web。",)], "name string")
    every = lambda df: sorted(map(str, df.collect()))
    for fold in (False, True):
        got = N.name_document_counts(odd, names, "doc", ["doc", "para_no"], 20, fold)
        assert every(got) == every(N.name_document_counts(odd, names, "doc", ["doc", "para_no"], 20, fold, Tokenizer(GENERAL)))
        few, all_spans = N.name_spans(odd, ["para_no"], names, 20, fold), N.token_spans(odd, ["para_no"], 20, fold, tokenizer=Tokenizer(GENERAL))
        keep = lambda df: df.join(names.distinct(), "name", "left_semi").select("para_no", "start", "end", "name")
        assert every(keep(few)) == every(keep(all_spans)) and 0 < few.count() <= keep(all_spans).count() + 5 < all_spans.count()


def test_filter_of_many_names_lets_all_through(spark):
    names = spark.range(5000).selectExpr("concat('n', id, ' x') as name")
    docs = spark.range(5000).selectExpr("id", "concat('a n', id, ' x b') as text")
    got = N.name_document_counts(docs, names, "id", ["id"], 20)
    assert got.count() == 5000 and got.where("doc_count <> 1").isEmpty()


def test_packed_paragraphs_give_the_pairs_of_token_rows(spark, odd, monkeypatch):
    """Pairs, draws, anchors and places from lists of a paragraph are those from a row for each token."""
    from corpuscle.functions.text import sentences

    every = lambda df: sorted(map(str, df.collect()))
    p, keys = odd.where("doc is not null"), ["doc", "para_no"]
    words = D.dense_index(D.word_counts(p, "doc", min_paragraph_len=1), "word").select("idx", F.col("word").alias("text"), "count", "doc_count").where("idx % 5 <> 3").localCheckpoint()
    d = D.Dictionary(words, words.limit(0), words.limit(0), {"word_size": words.count(), "entity_size": 0, "lowercase": True})
    rows, tok = E.indexed_tokens(p, d, keys, 3), E.packed_tokens(p, d, keys, 3)
    flat = tok.select(*keys, F.posexplode(F.arrays_zip("start", "word_idx")).alias("pos", "t")).select(*keys, "pos", "t.start", "t.word_idx")
    assert every(flat) == every(rows.select(*keys, "pos", "start", "word_idx"))
    keep = E.sampling_table(d.words, 0.01)
    cut = sentences(p, keys)
    for a, b in ((rows, tok), (E.sentence_of(rows, cut, keys, "start"), E.sentence_of(tok, cut, keys, "start"))):
        for kept in (None, keep):
            for fixed, mode in ((True, "fresh"), (False, "fresh"), (False, "shrinking")):
                want = every(E.word_pairs(a, keys, 3, kept, 11, fixed, mode))
                assert want and every(E.word_pairs(b, keys, 3, kept, 11, fixed, mode)) == want
        assert every(E.pair_counts(b, keys, 2)) == every(E.word_pairs(a, keys, 2, fixed_window=True).groupBy("src", "dst").agg(F.count("*").alias("n")))
    targets = p.where("length(text) > 12").select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 3), (7, 7), (5, 12), (400, 900))])).alias("t")).select(*keys, "t.start", "t.end", F.lit(4).alias("entity_idx"))
    for kept in (None, keep):
        assert every(E.anchor_pairs(targets, tok, keys, 2, kept)) == every(E.anchor_pairs(targets, rows, keys, 2, kept))
    from corpuscle.functions.text import regexp_tokens

    places = p.where("length(text) > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.length("text"))).alias("at"))
    assert every(E.char_to_token(places, E.packed_tokens(p, None, keys), keys, "at", "tok")) == every(E.char_to_token(places, regexp_tokens(p, keys), keys, "at", "tok"))
    plan = E.pair_counts(tok, keys, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan.split("MapInArrow")[1]
    monkeypatch.setattr(E, "HELD_WORDS", 3)  # a dictionary that doesn't go out to tasks
    assert every(E.packed_tokens(p, d, keys, 3)) == every(tok)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from corpuscle.functions import kernels as K

    monkeypatch.setattr(K.Words, "_hashes", staticmethod(lambda words: np.array([len(x) for x in words.to_pylist()], np.uint64)))
    w = K.Words(["aa", "b", "bb", "cc", "dddd"], [7, 8, 9, 10, 11])
    assert w.find(pa.array(["cc", "aa", "bb", "xx", "b", "", "dddd", "eeeeee"])).tolist() == [10, 7, 9, -1, 8, -1, 11, -1]


def test_training_deals_paragraphs_and_draws_their_pairs_in_place(spark, odd):
    """One row a paragraph goes to training; the pairs drawn there are those of the token rows, with their page's rate."""
    p, keys = odd.where("doc is not null"), ["doc", "para_no"]
    words = D.dense_index(D.word_counts(p, "doc", min_paragraph_len=1), "word").select("idx", F.col("word").alias("text"), "count", "doc_count").localCheckpoint()
    d = D.Dictionary(words, words.select("idx", F.col("text").alias("title"), "count", "doc_count").limit(0), spark.createDataFrame([], "src string, entity_idx int"), {"word_size": words.count(), "entity_size": 0, "lowercase": True})
    links = spark.createDataFrame([], "doc long, para_no int, target string, text string, start int, end int")
    params = TrainParams(sample=0.01, window=3, min_paragraph_len=3)
    rows = E.training_rows(p, links, d, None, None, params, 0, keys)
    tok = E.indexed_tokens(p, d, keys, 3)
    assert rows.count() == tok.select(*keys).distinct().count()
    keep = E.sampling_table(words, 0.01)
    got = [r for pdf in E._drawn(iter(rows.toArrow().combine_chunks().to_batches()), 3, E._held_keep(keep)) for r in pdf.itertuples(index=False)]
    pages = E.alpha_schedule(p.select("doc").distinct(), F.xxhash64(F.lit(0), "doc"), p.select("doc").distinct().count(), params, 0, "doc")
    want = E.word_pairs(tok, keys, 3, keep, 0).select("doc", "src", "dst", F.xxhash64(F.lit(0), *keys, "pos", "ctx").alias("key")).join(pages, "doc").select("src", "dst", "alpha", "key").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
