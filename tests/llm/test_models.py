import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuscle.llm import html, langid, lm, quality, toxicity
from corpuscle.llm.crf import Chains, Crf
from corpuscle.llm.labelled import training_sample
from corpuscle.llm.toxicity import noisy_or

from .cases import empty, frame, prose, texts


def part(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    n1 = (y == 1).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


# the conditional random field against sums over all label sequences


def all_labels(crf, u):
    scores, seqs = [], list(itertools.product((0, 1), repeat=len(u)))
    for y in seqs:
        s = crf.start[y[0]] + sum(u[i] for i, k in enumerate(y) if k) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))
        scores.append(s)
    return seqs, np.array(scores)


def test_nearest_names_count_on_deep_pages():
    """Names on outer wrappers, however many, don't push out those of the nearest ancestors."""
    prose_ = "Soko rine tula meso diver anba kori netu laso medi verthan bako rine tula, meso diver anba kori netu laso."
    body = '<div class="entry-content"><h1>Bako rine</h1>' + f"<p>{prose_}</p>" * 4 + '</div><div class="comments">' + f'<div class="comment"><p>Comment {prose_}</p></div>' * 3 + "</div>"
    wrappers = [" ".join("wp" + a + b for b in "abcdefghijklmno") for a in "abc"]
    deep = "".join(f'<div class="{w}">' for w in wrappers) + body + "</div>" * 3
    got = html.extract(html.train(), f"<html><body>{deep}</body></html>")
    assert got.count("Soko") == 4 and "Comment" not in got


def test_crf_marginals_and_viterbi():
    rng = np.random.default_rng(0)
    crf = Crf(1)
    crf.trans, crf.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 0, 1, 6, 2, 6])
    u = rng.normal(size=lengths.sum()) * 2
    chains = Chains(lengths)
    marginal, pairs, first = crf.marginals(u, chains, expect=True)
    best = crf.viterbi(u, chains)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        if n:
            seqs, s = all_labels(crf, u[at : at + n])
            p = np.exp(s - s.max())
            p /= p.sum()
            want = np.array([sum(q for q, y in zip(p, seqs) if y[i]) for i in range(n)])
            assert np.allclose(marginal[at : at + n], want)
            assert tuple(best[at : at + n]) == seqs[int(s.argmax())]
            for q, y in zip(p, seqs):
                for a, b in zip(y, y[1:]):
                    want_pairs[a, b] += q
        at += n
    assert np.allclose(pairs, want_pairs) and np.isclose(first.sum(), (lengths > 0).sum())


def test_crf_learns_a_chain():
    rng = np.random.default_rng(1)
    y = np.repeat(rng.integers(0, 2, 200), 10)
    x = np.where(rng.random(2000) < 0.75, y, 1 - y)[:, None]
    crf = Crf(2).fit(x, Chains(np.full(20, 100)), y, steps=80)
    true = Crf(2)
    true.w, true.trans = np.array([-1.0, 1.0]) * np.log(3), np.log(np.array([[0.95, 0.05], [0.05, 0.95]]))
    right = lambda m: (m.viterbi(m.unary(x), Chains(np.full(20, 100))) == y).mean()
    assert right(crf) > right(true) - 0.01 > (x[:, 0] == y).mean()


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<header class="site-header"><p>Site name here</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this page.</p><button>OK</button></div>
<article><h1>The &amp; title</h1><p>First   paragraph of\n the story, with <b>bold</b> text&nbsp;and a long enough sentence to read.</p>
<div class="ad">Buy this thing now.</div><p>Second one &lt;here&gt; &eacute; goes on for some words more, as stories do.</p>
<form><label>Your mail</label><input><button>Send</button></form></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this story very much, thanks for it.</p></div></section>
<footer>&copy; 2020 Somebody</footer></body></html>"""


def test_html_article_only():
    model = html.train(html.labelled_pages(250))
    assert html.extract(model, PAGE) == "The & title\n\nFirst paragraph of the story, with bold text and a long enough sentence to read.\n\nSecond one <here> é goes on for some words more, as stories do."
    wrong = total = 0
    for blocks, labels in html.labelled_pages(60, seed=5):
        got = model.viterbi(model.unary(html.features(blocks)), Chains(np.array([len(blocks)])))
        wrong, total = wrong + int((got != np.array(labels)).sum()), total + len(labels)
    assert wrong / total < 0.03
    for broken in ("", "<", "<p", "<!-- x", "<p>a</b></p></p>", "<a href='x>y", "&am", "<script>x", "<" * 3000, "</div>" * 50, "<div>" * 3000 + "x"):
        assert isinstance(html.extract(model, broken), str)


def test_html_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "no tags", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = html.train(html.labelled_pages(60))
    out = html.extract_pages(df, model).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 2] == [""] and html.extract_pages(df.limit(0), model).count() == 0


# language identification


def test_langid(spark):
    de = "und die der das nicht ein schön über straße mit auf ist".split()
    fr = "les des et une dans pour être où même que qui sur".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(de if i % 2 else fr, 12)), "de" if i % 2 else "fr", f"s{i}") for i in range(200)]
    edge = [(500, None, "de", None), (501, "", "fr", None), (502, "123 !?", "fr", None), (None, "und die der", "fr", None), (503, "les des " * 20000, None, None), (504, "ß", None, None)]
    df = spark.createDataFrame(rows + edge + edge[:1], "doc_id long, text string, lang string, letter string")
    out = langid.identify_held_out(df).collect()
    assert len(out) == len(rows) + 7
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows) and all(got[i].held_out == (part(i, 4) == 2) for i, *_ in rows)
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "fr"] and got[None].held_out is None
    assert all(0 <= r.score <= 1 for r in out) and langid.identify_held_out(df.limit(0)).count() == 0


def test_all_evidence_decides_the_language(spark):
    """Many n-grams of slight evidence outweigh a skewed prior, though the score counts but MAX_EVIDENCE of them."""
    logp = np.full((len(langid.ORDERS) << langid.BITS, 2), -1.0, np.float32)
    logp[:, 1] = -0.99
    model = langid.LanguageModel(["aa", "bb"], logp, np.log([0.99, 0.01]))
    out = {r.doc_id: r for r in langid.identify(frame(spark, [(1, "abc def " * 500), (2, "abc")]), model).collect()}
    assert out[1].lang_pred == "bb" and 0 < out[1].score < 0.5
    assert out[2].lang_pred == "aa" and out[2].score > 0.5


def bucket(gram, bits):
    h = len(gram) * 0x3C6EF35F & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits


def bayes(rows, bits):
    """Naive Bayes over hashed character n-grams in plain Python: (learned from, text) -> (language, score)."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    grams = lambda t: [(n, bucket(t[i : i + n], bits)) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)]
    counts, docs = {}, {}
    for i, t, lang in rows:
        if i is not None and lang is not None and part(i, 4) != 2:
            docs[lang] = docs.get(lang, 0) + 1
            c = counts.setdefault(lang, {})
            for g in grams(lower(t)):
                c[g] = c.get(g, 0) + 1
    total = {(lang, n): sum(v for g, v in c.items() if g[0] == n) for lang, c in counts.items() for n in (1, 2, 3, 4)}

    def predict(t):
        if not t or not re.search(r"[^\W\d_]", t) or not docs:
            return "und", 0.0
        gs = grams(lower(t))
        prior = {lang: math.log(n / sum(docs.values())) for lang, n in docs.items()}
        s = {lang: sum(math.log((counts[lang].get(g, 0) + 0.5) / (total[lang, g[0]] + 0.5 * 2**bits)) for g in gs) for lang in docs}
        best = max(sorted(docs), key=lambda x: s[x] + prior[x])
        scaled = {x: s[x] * min(1, 60 / len(gs)) + prior[x] for x in docs}
        top = max(scaled.values())
        return best, math.exp(scaled[best] - top) / sum(math.exp(v - top) for v in scaled.values())

    return predict


def test_langid_is_naive_bayes_by_hand(spark):
    rng = np.random.default_rng(11)
    words = {"el": "και το της με για είναι στην από".split(), "ru": "и в не на что по это как".split(), "zh": "的 是 不 了 我们 他们 在 有".split(), "en": "the of and to in is that it".split(), "x": "𝔞𝔟 😀 ä b̈ ß".split()}
    rows = [(i, " ".join(rng.choice(words[k], int(rng.integers(1, 30)))), k) for i, k in enumerate(list(words) * 24)]
    rows += [(900, None, "en"), (901, "", "ru"), (902, "12 ...", "ru"), (903, "the и το 的 " * 40, None), (904, "THE OF", "en"), (904, "THE OF", "en"), (None, "the", "ru")]
    predict = bayes(rows, langid.bits_for(5))
    out = langid.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    want = sorted((str(i), *predict(t)) for i, t, _ in rows)
    for (i, lang, p), r in zip(want, sorted(out, key=lambda r: (str(r.doc_id), r.lang_pred, r.score)), strict=True):
        assert (i, lang) == (str(r.doc_id), r.lang_pred) and abs(p - r.score) < 1e-4


def test_langid_of_many_languages(spark):
    """600 languages, each with an alphabet of its own: none is refused, all are told apart, the matrix keeps its bound."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(600):
        letters = [chr(0x4E00 + 10 * k + j) for j in range(10)]
        rows += [(k * 4 + j, " ".join("".join(rng.choice(letters, 3)) for _ in range(20)), f"l{k}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 600 and model.logp.nbytes <= langid.MATRIX_BYTES
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows]) > 0.99


def test_scores_in_pieces(monkeypatch):
    """Pieces that end inside texts and at their ends give the same sums."""
    raw = ["abcd", "", "é", "a", "some more words here", ""]
    enc = [t.encode() for t in raw]
    buf, offs = np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in enc])])
    logp = np.random.default_rng(1).normal(size=(len(langid.ORDERS) << 8, 3)).astype(np.float32)
    whole, n = langid.gram_scores(buf, offs, logp, 8)
    for piece in (3, 6, 12, 30):
        monkeypatch.setattr(langid, "PIECE", piece)
        cut, m = langid.gram_scores(buf, offs, logp, 8)
        assert np.allclose(whole, cut) and (n == m).all()
    assert list(n) == [10, 0, 1, 1, sum(20 - k for k in range(4)), 0]


def test_characters_are_code_points():
    ts = ["aBc", "", "é😀", "日本", "\x00 z"]
    raw = [t.encode() for t in ts]
    code, offs = langid.characters(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [[chr(c) for c in code[a:b]] for a, b in zip(offs, offs[1:])] == [list(t.replace("B", "b")) for t in ts]


# language model


def test_lm_base_is_exact_and_model_is_better(spark):
    rng = np.random.default_rng(4)
    states = [[f"w{s}{k}" for k in range(8)] for s in range(4)]
    rows = [(i, " ".join(states[(i + j) % 4][rng.integers(8)] for j in range(60))) for i in range(400)] + [(i + 1000, t) for i, t in texts() if i is not None]
    rows += [(None, "w00 unknown"), (2000, None), (2001, "A\tb \r c"), (2001, "A\tb \r c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    out = lm.score_texts(df).collect()
    tok = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]
    count = {}
    for i, t in rows:
        if i is not None and part(i, 7) != 2:
            for w in tok(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(((str(i), len(tok(t)), sum(w in count for w in tok(t)), round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == (None if r.doc_id is None else part(r.doc_id, 7) == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    assert lm.score_texts(df.limit(0)).count() == 0


def small_lm(spark, n=60):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[(i + j * int(rng.integers(1, 3))) % 30] for j in range(25))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, docs, docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")


def test_lm_score_is_the_softmax_by_hand(spark):
    """Every token's probability recomputed in plain Python from the trained weights; over all words and one unknown in each slot they sum to one."""
    rows, docs, train = small_lm(spark)
    counts = train.mapInArrow(lm._count, "h long, shape int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))
    n_tokens, n_types = counts.agg(F.sum("c"), F.count("*")).first()
    v, m, norm = lm._model(train, counts, n_tokens, n_types, lm.ROUNDS, lm.TOP)
    got = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    out = lambda z: [math.exp(x) / sum(map(math.exp, z)) for x in z]
    count = dict(zip(v.h.tolist(), v.count.tolist()))
    for i, text in rows[:12]:
        raw = np.frombuffer(text.encode(), np.uint8)
        h, shape, lead = lm.tokens(raw, np.array([0, len(raw)]))
        x = lm.history(h, lead)
        total = 0.0
        for t in range(len(h)):
            f = [int(lm.rows(x[:, t : t + 1], m.bits)[k, 0]) for k in range(lm.FEATURES)]
            by_class = out([float(m.bias[0][c]) + sum(float(m.w[0, r, c]) for r in f) for c in range(lm.CLASSES)])
            by_leaf = {}
            for c in range(lm.CLASSES):
                g = [int(lm.rows(x[:, t : t + 1], m.bits, np.array([c]))[k, 0]) for k in range(lm.FEATURES)]
                for s, p in enumerate(out([float(m.bias[1][c, s]) + sum(float(m.w[1, r, s]) for r in g) for s in range(lm.SLOTS)])):
                    by_leaf[c * lm.SLOTS + s] = by_class[c] * p
            if t == 0:
                inside = {}
                for w, u in zip(v.h.tolist(), range(len(v.h))):
                    inside[int(m.leaf[u])] = inside.get(int(m.leaf[u]), 0) + (count[w] + 1) / 10 ** norm[m.leaf[u]]
                unknown = sum(p / 10 ** norm[k] for k, p in by_leaf.items())
                assert abs(sum(p * inside.get(k, 0) for k, p in by_leaf.items()) + unknown - 1) < 1e-5
            unit = int(v.units(h[t : t + 1], shape[t : t + 1])[0])
            leaf = int(m.leaf[unit])
            total += math.log10(by_leaf[leaf] * (count.get(int(h[t]), 0) + 1) / 10 ** norm[leaf])
        assert abs(total - got[i]) < 1e-4 * abs(total)


def test_lm_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    m = lm.Maxent(rng.integers(lm.CLASSES * lm.SLOTS, size=50), rng.normal(size=lm.CLASSES), rng.normal(size=(lm.CLASSES, lm.SLOTS)), 6)
    m.w = rng.normal(size=m.w.shape)  # in double precision
    h, lead = rng.integers(1, 2**62, 40, dtype=np.uint64), np.array([0, 15, 40])
    parts = h, lead, rng.integers(50, size=40)
    g, seen = np.zeros(m.w.shape), np.zeros(m.w.shape)
    m.gradient(*parts, g)
    m.counts(*parts, seen)
    assert seen.sum() == 2 * lm.FEATURES * 40
    for _ in range(40):
        at = tuple(rng.integers(n) for n in m.w.shape)
        if rng.random() < 0.5:
            at = tuple(np.argwhere(seen)[rng.integers((seen > 0).sum())])
        old = m.w[at]
        m.w[at] = old + 1e-4
        up = m.log_leaf(*parts).sum()
        m.w[at] = old - 1e-4
        down = m.log_leaf(*parts).sum()
        m.w[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3


def test_lm_rounds_use_all_documents(spark, monkeypatch):
    """With counts in place of gradients, the rounds together see what the first pass sees."""
    _, _, train = small_lm(spark)
    counts = train.mapInArrow(lm._count, "h long, shape int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))
    sums, totals = lm._sums, []
    monkeypatch.setattr(lm, "_sums", lambda v, m, gradient: sums(v, m, False))
    monkeypatch.setattr(lm.Maxent, "step", lambda self, total, seen, parts: totals.append((total, seen)))
    lm._model(train, counts, 1000, 31, lm.ROUNDS, lm.TOP)
    assert len(totals) == lm.ROUNDS and (sum(t for t, _ in totals) == totals[0][1]).all()


def test_lm_does_not_depend_on_the_layout(spark):
    """The same rows in 2 and in 16 partitions, with rare words joined or not."""
    docs = frame(spark, texts())
    two, sixteen = ({(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.score_texts(docs.repartition(n)).collect()} for n in (2, 16))
    assert two.keys() == sixteen.keys() and all(abs(two[k] - sixteen[k]) <= 1e-6 * abs(two[k]) for k in two)
    few, every = (sorted(str((r.doc_id, r.n_known, round(r.base_score, 6))) for r in lm.score_texts(docs, top=n).collect()) for n in (5, lm.TOP))
    assert few == every


def test_lm_histories_are_of_one_text():
    f = lm.history(np.array([3, 5, 8, 2], np.uint64), np.array([0, 3, 4]))
    assert (f[:, 0] == f[:, 3]).all()  # both begin a text
    assert len({tuple(c) for c in f.T.tolist()}) == 3


# toxicity and quality


def labelled(spark, n=900):
    rng = __import__("random").Random(6)
    docs, labels = [], []
    for i in range(n):
        lines = [prose(rng, 15) + "." for _ in range(6)]
        toxic, bad = int(i % 5 == 0), int(i % 3 == 0)
        if bad:
            for k in (1, 2, 3, 4):
                lines[k] = " ".join([rng.choice(["buy", "click"])] * 20) if i % 2 else " ".join(w.upper() + "!!" for w in lines[k].split())
        if toxic:
            for _ in range(2):
                k = rng.randrange(6)
                lines[k] = lines[k][:-1] + " " + rng.choice(["idiot", "scum", "vileword", "vilething"]) + " too."
        docs.append((i, "\n".join(lines), toxic, "x"))
        labels.append((i, 1 - bad, toxic, "y"))
    edge = [(9000, None, 0, "x"), (9001, "", 0, "x"), (None, "scum idiot", 0, "x"), (9002, " \n\n ", 0, "x"), (9003, "word " * 30000, 0, "x"), (9003, "word " * 30000, 0, "x")]
    extra = [(9000, 1, 0, "y"), (9001, None, None, "y"), (None, 1, 1, "y"), (123456, 0, 1, "y"), (0, 0, 1, "y")]
    return spark.createDataFrame(docs + edge, "doc_id long, text string, label int, part string"), spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int, text string"), labels


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    got = {r.doc_id: r for r in out}
    held = [(t, got[i].score) for i, _, t, _ in truth if part(i, 5) == 0]
    assert auc(np.array([t for t, _ in held]), np.array([s for _, s in held])) > 0.97
    assert all(r.held_out == (None if r.doc_id is None else part(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert got[9000].score == got[9001].score == got[9002].score == 0 and len(out) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id].encode()[a:b].decode() for r in out if r.doc_id is not None for a, b in zip(r.offending[::2], r.offending[1::2])]
    assert spans and np.mean([bool(re.search("idiot|scum|vile", s)) for s in spans]) > 0.95
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.train(docs.limit(0), labels)).count() == docs.count()


def test_noisy_or():
    z = np.array([-2.0, 0.5, 3.0, -1.0])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(noisy_or(z, np.array([0, 0, 2, 2]), 3), [1 - (1 - p[0]) * (1 - p[1]), 0, 1 - (1 - p[2]) * (1 - p[3])])


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels)
    out = quality.score_quality(docs, model).collect()
    got = {r.doc_id: r for r in out}
    held = [(q, got[i].score) for i, q, _, _ in truth if part(i, 5) == 0]
    assert auc(np.array([t for t, _ in held]), np.array([s for _, s in held])) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out) and len(out) == docs.count()
    assert got[9000].n_lines == 0 and got[9000].score == got[9001].score
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.score >= 0.3 for r in out)
    assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.score_quality(frame(spark, texts()), quality.train(docs, labels.limit(0))).count() == len(texts())


def test_training_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 10 else 100_000)) for i in range(300)] + [(7, "y"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, None), (None, 1), (999, 1)], "doc_id long, quality int")
    whole = training_sample(docs, labels, "quality", 1000).collect()
    assert {r.doc_id for r in whole} == {i for i in range(300) if part(i, 5)} and len(whole) == len({r.doc_id for r in whole}) + bool(part(7, 5))
    assert len({r.doc_id for r in training_sample(docs, labels, "quality", 40).collect()}) <= 40
    few = training_sample(docs, labels, "quality", 1000, max_bytes=50_000).collect()
    assert 45 <= len(few) <= 52 and sum(len(r.text) for r in few) <= 50_000
    assert sorted(map(str, few)) == sorted(map(str, training_sample(docs.repartition(5), labels, "quality", 1000, max_bytes=50_000).collect()))
