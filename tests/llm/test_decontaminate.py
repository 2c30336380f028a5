import hashlib
import re

import numpy as np

from corpuscle.llm import decontaminate
from corpuscle.llm.decontaminate import build_index, contamination, find_passages, keep_clean
from corpuscle.llm.scratch import Scratch

from .cases import empty, frame, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def items():
    base = dict(texts())
    w = base[2].split()
    return [(1, " ".join(w[5:30])), (2, "ONE, two!"), (30, " ".join(base[4].split()[:10])), (3, ""), (4, None), (5, "..."), (None, "word"), (6, "never seen words here"), (7, "é 😀 ÄÖ ß")]


def brute(rows):
    windows = {}
    for i, t in items():
        w = split(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench_items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in items()], "item_id long, text string, hits int")


def test_against_every_window(spark):
    for block in (8 << 20, 60):
        out = contamination(frame(spark, texts()), bench_items(spark), block_bytes=block).collect()
        assert sorted((tuple(r) for r in out), key=str) == brute(texts())


def test_clean_documents_stay_as_they_are(spark):
    docs = frame(spark, texts())
    out = keep_clean(docs, bench_items(spark), block_bytes=100)
    assert out.schema == docs.schema
    dirty = {r[0] for r in brute(texts()) if r[-1]}
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(str(i) for i, _ in texts() if i not in dirty)


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha x y beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta gamma")], "doc_id long, text string")
    one = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    near = lambda slop: sorted(r.doc_id for r in find_passages(docs, one, slop=slop).where("size(items) > 0").collect())
    assert near(None) == [4] and near(0) == [4] and near(1) == [1, 4] and near(2) == [1, 2, 4]


def test_index_is_stored_and_holds_every_posting(spark):
    docs = frame(spark, texts()).repartition(2)
    index = build_index(docs, Scratch(spark, "test"))
    got = {}
    for r in index.collect():
        terms, counts, positions = np.frombuffer(r.terms, np.uint64), np.frombuffer(r.counts, np.int32), np.frombuffer(r.positions, np.int32)
        assert (np.diff(terms.astype(object)) > 0).all() and counts.sum() == len(positions) == sum(r.words)
        at = np.empty(len(positions), np.uint64)
        at[positions] = np.repeat(terms, counts)
        ends = np.cumsum(r.words)
        for i, n, e in zip(r.doc_id, r.words, ends):
            got.setdefault(i, []).append(tuple(at[e - n : e].tolist()))
    words_of = {i: sorted(len(split(t)) for j, t in texts() if j == i) for i, _ in texts()}
    assert {i: sorted(len(x) for x in v) for i, v in got.items()} == words_of
    number = {}
    for i, t in texts():
        for w, h in zip(split(t), next(x for x in got[i] if len(x) == len(split(t)))):
            assert number.setdefault(w, h) == h
    assert len(set(number.values())) == len(number)


def test_larger_benchmarks_go_block_by_block(spark):
    """Fifty times the items in many blocks: the same hits, one broadcast at a time."""
    live = []

    def opened(*args):
        for held in real(*args):
            live.append(len(held.value["term"]))
            yield held

    real = decontaminate.blocks
    decontaminate.blocks = opened
    try:
        more = [(1000 + i, " ".join(f"x{i}y{j}" for j in range(15))) for i in range(400)] + items()
        tests = spark.createDataFrame(more, "item_id long, text string")
        out = contamination(frame(spark, texts()), tests, block_bytes=4000).collect()
    finally:
        decontaminate.blocks = real
    assert sorted((tuple(r) for r in out), key=str) == brute(texts())
    assert len(live) > 5 and max(live) < sum(live) / 3


def test_empty_tables(spark):
    assert contamination(empty(spark), bench_items(spark)).count() == 0
    out = contamination(frame(spark, texts()), bench_items(spark).limit(0)).collect()
    assert len(out) == len(texts()) and not any(r.contaminated for r in out)
