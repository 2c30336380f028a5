import random
import re

import numpy as np

from corpuscle.llm.components import components
from corpuscle.llm.near import keep_one_of_each, near_duplicates, prefix_groups
from corpuscle.llm.scratch import Scratch
from corpuscle.llm.textops import mix

from .cases import empty, frame, texts


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    live = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(live):
        for j, b in live[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_against_all_pairs(spark):
    for k in (4, 5):
        out = near_duplicates(frame(spark, texts()), k=k).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(texts(), k)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_large_families(spark, monkeypatch):
    """Families compared over several tasks, with groups by rare shingles and, with HUBS at 1, in turns."""
    for hubs, seed in ((256, 1), (1, 3)):
        monkeypatch.setattr("corpuscle.llm.near.HUBS", hubs)
        out = near_duplicates(frame(spark, texts(seed)), k=4, family_sets=1).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(texts(seed), 4)


def test_prefix_groups_hold_every_pair(spark):
    """Sets of any sizes: each pair of similarity 0.8 or more has a group."""
    rng = random.Random(9)
    sets = {}
    for i in range(60):
        base = set(rng.sample(range(4000), rng.randrange(1, 60)))
        for j in range(4):
            sets[i * 10 + j] = {x for x in base if rng.random() < 0.93} | set(rng.sample(range(4000), rng.randrange(0, 4))) or {7}
    rows = [(i, np.array(sorted(mix(np.array(sorted(s), np.uint64))), np.uint64).tobytes()) for i, s in sets.items()]
    groups = {}
    for r in prefix_groups(spark.createDataFrame(rows, "rep long, hashes binary"), 80).collect():
        groups.setdefault(r.key, set()).add(r.rep)
    together = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    close = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert close and close <= together


def template(rng, n, common, own):
    """``n`` texts with a common passage and words of their own."""
    passage = [f"p{i}" for i in range(common)]
    return [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def test_bucket_of_many_unlinked_sets(spark):
    """5,000 texts of similarity 0.6, which share bands by the hundred, and a few true pairs among them."""
    rng = random.Random(4)
    ts = template(rng, 5000, 90, 26)
    for i in range(0, 100, 10):
        ts[i + 1] = ts[i] + " more"
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, k=4).collect()}
    assert got == {i: i - 1 if i < 100 and i % 10 == 1 else i for i in range(5000)}


def test_bucket_of_many_copies(spark):
    """5,000 near copies of one text, each with a word of its own."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    ts = []
    for i in range(5000):
        w = list(base)
        w[rng.randrange(150)] = f"own{i}"
        ts.append(" ".join(w))
    out = near_duplicates(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string"), k=4).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 5000


def test_steps_of_a_large_family_do_not_grow(spark, monkeypatch):
    """A cluster of links and near misses: as many tables are written for 72 sets as for 24, components aside, and every pair is judged."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    ts = []
    for i in range(72):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 8)):
            w[at] = f"own{rng.randrange(400)}"
        ts.append((i, " ".join(w)))
    monkeypatch.setattr("corpuscle.llm.near.HUBS", 4)
    keep, written = Scratch.keep, []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(name) or keep(self, df, name))
    steps = []
    for n in (24, 72):
        written.clear()
        out = near_duplicates(spark.createDataFrame(ts[:n], "doc_id long, text string"), k=4, family_sets=10).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(ts[:n], 4)
        steps.append(sum(not name.startswith("cc-") for name in written))
    assert 1 < len({r.component_id for r in out}) < 72
    assert steps[0] == steps[1]


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = frame(spark, texts())
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(i, t) for (i, t) in texts() if i is None or dict((a, c) for a, _, c in brute(texts(), 5))[i] == i]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_chains_loops_and_hubs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = {r.node: r.label for r in out.collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
