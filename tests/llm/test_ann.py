import os

import numpy as np
import pytest

from corpuscle.llm import ann
from corpuscle.llm.ann import Index, brute_force, nearest


def table(spark, n=3000, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(20, size=n)] + 0.6 * rng.normal(size=(n, dim))
    x[:40] *= 3.0
    x[50:80] = x[50]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(9001, None, 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, [1.0] * (dim - 1) + [None], 1), (9005, [float("inf")] * dim, 1), (9006, [1.0] * 3, 1), (None, [1.0] * dim, 1), (100, rows[100][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")


def check(v, got, want):
    assert got.groupby("query_id").size().eq(20).all() and len(got) == len(want)
    a, b = set(zip(got.query_id, got.vec_id)), set(zip(want.query_id, want.vec_id))
    x = {r.vec_id: np.array(r.embedding) for r in v.where("vec_id < 9000").collect()}
    assert all(abs(x[r.query_id] @ x[r.vec_id] - r.score) < 1e-9 for r in got.itertuples())
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id)) and g.vec_id.is_unique
    assert not (got.query_id == got.vec_id).any()
    return len(a & b) / len(b)


@pytest.mark.parametrize("bounds", [{}, {"upper": 4}, {"upper": 3, "CHUNK_ROWS": 300, "QUERY_ROWS": 7}])
def test_recall_scores_and_ties(spark, monkeypatch, bounds):
    """With lists in memory for all rows, with long lists cut again, and with many small chunks."""
    bounds = dict(bounds)
    upper = bounds.pop("upper", ann.UPPER)
    for k, x in bounds.items():
        monkeypatch.setattr(ann, k, x)
    v = table(spark)
    q = v.where("vec_id % 20 = 0")
    want = brute_force(v.dropDuplicates(["vec_id"]), q.dropDuplicates(["vec_id"]), 20).toPandas()
    assert check(v, nearest(v, q, 20, upper=upper).toPandas(), want) >= 0.9


def test_recall_on_embeddings(spark, data):
    """The driver's vectors, close to uniform on the sphere, the hardest case for lists."""
    for sf in ("sf0.001", "sf0.1"):
        path = f"{os.path.dirname(data)}/{sf}/embeddings.parquet"
        if os.path.exists(path):
            v = spark.read.parquet(path)
            q = v.where("vec_id % 20 = 0")
            assert check(v, nearest(v, q).toPandas(), brute_force(v, q).toPandas()) >= 0.9


def test_boundary_vectors_are_replicated_and_lists_are_pruned():
    """Uniform vectors, 8,000 of them: over 1.2 list rows a vector, and at most four lists in ten read for 0.9 of the neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = Index(x, len(x))
    row, lists = index.assign(x)
    assert set(row) == set(range(len(x))) and len(row) / len(x) > 1.2
    size = np.bincount(lists, minlength=index.tall)
    assert size.max() < 6 * size.mean()
    q = np.arange(0, 8000, 40)
    to, read = index.route(x[q], None)
    seen = np.zeros((len(q), index.tall + 1), bool)
    seen[to, read] = True
    assert seen[:, :-1].mean() < 0.4
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, 1)[:, :20]
    hit = np.zeros((len(q), len(x)), bool)
    for r, n in zip(row, lists):
        hit[:, r] |= seen[:, n]
    assert np.take_along_axis(hit, top, 1).mean() >= 0.9


def test_the_walk_finds_what_a_scan_of_all_centroids_does():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    index = Index(x, 20_000)
    q = index.lift_query(x[:200])
    d = np.sqrt(np.maximum(2 - 2 * q @ index.lists.c.T, 0))
    bound = index.lists.ratio * np.sort(d, 1)[:, index.lists.rank - 1]
    want = set(zip(*map(list, np.nonzero(d <= bound[:, None]))))
    got = set(zip(*map(list, index.lists.walk(q))))
    assert len(got & want) >= 0.99 * len(want) and len(got) < 1.1 * len(want)


def test_one_huge_vector_changes_nothing_for_the_others(spark):
    v = table(spark, 600)
    dim = 16
    for size in (1e6, 1e200):
        huge = spark.createDataFrame([(8000, [size] + [0.0] * (dim - 1), 1)], v.schema)
        both = v.unionByName(huge)
        q = both.where("vec_id % 20 = 0")
        got = nearest(both, q, 20).toPandas()
        old = nearest(v, v.where("vec_id % 20 = 0"), 20).toPandas()
        a = {(r.query_id, r.vec_id) for r in got.itertuples() if 8000 not in (r.query_id, r.vec_id)}
        b = {(r.query_id, r.vec_id) for r in old.itertuples()}
        assert len(a & b) >= 0.9 * len(a)
        x = {r.vec_id: r.embedding[0] for r in v.where("vec_id < 9000").collect()}
        firsts = {r.query_id for r in got.itertuples() if r.vec_id == 8000}
        assert firsts >= {i for i in x if i % 20 == 0 and x[i] > 0.01} and 8000 in set(got.query_id)


def test_many_equal_vectors_and_repeated_rows(spark):
    """A third of all rows are one vector; one row is there a hundred times."""
    v = table(spark, 900)
    same = v.where("vec_id = 7").crossJoin(spark.range(2000, 2600).withColumnRenamed("id", "n")).selectExpr("n as vec_id", "embedding", "list")
    again = v.where("vec_id = 7").crossJoin(spark.range(100)).selectExpr("vec_id", "embedding", "list")
    both = v.unionByName(same).unionByName(again)
    q = both.where("vec_id % 20 = 0")
    want = brute_force(both.dropDuplicates(["vec_id"]), q.dropDuplicates(["vec_id"]), 20).toPandas()
    assert check(both, nearest(both, q, 20).toPandas(), want) >= 0.9


def test_few_candidates_and_empty(spark):
    v = table(spark).where("vec_id < 5")
    assert nearest(v, v, 20).groupBy("query_id").count().collect() and nearest(v, v, 20).count() == 20
    assert nearest(v.limit(0), v, 20).count() == 0 and nearest(v, v.limit(0), 20).count() == 0
