"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors are scaled by a high quantile of the norms and lifted by one coordinate onto the unit sphere, where the largest
inner product is the smallest distance; the few longer ones stand in a list of their own that every query reads.
Centroids come from a hierarchical balanced k-means on a bounded sample. Every vector joins the list of its nearest
centroid and those of a few others that are hardly farther. A query walks an in-memory graph of the centroids and takes
every list whose centroid is within a ratio of the nearest distance. Lists are then scanned with the original vectors in
double precision; one that has grown long is first cut into lists of its own by the same rules, so the number of lists
follows the rows though the centroids in memory are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .textops import mix

#: Rows the fit sees at most, and centroids in memory at most (half a MB a thousand at 64 dimensions).
SAMPLE = 32_768
UPPER = 2_048
#: Vectors a list is meant for, before boundary vectors join; one of SPLIT times as many is cut into lists of its own.
LIST_ROWS = 32
SPLIT = 8
REPLICAS = 3
CLOSURE = 0.1
GRAPH_DEGREE = 16
BEAM = 12
#: Aims of the lists in memory, and of those that a long list is cut into.
TARGET_RECALL = 0.95
INNER_RECALL = 0.975
TALL = 0.999
CHUNK_ROWS = 4_096
QUERY_ROWS = 512


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _balanced(x: np.ndarray, k: int, rng: np.random.Generator, steps: int, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(k unit centroids, nearest one of each row), with a price on each centroid that rises with its rows."""
    c = x[rng.choice(len(x), k, replace=False)].copy() if c is None else c
    price = np.zeros(k, np.float32)
    near = np.zeros(len(x), np.int64)
    for _ in range(steps):
        s = x @ c.T
        near = (s - price).argmax(1)
        size = np.bincount(near, minlength=k)
        price += (0.05 * s.std() * (size / size.mean() - 1)).astype(np.float32)
        order = np.argsort(near, kind="stable")
        head = np.cumsum(size) - size
        full = size > 0
        c[full] = np.add.reduceat(x[order], head[full], axis=0)
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        c = _unit(c)
    return c, near


def _hierarchy(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids by repeated balanced splits into at most 16; those of one split stay side by side."""
    k = min(k, len(x))
    if k <= 1:
        return _unit(x.mean(0, keepdims=True))
    b = min(k, 16)
    c, near = _balanced(x, b, rng, 8)
    if k == b:
        return c
    size = np.bincount(near, minlength=b)
    if size.max() == len(x):  # rows that can't be told apart
        return x[:k].copy()
    share = np.minimum(np.maximum(1, np.floor(size / len(x) * k)).astype(int), np.maximum(size, 1))
    for i in np.argsort(-(size / share), kind="stable")[: max(0, k - share.sum())]:
        share[i] += share[i] < size[i]
    return np.concatenate([_hierarchy(x[near == i], int(share[i]), rng) if size[i] else c[i : i + 1] for i in range(b)])


class Lists:
    """Centroids of unit vectors, their graph, and the pruning ratio: a few MB at most, by its bounds."""

    def __init__(self, x: np.ndarray, n_rows: int, upper: int = UPPER, wanted: int = 20, recall: float = TARGET_RECALL, seed: int = 5):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        k = max(1, min(upper, math.ceil(n_rows / LIST_ROWS), len(x) // 8))
        c = _hierarchy(x, k, rng)
        self.c = _balanced(x, len(c), rng, 2, c)[0] if len(c) > 1 else c
        k = len(self.c)
        s = self.c @ self.c.T
        np.fill_diagonal(s, -np.inf)
        degree = min(GRAPH_DEGREE, k - 1)
        near = np.argsort(-s, 1, kind="stable")[:, :degree] if degree else np.zeros((k, 0), np.int64)
        links = [set(r.tolist()) for r in near]
        for i, r in enumerate(near.tolist()):
            for j in r:
                links[j].add(i)
            if i:  # a path through all, so that no centroid is out of reach
                links[i].add(i - 1)
                links[i - 1].add(i)
        width = max(map(len, links))
        self.graph = np.array([sorted(g) + [i] * (width - len(g)) for i, g in enumerate(links)], np.int32).reshape(k, width)
        self.entry = rng.choice(k, min(k, 4), replace=False)
        self.rank, self.ratio = self._calibrate(x, n_rows, wanted, recall, rng)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each unit vector and the lists it joins: the nearest, and up to REPLICAS in all whose distance is within CLOSURE of that."""
        s = x.astype(np.float32) @ self.c.T
        m = min(REPLICAS, s.shape[1])
        order = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(x), 1))
        d = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, order, 1), 0))
        row, at = np.nonzero(d <= (1 + CLOSURE) * d.min(1, keepdims=True) if len(d) else d > 0)
        return row, order[row, at]

    def walk(self, q: np.ndarray, ratio: float | None = None, sizes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) for the lists within ``ratio`` times the distance of each query's ``rank``-th nearest centroid, all queries walking the graph at once.

        Each step opens the centroids met so far that are within that bound, or among the BEAM nearest, and measures
        their neighbours; it ends when no query has any left to open. Where the lists found hold fewer than ``least``
        vectors by their ``sizes``, the nearest ones are taken until they do."""
        ratio = ratio or self.ratio
        k = len(self.c)
        q = q.astype(np.float32)
        d = np.full((len(q), k), np.inf, np.float32)
        opened = np.zeros((len(q), k), bool)
        d[:, self.entry] = np.sqrt(np.maximum(2 - 2 * (q @ self.c[self.entry].T), 0))
        beam = min(BEAM, k) - 1
        while True:
            near = np.partition(d, sorted({self.rank - 1, beam}), 1)
            bound = np.maximum(ratio * near[:, self.rank - 1], near[:, beam])[:, None]
            todo = (d <= bound) & ~opened & np.isfinite(d)
            a, i = np.nonzero(todo)
            if not len(a):
                break
            opened |= todo
            fresh = np.zeros((len(q), k), bool)
            fresh[np.repeat(a, self.graph.shape[1]), self.graph[i].ravel()] = True
            fresh &= ~np.isfinite(d)
            a, i = np.nonzero(fresh)
            for t in range(0, len(a), 1 << 16):
                u, v = a[t : t + (1 << 16)], i[t : t + (1 << 16)]
                d[u, v] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", q[u], self.c[v]), 0))
        take = d <= ratio * np.partition(d, self.rank - 1, 1)[:, self.rank - 1 : self.rank]
        if sizes is not None:
            few = np.flatnonzero(take @ sizes < least)
            order = np.argsort(-(q[few] @ self.c.T), 1, kind="stable")
            need = np.zeros((len(few), k), bool)
            np.put_along_axis(need, order, np.cumsum(sizes[order], 1) - sizes[order] < least, 1)
            take[few] |= need
        return np.nonzero(take)

    def _calibrate(self, x: np.ndarray, n_rows: int, wanted: int, recall: float, rng: np.random.Generator) -> tuple[int, float]:
        """The rank and the ratio that select the fewest lists, of those at which sampled rows, as queries, reach ``recall`` of their neighbours in the sample, of which there are as many as its share of all rows makes of ``wanted``.

        The nearest centroid alone is a poor measure where vectors fill the sphere: how near it is depends on chance."""
        if len(x) < 2 or len(self.c) < 2:
            return 1, 1.0
        pick = rng.choice(len(x), min(300, len(x)), replace=False)
        q = _unit(np.concatenate([x[pick, :-1], np.zeros((len(pick), 1), np.float32)], 1))
        s = q @ x.T
        s[np.arange(len(pick)), pick] = -np.inf
        m = min(max(1, math.ceil(wanted * len(x) / n_rows)), len(x) - 1)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        d = np.sqrt(np.maximum(2 - 2 * (q @ self.c.T), 0))
        seen = np.unique(top)
        row, lists = self.assign(x[seen])
        need = np.minimum.reduceat(d[:, lists], np.searchsorted(row, np.arange(len(seen))), axis=1)
        need = np.take_along_axis(need, np.searchsorted(seen, top), 1)
        best = None
        ordered = np.sort(d, 1)
        for rank in sorted({min(1 << i, len(self.c)) for i in range(12)}):
            at = np.maximum(ordered[:, rank - 1 : rank], 1e-6)
            ratio = float(np.quantile(need / at, recall)) * (1 + 1e-6)
            cost = (d <= ratio * at).sum()
            if best is None or cost < best[0]:
                best = cost, rank, ratio
        return best[1:]


class Index:
    """The scale of the lift and the lists in memory."""

    def __init__(self, sample: np.ndarray, n_rows: int, upper: int = UPPER, wanted: int = 20, recall: float = TARGET_RECALL):
        norm = _norms(sample)
        norm = norm[np.isfinite(norm)]
        self.scale = float(np.quantile(norm, TALL, method="lower")) if len(norm) else 1.0
        x = sample[_norms(sample) <= self.scale * (1 + 1e-6)]
        lifted = self.lift(x)
        self.lists = Lists(lifted, n_rows, upper, wanted, recall)
        self.tall = len(self.lists.c)

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v / self.scale
        return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1)

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        q = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
        return np.concatenate([_unit(q), np.zeros((len(q), 1))], 1)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every row; one longer than the scale is in the list ``tall`` alone."""
        tall = _norms(v) > self.scale * (1 + 1e-6)
        low = np.flatnonzero(~tall)
        row, lists = self.lists.assign(self.lift(v[low]))
        high = np.flatnonzero(tall)
        return np.concatenate([low[row], high]), np.concatenate([lists, np.full(len(high), self.tall)])

    def route(self, v: np.ndarray, ratio: float | None = None, sizes: np.ndarray | None = None, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) for the lists each query reads; ``tall`` among them. By their ``sizes`` they hold ``k`` vectors besides the query's own, if all do."""
        a, lists = self.lists.walk(self.lift_query(v), ratio, sizes, REPLICAS * (k + 1))
        return np.concatenate([a, np.arange(len(v))]), np.concatenate([lists, np.full(len(v), self.tall)])


def _norms(v: np.ndarray) -> np.ndarray:
    """Euclidean norms without overflow on the way."""
    top = np.maximum(np.abs(v).max(1), 1e-300) if v.size else np.zeros(len(v))
    with np.errstate(over="ignore"):
        return top * np.sqrt(((v / top[:, None]) ** 2).sum(1))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _binary(v: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    v = np.ascontiguousarray(v)
    width = v.shape[1] * v.itemsize
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((np.arange(len(v) + 1) * width).astype(np.int32)), pa.py_buffer(v)])


def _from_binary(col: pa.Array | pa.ChunkedArray, kind: Any) -> np.ndarray:
    """All values of a binary column, end to end."""
    if isinstance(col, pa.ChunkedArray):
        return np.concatenate([_from_binary(c, kind) for c in col.chunks]) if col.num_chunks else np.zeros(0, kind)
    if not len(col):
        return np.zeros(0, kind)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind) if offs[-1] > offs[0] else np.zeros(0, kind)


def _usable(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """``id, v`` of the vectors that take part: an id, ``dim`` components, none null or not finite, not all zero."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    zero = F.forall(v, lambda c: c == 0.0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(~bad & ~zero).select(F.col(key).cast("long").alias("id"), v.alias("v"))


PLACED = "shard int, list int, id long, v binary"
ASKED = "shard int, lists binary, id long, v binary"


def _assign(index: Any, dim: int, shard_lists: int, kind: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                cut = batch.slice(a, CHUNK_ROWS)
                v = _matrix(cut.column("v"), dim)
                row, lists = index.value.assign(v)
                yield pa.RecordBatch.from_arrays([pa.array((lists // shard_lists).astype(np.int32)), pa.array(lists.astype(np.int32)), cut.column("id").take(pa.array(row)), _binary(v[row].astype(kind))], ["shard", "list", "id", "v"])

    return run


def _route(index: Any, dim: int, shard_lists: int, kind: Any, ratio: float | None, sizes: np.ndarray, k: int):
    """One row for each shard that a query reads from, with the numbers of its lists there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_ROWS):
                cut = batch.slice(a, QUERY_ROWS)
                v = _matrix(cut.column("v"), dim)
                q, lists = index.value.route(v, ratio, sizes, k)
                order = np.lexsort((lists, q))
                q, lists = q[order], lists[order]
                shard = lists // shard_lists
                first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (shard[1:] != shard[:-1])])) if len(q) else np.zeros(0, np.int64)
                offs = np.append(first, len(q)) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(lists.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), packed, cut.column("id").take(pa.array(q[first])), _binary(v[q[first]].astype(kind))], ["shard", "lists", "id", "v"])

    return run


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best distinct ids of each query, by score, then smaller id."""
    order = np.lexsort((ids, -scores, query))
    _, first = np.unique(np.stack([query[order], ids[order]], 1), axis=0, return_index=True)
    order = order[np.sort(first)]
    q = query[order]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return order[rank < k]


def _cells(v: np.ndarray, column: np.ndarray, lists: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, Index | None]]:
    """(list, its distinct vectors, lists of its own if it is long) for each list of some rows, ``column`` being the vector of a row."""
    lists, column = np.unique(np.stack([lists, column]), axis=1)
    order = np.arange(len(lists))
    at = np.flatnonzero(np.concatenate([[True], np.diff(lists[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
        rows = column[a:b]
        yield int(lists[a]), rows, Index(v[rows], len(rows), UPPER, k, INNER_RECALL) if len(rows) > SPLIT * LIST_ROWS else None


def _pairs(cells: list, q: np.ndarray, at: np.ndarray, asked: np.ndarray, v: np.ndarray, ratio: float | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, rows) to compare, block by block: ``asked`` is the list that query ``at`` reads."""
    for number, rows, own in cells:
        who = at[asked == number]
        if not len(who):
            continue
        if own is None:
            yield who, rows
            continue
        row, sub = own.assign(v[rows])
        to, part = own.route(q[who], ratio, np.bincount(sub, minlength=own.tall + 1)[:-1], k)
        for n in np.unique(part):
            if (mine := sub == n).any():
                yield who[to[part == n]], rows[row[mine]]


def _near_best(rough: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which candidates can be among each query's ``k`` best ids, ties included; an id of several vectors counts by its best."""
    order = np.argsort(ids, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    best = rough if len(head) == len(ids) else np.maximum.reduceat(rough[:, order], head, axis=1)
    n = best.shape[1]
    pick = rough > -np.inf
    if n > k:
        edge = np.partition(best, n - k, 1)[:, n - k]
        edge = edge - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(edge), edge, 0.0)))
        pick &= rough >= edge[:, None]
    return pick


def _scan(k: int, kind: Any, dim: int, ratio: float | None):
    def run(lists: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if lists.num_rows and queries.num_rows:
            v, q = (_from_binary(t.column("v"), kind).reshape(-1, dim).astype(np.float64) for t in (lists, queries))
            ids, qids = (t.column("id").to_numpy() for t in (lists, queries))
            packed = queries.column("lists").combine_chunks()
            asked = _from_binary(packed, np.int32)
            at = np.repeat(np.arange(len(q)), [len(x) // 4 for x in (b.as_buffer() for b in packed)])
            # rows of one id and one vector, whether repeated or replicas, are one column
            with np.errstate(over="ignore"):
                twin = mix(ids.view(np.uint64)) + (v.view(np.uint64) * mix(np.arange(1, dim + 1, dtype=np.uint64))).sum(1, dtype=np.uint64)
            _, first, column = np.unique(twin, return_index=True, return_inverse=True)
            v, ids = v[first], ids[first]
            cells = list(_cells(v, column, lists.column("list").to_numpy(), k))
            for a in range(0, len(q), QUERY_ROWS):
                b = min(a + QUERY_ROWS, len(q))
                rough = np.full((b - a, len(v)), -np.inf)
                here = (at >= a) & (at < b)
                for who, rows in _pairs(cells, q, at[here], asked[here], v, ratio, k):
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough[np.ix_(who - a, rows)] = q[who] @ v[rows].T
                rough[qids[a:b, None] == ids[None, :]] = -np.inf
                i, j = np.nonzero(_near_best(rough, ids, k))
                # the same sum for the same two vectors, whatever the block
                exact = np.concatenate([np.zeros(0), *((v[j[t : t + 65536]] * q[a + i[t : t + 65536]]).sum(1) for t in range(0, len(i), 65536))])
                keep = _best(i, ids[j], exact, k)
                i, found, exact = i[keep], ids[j[keep]], exact[keep]
                size = np.bincount(i, minlength=b - a)
                full = np.flatnonzero(size)
                out.append((qids[a:b][full], size[full], found, exact))
        query, size, found, exact = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        offs = pa.py_buffer((np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32))
        pack = lambda x, t: pa.Array.from_buffers(pa.binary(), len(query), [None, offs, pa.py_buffer(np.ascontiguousarray(x, t))])
        return pa.table({"query_id": pa.array(query, pa.int64()), "ids": pack(found, np.int64), "scores": pack(exact, np.float64)})

    return run


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        ids, scores = _from_binary(parts.column("ids"), np.int64), _from_binary(parts.column("scores"), np.float64)
        b = _best(np.zeros(len(ids), np.int64), ids, scores, k)
        return pa.table({"query_id": pa.array(np.full(len(b), key[0].as_py())), "rank": pa.array(np.arange(1, len(b) + 1, dtype=np.int32)), "vec_id": pa.array(ids[b]), "score": pa.array(scores[b])})

    return run


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", ratio: float | None = None, upper: int = UPPER, scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries``: ``query_id, rank, vec_id, score``.

    Nearness is the inner product of the original vectors in double precision, ties to the smaller id; a row is no
    neighbour of a query of its own id. Vectors that are null, zero, or have a null or non-finite component take no
    part, nor those of another length than most; repeated ids with the same vector count once. An empty side gives no
    rows, fewer than ``k`` candidates all of them; where there are more, every query gets ``k``. Other columns are ignored. A vector of however great a norm changes
    nothing for the others: the longest thousandth is in a list that all queries read.

    Scale: the fit sees at most SAMPLE rows, picked by hash; every row is indexed. Lists side by side in the hierarchy
    make a shard, to which a query's vector goes once with the numbers of the lists it reads there. A shard of more than
    CHUNK_ROWS rows is cut into chunks by hash, and so are its queries, so a group holds at most about CHUNK_ROWS of
    either however skewed the data; each gives ``k`` rows a query, and they are merged by query. Once ``upper`` bounds
    the lists in memory, a shard is one list, and each chunk of it is cut into lists of LIST_ROWS again.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    common = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None or not common["n"]:
        return spark.createDataFrame([], RESULT)
    dim = common["n"]
    kind = np.float32 if all(d.schema[column].dataType.simpleString() == "array<float>" for d in (vectors, queries)) else np.float64
    base = _usable(vectors, key, column, dim)
    asked = _usable(queries, key, column, dim)
    n_rows = base.count()
    if not n_rows:
        return spark.createDataFrame([], RESULT)
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    index = Index(_matrix(sample.column("v").combine_chunks(), dim), n_rows, upper, k)
    shard_lists = max(1, CHUNK_ROWS * (index.tall + 1) // (2 * REPLICAS * n_rows))
    held = spark.sparkContext.broadcast(index)
    lists = scratch.keep(base.mapInArrow(_assign(held, dim, shard_lists, kind), PLACED), "lists")
    sizes = np.zeros(index.tall + 1, np.int64)
    for r in lists.groupBy("list").agg(F.count_distinct("id").alias("n")).collect():  # one row for each list in memory
        sizes[r["list"]] = r["n"]
    probes = scratch.keep(asked.mapInArrow(_route(held, dim, shard_lists, kind, ratio, sizes[:-1], k), ASKED), "probes")
    # at most one row for each shard, which are no more than the centroids in memory
    n_lists = lists.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("n"))
    n_probes = probes.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("m"))
    cuts = F.broadcast(n_lists.join(n_probes, "shard"))
    own = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = lists.join(cuts, "shard").select("shard", own(F.col("n")).alias("i"), every(F.col("m")).alias("j"), "list", "id", "v")
    right = probes.join(cuts, "shard").select("shard", every(F.col("n")).alias("i"), own(F.col("m")).alias("j"), "lists", "id", "v")
    parts = left.groupBy("shard", "i", "j").cogroup(right.groupBy("shard", "i", "j")).applyInArrow(_scan(k, kind, dim, ratio), "query_id long, ids binary, scores binary")
    return parts.groupBy("query_id").applyInArrow(_merge(k), RESULT)


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The exact answer for small tables, to measure recall against; it compares all pairs."""
    dim = vectors.where(F.col(column).isNotNull()).select(F.max(F.size(column))).first()[0]
    a = _usable(queries, key, column, dim).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    b = _usable(vectors, key, column, dim).select(F.col("id").alias("vec_id"), "v")
    s = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda t, c: t + c)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = a.join(b, a["query_id"] != b["vec_id"]).select("query_id", "vec_id", s.alias("score"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
