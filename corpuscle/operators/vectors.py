"""Embeddings as a table, and similarity queries over it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def with_norm(vectors: DataFrame, column: str = "syn0") -> DataFrame:
    return vectors.withColumn("norm", norm(F.col(column)))


def most_similar_by_vector(items: DataFrame, vector: list[float], count: int = 100, min_count: int | None = None, column: str = "syn0") -> DataFrame:
    """Items ``(idx, …, count, vector)`` by falling cosine: adds ``score``.

    Those under ``min_count`` score -100 and so come last; ties go to the smaller index; zero vectors have no score."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    score = cosine(F.col(column), v)
    if min_count is not None:
        score = F.when(F.col("count") >= min_count, score).otherwise(F.when(score.isNotNull(), F.lit(-100.0)))
    return items.withColumn("score", score).drop(column).orderBy(F.desc_nulls_last("score"), "idx").limit(count)


def most_similar(items: DataFrame, idx: int, count: int = 100, min_count: int | None = None, column: str = "syn0") -> DataFrame:
    """As ``most_similar_by_vector`` with the vector of item ``idx``, which is part of the result."""
    row = items.where(F.col("idx") == idx).select(column).first()
    if row is None:
        raise KeyError(idx)
    return most_similar_by_vector(items, list(row[0]), count, min_count, column)


def in_grid(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int, query_key: str, row_key: str):
    """Both sides cut into blocks of about so many rows by hash, each query block to meet each row block in one group of a cogroup: neither side comes to the driver, and a group is bounded on both sides."""
    n_q = max(1, -(-queries.count() // query_block))
    n_r = max(1, -(-rows.count() // row_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.withColumn("_q", own(query_key, n_q)).withColumn("_r", every(n_r))
    right = rows.withColumn("_r", own(row_key, n_r)).withColumn("_q", every(n_q))
    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r"))


#: Scores that a task holds at a time.
CELLS = 1 << 21


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the ``k`` largest scores of each row; ties at the end go to the earlier columns."""
    least = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    take = s >= least
    if (over := take.sum(1) > k).any():
        above, ties = s[over] > least[over], s[over] == least[over]
        take[over] = above | ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True))
    row, column = np.nonzero(take)
    return row, column, s[row, column]


def batch_similar(queries: DataFrame, items: DataFrame, count: int, column: str = "syn0", block: int = 16384, query_block: int = 4096) -> DataFrame:
    """``query_idx, rank, idx, score``: the ``count`` items of largest cosine to each query, in matrix products.

    Every block of queries meets every block of items in a task of its own, some queries at a time, so that it never holds
    more than CELLS scores (or one query's); it returns its best ``count`` a query, and those are merged by query. Ties go to the smaller index; zero items have no score."""
    vector = F.col(column).cast("array<double>").alias("v")

    def rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        idx = t.column("idx").to_numpy()
        v = t.column("v").combine_chunks()
        return idx, v.flatten().to_numpy(zero_copy_only=False).reshape(len(idx), -1) if len(idx) else np.zeros((0, 1))

    def score(q: pa.Table, x: pa.Table) -> pa.Table:
        (ids, t), (idx, v) = rows(q), rows(x)
        order = np.argsort(idx, kind="stable")
        lengths = np.linalg.norm(v, axis=1)
        order = order[lengths[order] > 0]
        v, idx = v[order] / lengths[order, None], idx[order]
        if not len(v) or not len(t):
            return pa.table({"query_idx": pa.array([], pa.int64()), "idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300)
        k = min(count, len(v))
        some = max(1, CELLS // len(v))
        found = [_best(t[i : i + some] @ v.T, k) for i in range(0, len(t), some)]
        at = np.concatenate([i * some + f[0] for i, f in enumerate(found)])
        return pa.table({"query_idx": ids[at].astype(np.int64), "idx": idx[np.concatenate([f[1] for f in found])].astype(np.int64), "score": np.concatenate([f[2] for f in found])})

    pairs = in_grid(queries.select("idx", vector), items.select("idx", vector), query_block, block, "idx", "idx")
    out = pairs.applyInArrow(score, "query_idx long, idx long, score double")
    best = Window.partitionBy("query_idx").orderBy(F.desc("score"), "idx")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count).select("query_idx", "rank", "idx", "score")


@dataclass
class Embedding:
    """A trained model: its items with two vectors each, and how it was trained."""

    items: DataFrame
    train_params: dict = field(default_factory=dict)

    def _vector(self, kind: str, name: str) -> np.ndarray:
        if self.items is None:
            raise RuntimeError("the model has not been trained")
        row = self.items.where((F.col("kind") == kind) & (F.col("name") == name)).select("syn0").first()
        if row is None:
            raise KeyError(name)
        return np.array(row[0], np.float32)

    def get_word_vector(self, name: str) -> np.ndarray:
        return self._vector("word", name)

    def get_entity_vector(self, name: str) -> np.ndarray:
        return self._vector("entity", name)

    def get_vector(self, idx: int) -> np.ndarray:
        row = self.items.where(F.col("idx") == idx).select("syn0").first()
        if row is None:
            raise KeyError(idx)
        return np.array(row[0], np.float32)

    def most_similar(self, idx: int, count: int = 100, min_count: int | None = None) -> DataFrame:
        return most_similar(self.items.drop("syn1"), idx, count, min_count)
