"""Text classification with words and entities: vocabularies, padded features, an attention model and its training."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def fold(docs: DataFrame, name: str) -> DataFrame:
    return docs.where(F.col("fold") == name)


def vocabulary(items: DataFrame, order: list[str], item: str = "item", min_count: int = 1) -> DataFrame:
    """``item, id``: items that occur ``min_count`` times, numbered from 1 by first appearance in ``order``; 0 is padding."""
    first = items.groupBy(item).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first")).where(F.col("_n") >= min_count)
    return first.select(item, F.row_number().over(Window.orderBy("_first", item)).alias("id"))


def sequences(docs: DataFrame, items: DataFrame, vocab: DataFrame, doc: str, order: list[str], length: int, item: str = "item", extra: str | None = None, out: str = "ids") -> DataFrame:
    """``doc, ids[, extra]``: each document's known items in order, cut and filled with zeros to ``length``."""
    fields = [F.col(c) for c in order] + [F.col("id")] + ([F.col(extra)] if extra else [])
    per = items.join(vocab, item).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    pad = lambda field, zero: F.slice(F.concat(F.transform("_s", lambda s: s[field]), F.array_repeat(zero, length)), 1, length)
    rows = docs.select(doc).join(per, doc, "left").withColumn("_s", F.coalesce("_s", F.array().cast(per.schema["_s"].dataType)))
    cols = [pad("id", F.lit(0)).alias(out)]
    if extra:
        cols.append(pad(extra, F.lit(0.0).cast(items.schema[extra].dataType)).alias(extra))
    return rows.select(doc, *cols)


@dataclass
class Naboe:
    """A bag of entities weighted by attention, with word vectors added: NumPy arrays, so it can be broadcast."""

    words: np.ndarray
    entities: np.ndarray
    attention: np.ndarray
    bias: float
    out_w: np.ndarray
    out_b: np.ndarray
    use_word: bool = True

    @staticmethod
    def init(n_words: int, n_entities: int, n_labels: int, dim: int, seed: int = 0, words: dict[int, np.ndarray] | None = None, entities: dict[int, np.ndarray] | None = None) -> Naboe:
        """Uniform in +-0.05 with a zero row for padding; known vectors are copied in by id."""
        rng = np.random.default_rng(seed)
        tables = []
        for n, known in ((n_words, words), (n_entities, entities)):
            t = rng.uniform(-0.05, 0.05, (n + 1, dim))
            t[0] = 0
            for i, v in (known or {}).items():
                t[i] = v
            tables.append(t)
        k = 1 / np.sqrt(dim)
        return Naboe(*tables, rng.uniform(-0.7, 0.7, 2), 0.0, rng.uniform(-k, k, (n_labels, dim)), np.zeros(n_labels))

    def forward(self, word_ids: np.ndarray, entity_ids: np.ndarray, priors: np.ndarray, cache: bool = False):
        wv, ev = self.words[word_ids], self.entities[entity_ids]
        total = wv.sum(1)
        tn = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        en = ev / np.maximum(np.linalg.norm(ev, axis=2, keepdims=True), 1e-12)
        cos = np.einsum("nd,nkd->nk", tn, en)
        logit = self.attention[0] * priors + self.attention[1] * cos + self.bias
        logit = np.where(entity_ids == 0, -1e32, logit)
        a = np.exp(logit - logit.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        z = np.einsum("nk,nkd->nd", a, ev)
        n = np.maximum((word_ids != 0).sum(1, keepdims=True), 1)
        if self.use_word:
            z = z + total / n
        scores = z @ self.out_w.T + self.out_b
        return (scores, z, a, ev, cos, n) if cache else scores

    def step(self, word_ids, entity_ids, priors, labels, adam: AdamW) -> float:
        """One AdamW step on a batch; returns the loss before it."""
        value, grads = self.gradients(word_ids, entity_ids, priors, labels)
        adam.update(self, grads)
        return value

    def gradients(self, word_ids, entity_ids, priors, labels) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of a batch and its exact gradient, but for the padding rows, which stay zero."""
        scores, z, a, ev, cos, n = self.forward(word_ids, entity_ids, priors, cache=True)
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        m = len(labels)
        value = float(-np.log(p[np.arange(m), labels] + 1e-30).mean())
        d = p
        d[np.arange(m), labels] -= 1
        d /= m
        dz = d @ self.out_w
        da = np.einsum("nd,nkd->nk", dz, ev)
        dl = a * (da - (a * da).sum(1, keepdims=True)) * (entity_ids != 0)
        g_ent = np.zeros_like(self.entities)
        np.add.at(g_ent, entity_ids, a[:, :, None] * dz[:, None, :])
        g_word = np.zeros_like(self.words)
        total = self.words[word_ids].sum(1)
        tn = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        en = np.maximum(np.linalg.norm(ev, axis=2, keepdims=True), 1e-12)
        dcos = dl * self.attention[1]
        # a cosine moves with a vector only across that vector's direction
        t, e = total / tn, ev / en
        np.add.at(g_ent, entity_ids, dcos[:, :, None] * (t[:, None, :] - cos[:, :, None] * e) / en)
        dt = (np.einsum("nk,nkd->nd", dcos, e) - (dcos * cos).sum(1, keepdims=True) * t) / tn + (dz / n if self.use_word else 0)
        np.add.at(g_word, word_ids, np.broadcast_to(dt[:, None, :], (*word_ids.shape, dt.shape[1])))
        g_word[0] = g_ent[0] = 0
        return value, {"words": g_word, "entities": g_ent, "attention": np.array([(dl * priors).sum(), (dl * cos).sum()]), "bias": np.array(dl.sum()), "out_w": d.T @ z, "out_b": d.sum(0)}


class AdamW:
    """Adam with decoupled weight decay and a linear warm-up followed by a linear fall to 0."""

    def __init__(self, rate: float = 1e-3, decay: float = 0.01, warmup: int = 0, total: int = 0):
        self.rate, self.decay, self.warmup, self.total, self.t = rate, decay, warmup, total, 0
        self.state: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def factor(self) -> float:
        if self.warmup and self.t <= self.warmup:
            return self.t / self.warmup
        return max(0.0, (self.total - self.t) / max(1, self.total - self.warmup)) if self.total else 1.0

    def update(self, model: Naboe, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        lr = self.rate * self.factor()
        for k, g in grads.items():
            p = np.asarray(getattr(model, k), float)
            m, v = self.state.get(k, (np.zeros_like(p), np.zeros_like(p)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.state[k] = (m, v)
            step = (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
            new = p - lr * step - (lr * self.decay * p if k not in ("bias", "out_b") else 0)
            setattr(model, k, float(new) if np.ndim(new) == 0 else new)


def fit(model: Naboe, train: dict[str, np.ndarray], dev: dict[str, np.ndarray], batch: int = 32, epochs: int = 50, patience: int = 5, adam: AdamW | None = None, seed: int = 0) -> Naboe:
    """Train until the accuracy on ``dev`` hasn't risen for ``patience`` epochs; the best model is returned."""
    import copy

    adam = adam or AdamW()
    rng = np.random.default_rng(seed)
    best, best_acc, waited = copy.deepcopy(model), -1.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(train["label"]))
        for i in range(0, len(order), batch):
            j = order[i : i + batch]
            model.step(train["words"][j], train["entities"][j], train["priors"][j], train["label"][j], adam)
        acc = float((model.forward(dev["words"], dev["entities"], dev["priors"]).argmax(1) == dev["label"]).mean())
        if acc > best_acc:
            best, best_acc, waited = copy.deepcopy(model), acc, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best


def predict(features: DataFrame, model: Naboe, doc: str = "doc_id") -> DataFrame:
    """``doc, pred`` of rows with ``words, entities, priors`` arrays; the model is broadcast."""
    held = features.sparkSession.sparkContext.broadcast(model)
    kind = features.schema[doc].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                stack = lambda c, t: np.array(pdf[c].tolist(), t)
                scores = held.value.forward(stack("words", int), stack("entities", int), stack("priors", float))
                yield pd.DataFrame({doc: pdf[doc], "pred": scores.argmax(1).astype(np.int32)})

    return features.select(doc, "words", "entities", "priors").mapInPandas(run, f"{doc} {kind}, pred int")
