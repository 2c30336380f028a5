"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in its hashed words and word beginnings; a document's is the noisy-or of its
sentences'. The gradient of the document's log-likelihood flows to the sentences through the noisy-or, so labels of
documents alone teach which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, training_sample
from .textops import ALNUM, LOWER, chunks, prefix_prints, span_prints, string_column, words

TRAIN_DOCS = 8000
BITS = 18
HEADS = (4, 6, 8)
KINDS = 1 + len(HEADS)
#: Features count whose log-odds between toxic and clean documents of the sample exceed so many standard errors. What
#: speaks for a clean text has no weight: one offending sentence makes a document toxic, whatever stands around it.
LEAST_Z = 3.5
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def sentence_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features (words, KINDS), sentence of each word, text of each sentence, its first byte, the byte after its last word).

    A sentence is a run of words up to . ! ? or a newline, or the text's end; those without words don't count."""
    low = LOWER[buf]
    ws, we, text = words(low, offs, ALNUM)
    if not len(ws):
        z = np.zeros(0, np.int64)
        return np.zeros((0, KINDS), np.int32), z, z, z, z
    ends = np.concatenate([[0], np.cumsum(_ENDS[buf])])[ws]
    new = np.ones(len(ws), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    sent = np.cumsum(new) - 1
    pre = prefix_prints(low)
    w = span_prints(pre, ws, we)
    heads = [span_prints(pre, ws, np.minimum(we, ws + k)) for k in HEADS]
    shift, mask = np.uint64(40), np.uint64((1 << BITS) - 1)
    f = np.stack([(v >> shift & mask).astype(np.int32) + (i << BITS) for i, v in enumerate((w, *heads))], 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ws)) - 1
    return f, sent, text[first], ws[first], we[last]


class ToxicityModel:
    def __init__(self):
        self.w = np.zeros(KINDS << BITS, np.float32)
        self.bias = -6.0

    def sentences(self, f: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
        """The log-odds of each sentence."""
        return np.bincount(sent, self.w[f].sum(1), n) + self.bias


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each text; 0 for one without sentences."""
    return -np.expm1(-np.bincount(text, _softplus(z), n))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, mod: int = 5, held: int = 0, epochs: int = 15, rate: float = 0.5, l2: float = 1e-4, seed: int = 1) -> ToxicityModel:
    """Fit on at most ``bound`` labelled documents, of MAX_BYTES in all, with Adagrad. Their feature numbers, not their texts, come to the driver."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs):
                f, sent, text, _, _ = sentence_features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                word_text = text[sent] if len(sent) else sent
                at = np.searchsorted(word_text, np.arange(b - a + 1))
                fs = [f[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                ss = [(sent[i:j] - sent[i] if j > i else sent[i:j]).astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("label"), pa.array(fs, pa.binary()), pa.array(ss, pa.binary())], ["doc_id", "label", "f", "sent"])

    rows = training_sample(docs, labels, "toxic", bound, mod, held).mapInArrow(featurise, "doc_id long, label int, f binary, sent binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.f))
    model = ToxicityModel()
    if not rows:
        return model
    feats = [np.frombuffer(r.f, np.int32).reshape(-1, KINDS) for r in rows]
    sents = [np.frombuffer(r.sent, np.int32) for r in rows]
    label = np.array([r.label for r in rows], float)
    seen = np.zeros((2, KINDS << BITS))
    for f, y in zip(feats, label.astype(int), strict=True):
        seen[y, np.unique(f)] += 1
    total = np.array([(label == 0).sum(), (label == 1).sum()])[:, None]
    has, lacks = seen + 0.5, total - seen + 0.5
    odds = np.log(has[1] / lacks[1]) - np.log(has[0] / lacks[0])
    usable = odds >= LEAST_Z * np.sqrt((1 / has + 1 / lacks).sum(0))
    w, acc = np.zeros(KINDS << BITS), np.full(KINDS << BITS, 0.05)
    bias, bias_acc = model.bias, 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 32):
            part = [j for j in order[i : i + 32] if len(sents[j])]
            if not part:
                continue
            count = np.array([sents[j][-1] + 1 for j in part])
            lead = np.cumsum(count) - count
            sent = np.concatenate([sents[j] + k for j, k in zip(part, lead, strict=True)])
            f = np.concatenate([feats[j] for j in part])
            text = np.repeat(np.arange(len(part)), count)
            z = np.bincount(sent, w[f].sum(1), int(count.sum())) + bias
            s = np.maximum(np.bincount(text, _softplus(z), len(part)), 1e-6)
            y = label[part]
            down = np.where(y == 1, np.maximum(-np.exp(-s) / -np.expm1(-s), -20.0), 1.0)
            g = (down[text] / (1 + np.exp(-np.clip(z, -60, 60)))) / len(part)
            hit, inv = np.unique(f.ravel(), return_inverse=True)
            gf = np.where(usable[hit], np.bincount(inv, np.repeat(g[sent], KINDS), len(hit)) + l2 * w[hit], 0.0)
            acc[hit] += gf * gf
            w[hit] -= rate * gf / np.sqrt(acc[hit])
            gb = float(g.sum())
            bias_acc += gb * gb
            bias -= 0.1 * rate * gb / bias_acc**0.5
    model.w, model.bias = w.astype(np.float32), float(bias)
    return model


def _score(model: Any, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            n = batch.num_rows
            score, spans = np.zeros(n), [np.zeros(0, np.int64)]
            count = np.zeros(n, np.int64)
            for a, b in chunks(offs):
                f, sent, text, s0, s1 = sentence_features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                z = m.sentences(f, sent, len(text))
                score[a:b] = noisy_or(z, text, b - a)
                bad = np.flatnonzero(z >= 0)
                base = offs[a:b][text[bad]] - offs[a]
                spans.append(np.stack([s0[bad] - base, s1[bad] - base], 1).ravel())
                count[a:b] = np.bincount(text[bad], minlength=b - a)
            ids, hold = batch.column("doc_id"), batch.column("held_out")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]), pa.int32()), pa.array(np.concatenate(spans), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, hold, pa.array(score), pa.array((score >= threshold).astype(np.int32)), lists], ["doc_id", "held_out", "score", "predicted", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, mod: int = 5, held: int = 0) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, held_out, score, predicted, offending``.

    ``offending`` lists first byte and end byte, in turn, of each sentence that is itself more likely toxic than not. A
    null text, or one without words, scores 0. A null id gives a null ``held_out``; repeated rows repeat; other columns
    are ignored; an empty table gives no rows, and a text of any length is read whole. One scan, no shuffle; the model has a fixed size of 4 MB and is broadcast."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(mod, held).alias("held_out"))
    return src.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), "doc_id long, held_out boolean, score double, predicted int, offending array<long>")
