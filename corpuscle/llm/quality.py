"""Quality classifier: a linear-chain CRF labels every line of a document good or bad.

Each line has indicator features of its own binned measures and of those of both neighbouring lines. The documents'
labels train it: first every line takes its document's label, then lines of bad documents that the model takes for good
ones are relabelled and the model is fitted again. A document's quality is the mean of its lines' marginal probabilities
of being good, weighted by length, made a probability by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .crf import Chains, Crf
from .labelled import held_out, training_sample
from .textops import LOWER, SPACE, chunks, prefix_prints, span_prints, string_column, words

TRAIN_DOCS = 6000
BINS = 10


def _classes() -> np.ndarray:
    t = np.zeros((256, 7), np.uint8)
    t[0x41:0x5B, 0] = 1
    t[0x61:0x7B, 1] = 1
    t[0x30:0x3A, 2] = 1
    for c in b"!?":
        t[c, 3] = 1
    for c in b"|":
        t[c, 4] = 1
    for c in b"#$%&*@<>{}[]\\^~=+_":
        t[c, 5] = 1
    for c in b".,;:":
        t[c, 6] = 1
    return t


_CLASS = _classes()
N_MEASURES = 13


def line_measures(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, measures), bytes of each line, lines of each text. A line ends at a newline or the text's end; blank ones count, an empty text has none."""
    n = len(offs) - 1
    brk = np.flatnonzero(buf == 10) + 1
    full = np.flatnonzero(np.diff(offs))
    starts = np.unique(np.concatenate([offs[full], brk]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        return np.zeros((0, N_MEASURES)), np.zeros(0), np.zeros(n, np.int64)
    text = np.searchsorted(offs, starts, "right") - 1
    per = np.bincount(text, minlength=n)
    size = np.diff(np.append(starts, len(buf))).astype(float)
    sums = np.stack([np.add.reduceat(_CLASS[:, c][buf], starts, dtype=np.float64) for c in range(7)], 1)
    lat = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) if len(buf) > 1 else np.zeros(0, bool)
    sums[:, 0] += np.add.reduceat(np.append(lat, False), starts, dtype=np.float64)
    ws, we, _ = words(buf, offs, SPACE)
    line = np.searchsorted(starts, ws, "right") - 1
    n_lines = len(starts)
    n_words = np.bincount(line, minlength=n_lines).astype(float)
    h = span_prints(prefix_prints(LOWER[buf]), ws, we)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line, same, n_lines)
    distinct = len(h)
    order = np.lexsort((h, line))
    hs, ls = h[order], line[order]
    new = np.ones(distinct, bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
    kinds = np.bincount(ls[new], minlength=n_lines)
    single = np.bincount(line, (we - ws) == 1, n_lines)
    w, letters = np.maximum(n_words, 1), np.maximum(sums[:, 0] + sums[:, 1], 1)
    out = np.stack(
        [np.log1p(size), np.log1p(n_words), size / w, sums[:, 0] / letters, sums[:, 2] / size, sums[:, 3] / w, sums[:, 4] / w, sums[:, 5] / w, sums[:, 6] / w, again / w, kinds / w, single / w, np.log1p(kinds)], 1
    )
    return out, size, per


def indicators(x: np.ndarray, per: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(lines, 3 * measures + 1) feature numbers: the bins of the line, of the one before and of the one after (or 'none'), and a bias."""
    n, m = x.shape
    own = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), np.int64)
    bins = edges.shape[1] + 2
    none = bins - 1
    before, after = np.full((n, m), none), np.full((n, m), none)
    if n:
        before[1:], after[:-1] = own[:-1], own[1:]
        head = np.cumsum(per) - per
        head = head[per > 0]
        before[head] = none
        after[np.append(head[1:], n) - 1] = none
    base = np.arange(m) * bins
    return np.concatenate([own + base, before + base + m * bins, after + base + 2 * m * bins, np.full((n, 1), 3 * m * bins)], 1)


class QualityModel:
    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.crf = Crf(3 * edges.shape[0] * (edges.shape[1] + 2) + 1)
        self.slope, self.shift = 4.0, -2.0

    def lines(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unary score, bytes) of every line, and the lines of each text."""
        u, size, per = [], [], []
        for a, b in chunks(offs):
            x, s, p = line_measures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            u.append(self.crf.unary(indicators(x, p, self.edges)))
            size.append(s)
            per.append(p)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return cat(u, float), cat(size, float), cat(per, np.int64)

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good quality, lines, lines more likely bad) of each text."""
        u, size, per = self.lines(buf, offs)
        good = self.crf.marginals(u, Chains(per))
        doc = np.repeat(np.arange(len(per)), per)
        mean = _weighted(good, size, doc, len(per))
        return self.probability(mean), per, np.bincount(doc, good < 0.5, len(per)).astype(np.int64)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -30, 30)))


def _weighted(good: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mean by length; a text without lines counts as 0."""
    return np.bincount(doc, good * size, n) / np.maximum(np.bincount(doc, size, n), 1e-9)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, mod: int = 5, held: int = 0) -> QualityModel:
    """Fit on at most ``bound`` labelled documents, of MAX_BYTES in all. Their line measures, not their texts, come to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs):
                x, size, per = line_measures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                end = np.cumsum(per)
                xs = [x[e - p : e].astype(np.float32).tobytes() for e, p in zip(end, per, strict=True)]
                ss = [size[e - p : e].astype(np.float32).tobytes() for e, p in zip(end, per, strict=True)]
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("label"), pa.array(xs, pa.binary()), pa.array(ss, pa.binary())], ["doc_id", "label", "x", "size"])

    rows = training_sample(docs, labels, "quality", bound, mod, held).mapInArrow(measure, "doc_id long, label int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, N_MEASURES) for r in rows]
    x = np.concatenate(xs) if xs else np.zeros((0, N_MEASURES), np.float32)
    if not len(x):
        return QualityModel(np.zeros((N_MEASURES, BINS - 1)))
    size = np.concatenate([np.frombuffer(r.size, np.float32) for r in rows]).astype(float)
    per = np.array([len(v) for v in xs])
    label = np.array([r.label for r in rows])
    model = QualityModel(np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(N_MEASURES)]))
    active, chains = indicators(x.astype(float), per, model.edges), Chains(per)
    doc = np.repeat(np.arange(len(per)), per)
    y = label[doc]
    for _ in range(2):
        model.crf.fit(active, chains, y)
        u = model.crf.unary(active)
        # a bad document keeps its worse half bad; a line that alone looks clearly good is relabelled
        y = np.where((label[doc] == 0) & (u < 0.5), 0, 1)
    good = model.crf.marginals(model.crf.unary(active), chains)
    mean = _weighted(good, size, doc, len(per))
    slope, shift = 4.0, -2.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(slope * mean + shift)))
        d = label - p
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * mean * mean).sum() + 1, (h * mean).sum()], [(h * mean).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * mean).sum() - 0.01 * slope, d.sum()]))
        slope, shift = slope + 0.5 * step[0], shift + 0.5 * step[1]
        if np.abs(step).max() < 1e-4:
            break
    model.slope, model.shift = float(slope), float(shift)
    return model


def _score(model: Any, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            score, per, bad = m.documents(buf, offs)
            ids, hold = batch.column("doc_id"), batch.column("held_out")
            yield pa.RecordBatch.from_arrays([ids, hold, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(per), pa.array(bad)], ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, mod: int = 5, held: int = 0) -> DataFrame:
    """Quality of every whole text: ``doc_id, held_out, score, predicted, n_lines, n_bad``.

    A null or empty text has no lines and gets the score of a text all bad. A null id gives a null ``held_out``;
    repeated rows repeat; other columns are ignored; an empty table gives no rows, and a text of any length is read whole. One scan, no shuffle; the model is a few kB and broadcast."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(mod, held).alias("held_out"))
    return src.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad long")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _, _ = held.value.documents(*string_column(batch.column("text")))
            yield batch.filter(pa.array(score >= threshold))

    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(run, docs.schema)
