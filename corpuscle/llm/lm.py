"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot). A class holds words with like
predecessors; its slots are its most frequent words, one each, and groups of its other words. Both softmaxes sum the
weight rows of the same hashed features of the history: the previous word, the previous two (n-grams), and the words two
and three back alone (skips), told apart by their full 64-bit prints; the second softmax hashes them with the class. Only
the last factor, inside a group, is a relative frequency: the words of a group come from exact counts over all training
documents, unknown ones included.

Training is synchronous. A first pass counts classes and slots by feature row over all training documents, which gives
the start. Each further round sums the gradients of its part of the documents (by hash of the id; the rounds' parts are
all of them) at the same weights, and takes one step scaled by the counted curvature. Sums don't depend on how rows lie in
files or tasks, nor does the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .textops import LOWER, SPACE, chunks, prefix_prints, signed, span_prints, string_column, words

#: At most so many words' counts are broadcast; those of the others are joined.
TOP = 1 << 17
SHAPES = 512
CONTEXTS = 64
CLASSES = 16
SLOTS = 16
ALONE = 8
MAX_BITS = 20
FEATURES = 4
ROUNDS = 3
#: The share of a log-ratio that a weight starts with, tokens of smoothing, length of a step, tokens of its shape that a word's predecessors count as.
START, SMOOTH, RATE, OF_SHAPE = 0.4, 10.0, 2.0, 2.0
BLOCK = 256
FAN_IN = 16
END = np.uint64(0x1D8AF066F5A3B2C1)
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print of every token, shape of every token, offsets of the texts): the words, A-Z lowered, then one end for each text. The shape hashes a word's last three bytes."""
    low = LOWER[buf]
    ws, we, text = words(low, offs, SPACE)
    n = len(offs) - 1
    pre = prefix_prints(low)
    count = np.bincount(text, minlength=n) + 1
    lead = np.concatenate([[0], np.cumsum(count)])
    h = np.full(lead[-1], END, np.uint64)
    shape = np.zeros(lead[-1], np.int64)
    at = np.arange(len(ws)) + text
    h[at] = span_prints(pre, ws, we)
    shape[at] = (span_prints(pre, np.maximum(ws, we - 3), we) >> np.uint64(20)).astype(np.int64) % SHAPES
    return h, shape, lead


class Vocabulary:
    """Counts of the TOP most frequent words and the totals; bounded by that number. Of the words, the CONTEXTS most frequent tell others' predecessors apart."""

    def __init__(self, h: np.ndarray, count: np.ndarray, shape: np.ndarray, n_tokens: int, n_types: int):
        order = np.argsort(h)
        self.h, self.count, self.shape = h[order], count[order], shape[order]
        # prints are spread evenly, so their leading bits lead to within a place or two
        self.shift = np.uint64(64 - max(1, math.ceil(math.log2(len(h) + 2)) + 1))
        n_heads = 1 << (64 - int(self.shift))
        self.head = np.searchsorted(self.h, np.arange(n_heads, dtype=np.uint64) << self.shift)
        self.head = np.append(self.head, len(h)).astype(np.int32)
        self.padded = np.append(self.h, np.uint64(0))
        self.n_tokens, self.n_types = n_tokens, n_types
        self.context = np.full(len(h) + SHAPES, -1)
        often = np.argsort(-self.count, kind="stable")[:CONTEXTS]
        self.context[often] = np.arange(len(often))

    def units(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The number of each word: its place among the frequent ones, or behind them its shape's."""
        at = self.head[lead := h >> self.shift]
        out = np.where(self.padded[at] == h, at, len(self.h) + shape)
        left = np.flatnonzero((out >= len(self.h)) & (at + 1 < self.head[lead + np.uint64(1)]))
        while len(left):
            at[left] += 1
            hit = self.padded[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < self.head[lead[left] + np.uint64(1)]]
        return out


def history(h: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens) hashes of each token's history; places before a text's start are one word of their own."""
    place = np.arange(len(h)) - np.repeat(lead[:-1], np.diff(lead))
    back = []
    for k in (1, 2, 3):
        u = np.zeros(len(h), np.uint64)
        if len(h) > k:
            u[k:] = np.where(place[k:] >= k, h[:-k], np.uint64(0))
        back.append(u)
    a, b, c = back
    with np.errstate(over="ignore"):
        return np.stack([a * _SALT[0] + _SALT[1], a * _SALT[1] + b * _SALT[2], b * _SALT[3] + _SALT[4], c * _SALT[4] + _SALT[0]])


def rows(history_: np.ndarray, bits: int, cls: np.ndarray | None = None) -> np.ndarray:
    """(FEATURES, tokens) weight rows: of the class softmax, or, given each token's class, of the slot softmax."""
    with np.errstate(over="ignore"):
        x = history_ if cls is None else history_ + (cls.astype(np.uint64) + np.uint64(1)) * _SALT[2]
        x = (x ^ (x >> np.uint64(29))) * _SALT[0]
        x >>= np.uint64(64 - bits)
        return x.view(np.int64)


def bits_for(n_tokens: int) -> int:
    """Weight rows: 65,536, doubled with every 256-fold of training tokens beyond some ten millions, up to 2**MAX_BITS."""
    return min(MAX_BITS, max(16, round(13 + math.log2(max(n_tokens, 1)) / 8)))


class Maxent:
    """Biases and two tables of 2**bits weight rows, of classes and of slots; ``leaf`` is the class and slot (class * SLOTS + slot) of each word number."""

    def __init__(self, leaf: np.ndarray, class_bias: np.ndarray, slot_bias: np.ndarray, bits: int):
        self.leaf, self.bits = leaf, bits
        self.bias = class_bias.astype(np.float32), slot_bias.astype(np.float32)
        self.w = np.zeros((2, 1 << bits, CLASSES), np.float32)

    def scores(self, level: int, f: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
        """The unnormalised log-probabilities of all classes, or of the slots of each token's class."""
        w = self.w[level]
        z = np.take(w, f[0], axis=0, mode="clip")
        for row in f[1:]:
            z += np.take(w, row, axis=0, mode="clip")
        z += self.bias[0] if cls is None else np.take(self.bias[1], cls, axis=0)
        return np.clip(z, -60, 60, out=z)

    def parts(self, h: np.ndarray, lead: np.ndarray, unit: np.ndarray, size: int) -> Iterator[tuple[slice, tuple, tuple]]:
        """``size`` tokens at a time, for the class and then for the slot softmax: (level, rows, answers, classes)."""
        x, leaf = history(h, lead), self.leaf[unit]
        for i in range(0, len(leaf), size):
            part = slice(i, i + size)
            cls = leaf[part] // SLOTS
            yield part, (0, rows(x[:, part], self.bits), cls, None), (1, rows(x[:, part], self.bits, cls), leaf[part] % SLOTS, cls)

    def log_leaf(self, h: np.ndarray, lead: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log P(class | history) + log P(slot | class, history) of each token."""
        out = np.zeros(len(unit))
        for part, *levels in self.parts(h, lead, unit, 4096):
            for level, f, y, cls in levels:
                z = self.scores(level, f, cls)
                right = z[np.arange(len(y)), y]
                out[part] += right - np.log(np.exp(z, out=z).sum(1))
        return out

    def counts(self, h: np.ndarray, lead: np.ndarray, unit: np.ndarray, total: np.ndarray) -> None:
        """Adds how often each row of either table met each class or slot."""
        for _, *levels in self.parts(h, lead, unit, 1 << 20):
            for level, f, y, _ in levels:
                total[level] += np.bincount((f * CLASSES + y).ravel(), minlength=total[level].size).reshape(total[level].shape)

    def gradient(self, h: np.ndarray, lead: np.ndarray, unit: np.ndarray, total: np.ndarray) -> None:
        """Adds the gradient of the tokens' log-likelihood by the two tables: seen less expected, row by row."""
        for _, *levels in self.parts(h, lead, unit, 1 << 16):
            for level, f, y, cls in levels:
                d = np.empty((len(y), CLASSES), self.w.dtype)
                for i in range(0, len(y), 4096):
                    z = self.scores(level, f[:, i : i + 4096], None if cls is None else cls[i : i + 4096])
                    np.exp(z, out=z)
                    np.divide(z, -z.sum(1, keepdims=True), out=d[i : i + 4096])
                d[np.arange(len(y)), y] += 1
                at = (f[:, :, None] * CLASSES + np.arange(CLASSES)).ravel()
                total[level] += np.bincount(at, np.broadcast_to(d, (FEATURES, *d.shape)).ravel(), total[level].size).reshape(total[level].shape)

    def start(self, seen: np.ndarray) -> None:
        """Weights from counts: a share of each row's smoothed log-ratio of seen to expected."""
        for level, prior in enumerate((np.exp(self.bias[0]), (np.exp(self.bias[1]) * np.exp(self.bias[0])[:, None]).sum(0))):
            n = seen[level].sum(1, keepdims=True)
            self.w[level] = START * np.log((seen[level] + SMOOTH * prior) / ((n + SMOOTH) * prior))

    def step(self, total: np.ndarray, seen: np.ndarray, parts: int) -> None:
        """One step up the gradient of a part of the tokens, each weight's scaled by how often its row met its class or slot in such a part."""
        self.w += (RATE / FEATURES * total / (seen / parts + SMOOTH)).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = string_column(batch.column("text"))
        hs, shapes = [], []
        for a, b in chunks(offs):
            h, shape, _ = tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            hs.append(h)
            shapes.append(shape)
        if hs:
            shape = np.concatenate(shapes)
            h, first, count = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(shape[first].astype(np.int32)), pa.array(count.astype(np.int64))], ["h", "shape", "c"])


BLOCK_SCHEMA = "part long, block int, sums binary"


def _block(part: int, block: int, sums: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int32()), "sums": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-zero blocks of BLOCK rows of one task's table."""
    part = TaskContext.get().partitionId()
    for i in range(0, len(table), BLOCK):
        if table[i : i + BLOCK].any():
            yield from _block(part, i // BLOCK, table[i : i + BLOCK]).to_batches()


def _gather(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer(), np.float32) for x in parts.column("sums")], axis=0, dtype=np.float64)
    return _block(key[0].as_py(), key[1].as_py(), total)


def _assemble(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the tasks' tables; of bounded size, so it may come to the driver.

    Blocks meet in a tree, FAN_IN tasks at a time, so no group grows with the number of tasks."""
    n = parts.rdd.getNumPartitions()
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("part", "block").applyInArrow(_gather, BLOCK_SCHEMA)
        if n <= 1:
            break
    out = np.zeros(math.prod(shape) // CLASSES * CLASSES, np.float64)
    for r in parts.select("block", "sums").toLocalIterator():
        out[r[0] * BLOCK * CLASSES :][: len(r[1]) // 4] = np.frombuffer(r[1], np.float32)
    return out.reshape(shape)


def _predecessors(vocabulary: Any):
    """``key, n``: how often a word number (key / CONTEXTS) followed a context, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        total = np.zeros(len(v.context) * CONTEXTS, np.int32)
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs, 2 << 20):
                h, shape, lead = tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                u = v.units(h, shape)
                c = v.context[u]
                first = np.zeros(len(u), bool)
                first[lead[:-1]] = True
                ok = ~first[1:] & (c[:-1] >= 0)
                total += np.bincount(u[1:][ok] * CONTEXTS + c[:-1][ok], minlength=len(total)).astype(np.int32)
        key = np.flatnonzero(total)
        for i in range(0, len(key), 1 << 16):
            k = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k].astype(np.int64))], ["key", "n"])

    return run


def _clusters(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster numbers of weighted unit rows."""
    if len(x) <= k:
        return np.arange(len(x))
    c = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(20):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            m = near == j
            if m.any():
                v = (x[m] * weight[m, None]).sum(0)
                c[j] = v / np.linalg.norm(v)
    return near


def leaves(table: np.ndarray, tokens_: np.ndarray, shape: np.ndarray, seed: int = 3) -> np.ndarray:
    """Class and slot of each word number, by the square roots of its shares of predecessors (those of its shape count too, as OF_SHAPE tokens), weighted by frequency: CLASSES clusters; in each the ALONE most frequent words have slots to themselves, the others and all shapes are clustered into the remaining slots."""
    rng = np.random.default_rng(seed)
    n_words = len(shape)
    n = table.sum(1)
    of_shape = table[n_words:].copy()
    np.add.at(of_shape, shape, table[:n_words])
    of_shape = (of_shape + 0.05) / (of_shape.sum(1, keepdims=True) + 0.05 * table.shape[1])
    x = np.sqrt((table + OF_SHAPE * of_shape[np.concatenate([shape, np.arange(len(of_shape))])]) / (n[:, None] + OF_SHAPE))
    weight = np.sqrt(n + 1).astype(np.float64)
    cls = _clusters(x, weight, CLASSES, rng)
    slot = np.zeros(len(table), np.int64)
    for k in range(CLASSES):
        m = np.flatnonzero(cls == k)
        words_ = m[m < n_words]
        alone = words_[np.argsort(-tokens_[words_], kind="stable")[:ALONE]]
        slot[alone] = np.arange(len(alone))
        rest = np.setdiff1d(m, alone)
        if len(rest):
            slot[rest] = ALONE + _clusters(x[rest], weight[rest], SLOTS - ALONE, rng)
    return cls * SLOTS + slot


def _sums(vocabulary: Any, model: Any, gradient: bool):
    """The blocks of one task's sums: counts by row, or the gradient at the model's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        total = np.zeros(m.w.shape, np.float64)
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs):
                h, shape, lead = tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                (m.gradient if gradient else m.counts)(h, lead, v.units(h, shape), total)
        yield from _blocks(total.reshape(-1, CLASSES))

    return run


def _score(vocabulary: Any, model: Any, norm: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, log_norm = vocabulary.value, model.value, norm
        log_count = np.append(np.log10(v.count + 1.0), 0.0)
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            n = batch.num_rows
            size, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            common, leaf = np.zeros(n), np.zeros(n)
            rare, rare_n = [np.zeros(0, np.int64)], np.zeros(n, np.int64)
            for a, b in chunks(offs):
                h, shape, lead = tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                doc = np.repeat(np.arange(b - a), np.diff(lead))
                unit = v.units(h, shape)
                in_top = unit < len(v.h)
                size[a:b] = np.diff(lead)
                known[a:b] = np.bincount(doc, in_top, b - a)
                common[a:b] = np.bincount(doc, log_count[np.where(in_top, unit, -1)], b - a)
                rare.append(signed(h[~in_top]))
                rare_n[a:b] = np.bincount(doc[~in_top], minlength=b - a)
                lp = m.log_leaf(h, lead, unit)
                leaf[a:b] = np.bincount(doc, lp / np.log(10) - log_norm[m.leaf[unit]], b - a)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare_n)]), pa.int32()), pa.array(np.concatenate(rare)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(serial, serial + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known), pa.array(common), pa.array(leaf), lists],
                ["row", "doc_id", "held_out", "n_tokens", "known", "common", "leaf", "rare"],
            )
            serial += n

    return run


def _least_step(counts: DataFrame, bound: int) -> tuple[Any, int | None]:
    """(step of a count, the least step of frequent words): those from the least count, in steps of a ninth, that keeps within ``bound`` words.

    A histogram of at most some hundred steps decides, so no task has to sort what all others hold."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 6).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > bound:
            break
        least = r["step"]
    return step, least


def _model(train: DataFrame, counts: DataFrame, n_tokens: int, n_types: int, rounds: int, top: int) -> tuple[Vocabulary, Maxent, np.ndarray]:
    """(vocabulary, trained model, log10 of each leaf's words and tokens) of some documents whose words are counted."""
    sc = train.sparkSession.sparkContext
    step, least = _least_step(counts, top)
    often = F.lit(False) if least is None else step >= least
    frequent = counts.where(often).select("h", "c", "shape").toArrow()
    h, c, shape = (frequent.column(k).to_numpy().astype(np.int64) for k in ("h", "c", "shape"))
    vocabulary = Vocabulary(h.view(np.uint64), c, shape, n_tokens, n_types)
    n_words = len(vocabulary.h)
    held_v = sc.broadcast(vocabulary)
    found = train.mapInArrow(_predecessors(held_v), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(((n_words + SHAPES), CONTEXTS), np.float32)
    table.reshape(-1)[found.column("key").to_numpy()] = found.column("n").to_numpy()
    # tokens and types of each word number: a frequent word's own, and of all other words by shape
    tokens_, types = np.zeros(n_words + SHAPES), np.zeros(n_words + SHAPES)
    tokens_[:n_words], types[:n_words] = vocabulary.count, 1
    for r in counts.where(~often).groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens_[n_words + r["shape"]], types[n_words + r["shape"]] = r["c"], r["n"]
    leaf = leaves(table, tokens_, vocabulary.shape)
    per_leaf = np.bincount(leaf, tokens_, CLASSES * SLOTS).reshape(CLASSES, SLOTS)
    class_bias = np.log((per_leaf.sum(1) + 1) / (per_leaf.sum() + CLASSES))
    slot_bias = np.log((per_leaf + 0.1) / (per_leaf.sum(1, keepdims=True) + 0.1 * SLOTS))
    model = Maxent(leaf, class_bias, slot_bias, bits_for(n_tokens))
    seen = _assemble(train.mapInArrow(_sums(held_v, sc.broadcast(model), False), BLOCK_SCHEMA), model.w.shape)
    model.start(seen)
    for r in range(rounds):
        # the rounds share out the documents, so that all of them have trained the model
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        total = _assemble(part.mapInArrow(_sums(held_v, sc.broadcast(model), True), BLOCK_SCHEMA), model.w.shape)
        model.step(total, seen, rounds)
    norm = np.log10(np.bincount(leaf, tokens_ + types, CLASSES * SLOTS) + 1)
    return vocabulary, model, norm


def score_texts(docs: DataFrame, mod: int = 7, held: int = 2, rounds: int = ROUNDS, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod ``mod`` is not ``held`` and score every whole text.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each input row. Tokens
    are runs of bytes other than space and 0x09-0x0D, A-Z lowered, then one end; a null text is empty and has the end
    alone; a text of any length is scored whole, in pieces of whole texts. ``base_score`` sums log10((c + 1) /
    (N + V + 1)) over the tokens, ``score`` is the model's log10 probability of the text; a word unknown to training has
    the count 0 in its slot. A row with a null id is scored, not learned from, and its ``held_out`` is null; repeated
    rows count and repeat; other columns are ignored; an empty table gives none.

    Scale: counts are exact over all training documents, summed on the executors by word. The ``top`` most frequent
    words are broadcast, the rest of each text's words are joined to the counts, summed by row and word first, so no
    vocabulary is gathered. The two weight tables have 8 MB, which grow slowly with the tokens (``bits_for``) to 128 MB
    at most; a round sends one pair from each task to be summed by block of rows, in a tree of bounded fan-in.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    sc = docs.sparkSession.sparkContext
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", part == held)
    train = src.where(~F.col("held_out"))
    counts = scratch.keep(train.mapInArrow(_count, "h long, shape int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape")), "counts")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocabulary, model, norm = _model(train.select("doc_id", "text"), counts, n_tokens, n_types, rounds, top)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, common double, leaf double, rare array<long>"
    scored = scratch.keep(src.mapInArrow(_score(sc.broadcast(vocabulary), sc.broadcast(model), norm), schema), "scored")
    rest = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").count().join(counts.select("h", "c"), "h")
    rest = rest.groupBy("row").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("l"))
    out = scored.drop("rare").join(rest, "row", "left")
    shared = F.col("common") + F.coalesce("l", F.lit(0.0))
    base = shared - F.col("n_tokens") * F.log10(F.lit(float(n_tokens + n_types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (shared + F.col("leaf")).alias("score"))
