"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import LOWER, chunks, string_column

ORDERS = (1, 2, 3, 4)
#: Buckets of each order, and the matrix's bound: more languages share fewer buckets.
BITS = 16
MATRIX_BYTES = 64 << 20
SMOOTHING = 0.5
#: A text's score is calibrated as if it had at most so many n-grams; its language comes from all of them.
MAX_EVIDENCE = 60.0
LETTER = r"\p{L}"
BLOCK = 4096
HELD_LANGUAGES = 16
PIECE = 1 << 21


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets of the texts in them) of UTF-8 bytes, A-Z lowered."""
    low = LOWER[buf]
    first = np.flatnonzero((low & 0xC0) != 0x80)
    lead = low[first].astype(np.uint32)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 1, lead, lead & (0x7F >> size).astype(np.uint32))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << np.uint32(6) | low[first[more] + k] & 0x3F
    return code, np.searchsorted(first, offs)


def grams(code: np.ndarray, offs: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of ``order`` characters, offsets of the texts in them): none crosses two texts."""
    size = np.maximum(np.diff(offs) - order + 1, 0)
    out = np.concatenate([[0], np.cumsum(size)])
    if not out[-1]:
        return np.zeros(0, np.int64), out
    n = len(code) - order + 1
    h = np.full(n, order * 0x3C6EF35F & 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for j in range(order):
            h = (h ^ code[j : j + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
    inner = np.ones(n, bool)
    for j in range(1, order):
        cut = offs[1:-1] - j
        inner[cut[(cut >= 0) & (cut < n)]] = False
    return (h[inner] >> np.uint32(32 - bits)).astype(np.int64), out


def gram_scores(buf: np.ndarray, offs: np.ndarray, logp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) sums of log-probabilities over each text's n-grams, and their number.

    The batch is a sparse matrix of texts by buckets, kept as the buckets of each text; PIECE numbers of its product
    with the log-probabilities are held at a time."""
    code, at = characters(buf, offs)
    n = len(offs) - 1
    out, count = np.zeros((n, logp.shape[1])), np.zeros(n, np.int64)
    step = max(1, PIECE // max(1, logp.shape[1]))
    for i, order in enumerate(ORDERS):
        g, lead = grams(code, at, order, bits)
        g += i << bits
        size = np.diff(lead)
        count += size
        for a in range(0, len(g), step):
            b = min(a + step, len(g))
            t0 = int(np.searchsorted(lead, a, "right")) - 1
            t1 = int(np.searchsorted(lead, b, "left"))
            mine = t0 + np.flatnonzero(size[t0:t1])
            out[mine] += np.add.reduceat(logp[g[a:b]], np.maximum(lead[mine], a) - a, axis=0, dtype=np.float64)
    return out, count


def _count(bits: int):
    """``lang, part, counts``: blocks of n-gram counts of each language met, HELD_LANGUAGES of which are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                parts = [p for p in range(0, len(counts), BLOCK) if counts[p : p + BLOCK].any()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array([p // BLOCK for p in parts], pa.int32()), pa.array([counts[p : p + BLOCK].tobytes() for p in parts], pa.binary())], ["lang", "part", "counts"])
            total.clear()

        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            which = np.asarray(names.indices)
            for a, b in chunks(offs):
                code, at = characters(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                here = [grams(code, at, order, bits) for order in ORDERS]
                for k in np.unique(which[a:b]):
                    lang = names.dictionary[int(k)].as_py()
                    if lang not in total:
                        if len(total) >= HELD_LANGUAGES:
                            yield from flush()
                        total[lang] = np.zeros(len(ORDERS) << bits, np.int64)
                    mine = which[a:b] == k
                    for i, (g, lead) in enumerate(here):
                        total[lang][i << bits : (i + 1) << bits] += np.bincount(g[np.repeat(mine, np.diff(lead))], minlength=1 << bits)
        yield from flush()

    return run


def _sum_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
    return pa.table({"lang": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


class LanguageModel:
    """Log-probabilities of n-gram buckets by language, of at most MATRIX_BYTES, and of the languages."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, bits: int = BITS):
        self.langs, self.logp, self.prior, self.bits = langs, logp, prior, bits


def bits_for(n_languages: int) -> int:
    """Buckets of each order: 2**BITS, or as many as keep the matrix within MATRIX_BYTES, 256 at least."""
    return max(8, min(BITS, int(math.log2(MATRIX_BYTES / (4 * len(ORDERS) * max(1, n_languages))))))


def train(docs: DataFrame) -> LanguageModel:
    """Learn from every row's ``text`` and non-null ``lang``; counts are summed on the executors by language and block.

    Any number of languages is learned; the more there are, the fewer buckets tell their n-grams apart, so that the
    matrix stays within MATRIX_BYTES. The list of languages itself and their row counts come to the driver."""
    known = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = sorted((r[0], r[1]) for r in known.groupBy("lang").count().collect())
    langs = [x for x, _ in per]
    bits = bits_for(len(langs))
    counts = np.zeros((len(ORDERS) << bits, len(langs)), np.float32)
    if langs:
        number = {x: i for i, x in enumerate(langs)}
        schema = "lang string, part int, counts binary"
        for r in known.mapInArrow(_count(bits), schema).groupBy("lang", "part").applyInArrow(_sum_blocks, schema).toLocalIterator():
            counts[r[1] * BLOCK : (r[1] + 1) * BLOCK, number[r[0]]] = np.frombuffer(r[2], np.int64)
    for i in range(len(ORDERS)):
        part = counts[i << bits : (i + 1) << bits]
        part[:] = np.log(part + SMOOTHING) - np.log(part.sum(0, dtype=np.float64) + SMOOTHING * (1 << bits))
    prior = np.log(np.array([n for _, n in per], float)) - np.log(max(1, sum(n for _, n in per)))
    return LanguageModel(langs, counts, prior, bits)


def _predict(model: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if m.langs:
                for a, b in chunks(offs):
                    s, count = gram_scores(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], m.logp, m.bits)
                    top = (s + m.prior).argmax(1)
                    s = s * np.minimum(1.0, MAX_EVIDENCE / np.maximum(count, 1))[:, None] + m.prior
                    p = np.exp(s - s.max(1, keepdims=True))
                    best[a:b] = top
                    score[a:b] = p[np.arange(b - a), top] / p.sum(1)
            best[~letter], score[~letter] = -1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, mod: int = 4, held: int = 2) -> DataFrame:
    """Predict the language of every whole text: ``doc_id, held_out, lang_pred, score``.

    ``lang_pred`` is a learned language, or 'und' with score 0 for a null text, one without a letter, or where nothing
    was learned; all n-grams of the text, however long, and the prior decide it. ``score`` is a calibrated confidence:
    the posterior of the prediction with the evidence of a text of more than MAX_EVIDENCE n-grams scaled to that many,
    so that long texts stay comparable. Ties go to the first language by name. A null doc_id gives a null ``held_out``;
    repeated rows repeat; other columns are ignored; an empty table gives no rows. No shuffle: the matrix is broadcast.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letter"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == held).alias("held_out"))
    return src.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_held_out(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod ``mod`` is not ``held`` and predict for all. A null id is in neither part."""
    part = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % mod
    return identify(docs, train(docs.where(part != held)), mod, held)
