"""Benchmark decontamination with a stored positional inverted index, distributed by document.

Each run of documents is a shard of the index: the postings (term, positions) of all its words, written as one row of a
table, which later searches read again. A benchmark window is answered from the shard's shortest posting list: those
positions, less the term's offset, are candidate starts, intersected with the offset-adjusted posting lists of the other
terms from the rarest up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .textops import ALNUM, LOWER, chunks, prefix_prints, span_prints, string_column, words

WINDOW = 10
#: Text of a shard, and of the benchmark's items that are searched for at once.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(print of every word, index of every text's first word)."""
    low = LOWER[buf]
    start, end, text = words(low, offs, ALNUM)
    return span_prints(prefix_prints(low), start, end), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offs) - 1))])


INDEX = "shard long, doc_id array<long>, key array<string>, words array<long>, terms binary, counts binary, positions binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its texts' ids, keys and numbers of words; its terms in order of their prints; how many postings each has; and all positions, by term, counted through the shard."""
    serial = TaskContext.get().partitionId() << 32
    for batch in batches:
        buf, offs = string_column(batch.column("text"))
        for a, b in chunks(offs, SHARD_BYTES):
            h, lead = _terms(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            row = lambda x: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), x)  # noqa: B023, E731
            raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([serial]), row(_whole(batch.column("doc_id").slice(a, b - a))), row(_whole(batch.column("key").slice(a, b - a))), row(pa.array(np.diff(lead))), raw(terms, np.uint64), raw(counts, np.int32), raw(order, np.int32)],
                ["shard", "doc_id", "key", "words", "terms", "counts", "positions"],
            )
            serial += 1


def _whole(x: pa.Array) -> pa.Array:
    """A slice as an array of its own."""
    return x.take(pa.array(np.arange(len(x))))


def build_index(docs: DataFrame, scratch: Scratch, key: Column | None = None) -> DataFrame:
    """The positional index of all words of ``docs(doc_id, text)``, written and reread: one scan, no shuffle, some 0.8 bytes for each of text before compression. ``key`` is any string kept with each text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit("") if key is None else key).alias("key"))
    return scratch.keep(src.mapInArrow(_index, INDEX), "index")


def compile_windows(ids: list[str], texts: list[str], width: int) -> dict[str, Any]:
    """The windows of some items: term numbers (-1 pads an item of fewer words than ``width``), lengths, item ids."""
    buf, offs = string_column(pa.array(texts, pa.string()))
    h, lead = _terms(buf, offs)
    vocab, tid = np.unique(h, return_inverse=True)
    n = np.diff(lead)
    m = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    item = np.repeat(np.arange(len(n)), m)
    first = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + lead[:-1][item]
    length = np.minimum(n[item], width)
    at = first[:, None] + np.arange(width)[None, :]
    term = np.where(np.arange(width)[None, :] < length[:, None], tid[np.minimum(at, max(len(tid) - 1, 0))] if len(tid) else 0, -1).astype(np.int32)
    return {"vocab": vocab, "term": term, "length": length, "item": item.astype(np.int32), "ids": np.array(ids, object)}


WINDOWS = "block int, vocab binary, term binary, length binary, item binary, ids array<string>"


def _compile(width: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        w = compile_windows(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), width)
        raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "vocab": raw(w["vocab"], np.uint64), "term": raw(w["term"], np.int32), "length": raw(w["length"], np.int64), "item": raw(w["item"], np.int32), "ids": pa.array([w["ids"].tolist()], pa.list_(pa.string()))})

    return run


def blocks(tests: DataFrame, width: int, block_bytes: int, scratch: Scratch) -> Iterator[Any]:
    """Broadcast windows of the benchmark, in blocks of whole items of about ``block_bytes`` of text each.

    Executors compile the blocks into a table; the driver holds one at a time, and drops it when the next is asked for."""
    spark = tests.sparkSession
    t = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    table = t.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(_compile(width), WINDOWS)
    table = scratch.keep(table, "windows")
    for i in range(n):
        for r in table.where(F.col("block") == i).collect():
            read = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: B023, E731
            w = {"vocab": read("vocab", np.uint64), "term": read("term", np.int32).reshape(-1, width), "length": read("length", np.int64), "item": read("item", np.int32), "ids": np.array(r["ids"], object)}
            held = spark.sparkContext.broadcast(w)
            yield held
            held.unpersist()


class Shard:
    """A shard read from the index, with the windows of a benchmark block."""

    def __init__(self, w: dict[str, Any], terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, n_words: np.ndarray):
        self.w = w
        self.lead = np.concatenate([[0], np.cumsum(n_words)])
        at = np.minimum(np.searchsorted(terms, w["vocab"]), max(len(terms) - 1, 0))
        here = terms[at] == w["vocab"] if len(terms) else np.zeros(len(w["vocab"]), bool)
        self.count = np.where(here, counts[at] if len(counts) else 0, 0).astype(np.int64)
        # the postings of the benchmark's terms, as (term, position) in one sorted number
        start = np.cumsum(counts, dtype=np.int64) - counts
        known = np.flatnonzero(here)
        n = self.count[known]
        self.head = np.zeros(len(self.count) + 1, np.int64)
        self.head[1:] = np.cumsum(self.count)
        self.posting = positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at[known]], n)].astype(np.int64)
        self.size = int(self.lead[-1]) + 1
        self.keys = np.repeat(known, n) * self.size + self.posting

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the posting list of a term."""
        want = term.astype(np.int64) * self.size + position
        at = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
        return (self.keys[at] == want) & (position < self.size) if len(self.keys) else np.zeros(len(want), bool)

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, term order from the rarest, position of the rarest term, text) for windows whose terms all occur here."""
        term = self.w["term"]
        if not len(term) or not len(self.posting):
            z = np.zeros(0, np.int64)
            return z, np.zeros((0, term.shape[1]), np.int64), z, z
        freq = np.where(term >= 0, self.count[term], np.iinfo(np.int64).max)
        alive = np.flatnonzero(freq.min(1) > 0)
        order = np.argsort(freq[alive], axis=1, kind="stable")
        rare = term[alive, order[:, 0]]
        n = self.count[rare]
        k = np.repeat(np.arange(len(alive)), n)
        pos = self.posting[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.head[rare][k]]
        return alive[k], order[k], pos, np.searchsorted(self.lead, pos, "right") - 1

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every exact occurrence: (window, start, text)."""
        win, order, pos, text = self.candidates()
        start = pos - order[:, 0]
        ok = (start >= self.lead[text]) & (start + self.w["length"][win] <= self.lead[text + 1])
        win, order, start, text = win[ok], order[ok], start[ok], text[ok]
        for j in range(1, self.w["term"].shape[1]):
            if not len(win):
                break
            o = order[:, j]
            want = self.w["term"][win, o]
            ok = (want < 0) | self.holds(want, start + o)
            win, order, start, text = win[ok], order[ok], start[ok], text[ok]
        return win, start, text

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all terms in order, within the window's length plus ``slop`` words: (window, start, end, text).

        From each posting of the rarest term the others are found outwards, each the nearest of its list."""
        win, order, pos, text = self.candidates()
        size, keys = self.size, self.keys
        pivot = order[:, 0].copy()
        low, high = pos.copy(), pos.copy()
        ok = np.ones(len(win), bool)
        width = self.w["term"].shape[1]
        for step in range(1, width):
            for sign, edge in ((-1, low), (1, high)):
                o = pivot + sign * step
                there = (o >= 0) & (o < self.w["length"][win]) & ok
                i = np.flatnonzero(there)
                if not len(i):
                    continue
                t = self.w["term"][win[i], o[i]].astype(np.int64)
                at = np.searchsorted(keys, t * size + edge[i], "left" if sign < 0 else "right") + (sign < 0) * -1
                good = (at >= 0) & (at < len(keys))
                at = np.clip(at, 0, max(len(keys) - 1, 0))
                good &= keys[at] // size == t
                edge[i] = np.where(good, keys[at] % size, edge[i])
                ok[i[~good]] = False
        ok &= (low >= self.lead[text]) & (high < self.lead[text + 1]) & (high - low + 1 <= self.w["length"][win] + slop)
        return win[ok], low[ok], high[ok] + 1, text[ok]


def _lists(values: np.ndarray | list, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


HITS = "shard long, at int, key string, hits array<long>, items array<string>"


def _search(block: Any, slop: int | None):
    """Hits (start and end word, in turn) and items of each text of the index in which a block finds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = block.value
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                n_words = np.asarray(batch.column("words")[row].values)
                shard = Shard(w, read("terms", np.uint64), read("counts", np.int32), read("positions", np.int32), n_words)
                if slop is None:
                    win, s, text = shard.phrases()
                    e = s + w["length"][win]
                else:
                    win, s, e, text = shard.near(slop)
                if not len(win):
                    continue
                base = shard.lead[text]
                hits = np.unique(np.stack([text, s - base, e - base], 1), axis=0)
                pair = np.unique(np.stack([text, w["item"][win]], 1), axis=0)
                found, n = np.unique(text), len(n_words)
                key = batch.column("key")[row].values.take(pa.array(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").take(pa.array([row] * len(found))), pa.array(found.astype(np.int32)), key, _lists(hits[:, 1:].ravel(), 2 * np.bincount(hits[:, 0], minlength=n)[found], pa.int64()), _lists(w["ids"][pair[:, 1]].tolist(), np.bincount(pair[:, 0], minlength=n)[found], pa.string())],
                    ["shard", "at", "key", "hits", "items"],
                )

    return run


def search_index(index: DataFrame, tests: DataFrame, width: int, slop: int | None, block_bytes: int, scratch: Scratch) -> DataFrame:
    """``shard, at, key, hits, items`` of every text of the index in which a block of the benchmark finds any: one pass over the index for each block."""
    found = None
    for block in blocks(tests, width, block_bytes, scratch):
        part = scratch.keep(index.mapInArrow(_search(block, slop), HITS), "hits")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else index.sparkSession.createDataFrame([], HITS)


def find_passages(docs: DataFrame, tests: DataFrame, width: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Benchmark windows in documents: ``doc_id, n_words, hits, items``, one row for each input row.

    Words are runs of bytes other than the ASCII signs, A-Z lowered. A window is ``width`` consecutive words of an item,
    or all of a shorter item; an item without words has none. ``hits`` lists start and end (exclusive) word of every
    occurrence in turn, ``items`` the ids found, as strings, '' for a null id, an item met in several blocks again.
    ``slop`` None asks for exact phrases, a number for proximity: the window's words in order with up to so many others
    among them. Null texts have no words; repeated rows repeat; a text of any length is indexed whole; other columns are
    ignored; empty tables give no rows or no hits.

    Scale: documents are read once into the index, each shard of about 2 MB of text a row. The benchmark goes out in
    blocks of bounded size, one after the other. Only ids, counts and hits meet in a join, by row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    index = build_index(docs, scratch)
    found = search_index(index, tests, width, slop, block_bytes, scratch)
    found = found.groupBy("shard", "at").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "words"))).select("shard", F.col("pos").alias("at"), F.col("col.doc_id").alias("doc_id"), F.col("col.words").alias("n_words"))
    out = rows.join(found, ["shard", "at"], "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for h in batch.column("hits"):
            if len(h) == 0:
                n.append(0)
                continue
            v = np.array(h.values).reshape(-1, 2)
            v = v[np.argsort(v[:, 0], kind="stable")]
            reach = np.maximum.accumulate(v[:, 1])
            n.append(int((reach - np.maximum(v[:, 0], np.concatenate([[0], reach[:-1]]))).clip(0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), batch.column("items")], ["doc_id", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, tests: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How far each document holds benchmark text: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts words inside any exact occurrence of a window, overlaps once; ``items_sha256`` is of the distinct
    ids, sorted as strings and joined by commas (of '' if none). Rows and edge cases are those of ``find_passages``.
    """
    found = find_passages(docs, tests, width, None, block_bytes)
    found = found.mapInArrow(_cover, "doc_id long, n_words long, n_hit long, items array<string>")
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, tests: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no window of any item.

    The texts found, by digest, are taken out with an anti join. Null texts stay, repeated rows stay or go together."""
    scratch = scratch or Scratch(docs.sparkSession, "clean")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    key = "digest"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    dirty = search_index(build_index(docs, scratch, digest), tests, width, None, block_bytes, scratch).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, digest).join(dirty, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
