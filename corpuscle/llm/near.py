"""MinHash near-duplicate removal with min-max hashing.

Every hash function of a set gives two values, its minimum and its maximum, both of which two sets share with a chance
equal to their Jaccard similarity; so ``hashes`` evaluations make ``2 * hashes`` signature values. They are cut into
bands of ``rows`` values. Sets that share a band are candidates, and candidates are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .scratch import Scratch
from .textops import LOWER, SPACE, chunks, mix, prefix_prints, signed, span_prints, string_column, words

HASHES, ROWS = 75, 5
#: Larger families are cut into blocks of some HUBS sets, at most BLOCKS of them unless one would have over FAMILY_SHINGLES shingles.
HUBS = 256
BLOCKS = 64
#: A family of candidates up to these sizes is compared in one task.
FAMILY_SETS = 1000
FAMILY_SHINGLES = 2_000_000
SALTS = 16
_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle prints of every text: (values sorted by text and value, offsets).

    Fewer than ``k`` words, but not none, make one shingle of them all."""
    low = LOWER[buf]
    start, end, text = words(low, offs, SPACE)
    n = len(offs) - 1
    count = np.bincount(text, minlength=n)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    w = span_prints(prefix_prints(low), start, end)
    lead = np.concatenate([[0], np.cumsum(count)])
    m = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), m)
    first = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + lead[owner]
    length = np.minimum(k, count)[owner]
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = np.minimum(first + j, len(w) - 1)
            h += np.where(j < length, w[at], np.uint64(0)) * _WORD[j]
        h = mix(h + length.astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def signatures(h: np.ndarray, offs: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, 2 * hashes) minima, then maxima, of the texts that have shingles; the others' rows are zero."""
    n = len(offs) - 1
    out = np.zeros((n, 2 * hashes), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        at = offs[full]
        with np.errstate(over="ignore"):
            for i in range(hashes):
                v = h * _MUL[i]
                out[full, i] = np.minimum.reduceat(v, at)
                out[full, hashes + i] = np.maximum.reduceat(v, at)
    return out


def _sketch(k: int, hashes: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs):
                h, o = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
                sig = signatures(h, o, hashes)
                n_bands = 2 * hashes // rows
                bands = np.zeros((b - a, n_bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        bands += sig[:, r : n_bands * rows : rows] * _WORD[r]
                    bands = mix(bands + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5555)), dtype=np.uint64)])
                    other = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * np.uint64(3)), dtype=np.uint64)])
                    s1, s2 = total[o[1:]] - total[o[:-1]], other[o[1:]] - other[o[:-1]]
                size = np.diff(o)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))]), pa.int32()), pa.array(signed(bands[size > 0].ravel())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(signed(s1)), pa.array(signed(s2)), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            for a, b in chunks(offs):
                h, o = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
                raw = [h[o[i] : o[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(raw, pa.binary())], ["rep", "hashes"])

    return run


def _linked(u: int, v: int, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (u + v - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"), strict=True)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if min(len(u), len(v)) * 100 < percent * max(len(u), len(v)):
                    continue
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                ok[i] = _linked(len(u), len(v), (v[at] == u).sum(), percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def family_labels(ids: np.ndarray, h: np.ndarray, offs: np.ndarray, percent: int) -> np.ndarray:
    """The smallest id that each of some sets reaches over links; sets of one id are one node. A set is compared with all others at once, unless those are of its component already."""
    n = len(ids)
    if not n:
        return ids
    values, number = np.unique(h, return_inverse=True)
    size = np.diff(offs)
    label = ids.copy()
    flag = np.zeros(len(values), np.int64)
    for i in range(n):
        other = label != label[i]
        if not other.any() or not size[i]:
            continue
        mine = number[offs[i] : offs[i + 1]]
        flag[mine] = 1
        both = np.add.reduceat(np.append(flag[number], 0), offs[:-1]) * (size > 0)
        flag[mine] = 0
        for x in np.unique(label[other & (both > 0) & _linked(size[i], size, both, percent)]):
            low, high = sorted((int(x), int(label[i])))
            label[label == high] = low
    return label


def cross_links(label: np.ndarray, h: np.ndarray, offs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels that links between the sets ``left`` and the sets ``right`` make one: (the smaller, the larger) of each such step.

    Sets of one label are not compared, those that became one on the way included; so a set of the label that most of ``right`` have meets only the others."""
    label = label.copy()
    found: list[tuple[int, int]] = []
    size = np.diff(offs)
    values, number, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = often[number] > 1  # others are in no intersection
    number = number[shared]
    at = np.concatenate([[0], np.cumsum(shared)])[offs]
    flag = np.zeros(len(values) + 1, np.int32)  # the last is of the place behind all sets

    def held(members: np.ndarray) -> tuple[np.ndarray, ...]:
        n = at[members + 1] - at[members]
        start = np.cumsum(n) - n
        place = np.arange(n.sum()) + np.repeat(at[members] - start, n)
        return members, np.append(number[place], len(values)), start, n > 0

    def most() -> tuple[int, tuple[np.ndarray, ...]]:
        names, n = np.unique(label[right], return_counts=True)
        main = int(names[n.argmax()])
        return main, held(right[label[right] != main])

    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, (main, rest) = held(right), most()
    for i in left:
        members, numbers, start, any_ = rest if label[i] == main else every
        other = label[members] != label[i]
        mine = number[at[i] : at[i + 1]]
        if not other.any() or not len(mine):
            continue
        flag[mine] = 1
        both = np.add.reduceat(flag[numbers], start) * any_
        flag[mine] = 0
        near = np.unique(label[members[other & (both > 0) & _linked(size[i], size[members], both, percent)]])
        for x in near:
            low, high = sorted((int(x), int(label[i])))
            found.append((low, high))
            label[label == high] = low
        if len(near):
            main, rest = most()
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _block_links(percent: int):
    """``a, b``: labels to be one, from two blocks of a family, or one with itself."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        buf, offs = string_column(rows.column("hashes"))
        block = rows.column("block").to_numpy()
        left, right = (np.flatnonzero(block == x.as_py()) for x in key[1:])
        a, b = cross_links(rows.column("label").to_numpy(), np.frombuffer(buf.tobytes(), np.uint64), offs // 8, left, right, percent)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _families(k: int, percent: int):
    """Labels of the members of one family, from their whole texts."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        buf, offs = string_column(rows.column("text"))
        hs, size = [np.zeros(0, np.uint64)], []
        for a, b in chunks(offs):
            h, o = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            hs.append(h)
            size.append(np.diff(o))
        label = family_labels(ids, np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(size))]), percent)
        node, first = np.unique(ids, return_index=True)
        return pa.table({"rep": pa.array(node), "label": pa.array(label[first])})

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct shingle of each set: ``rep, s, n, h``; ``s`` tells several sets of one id apart."""

    for batch in batches:
        ids = np.asarray(batch.column("rep"))
        for i, raw in enumerate(batch.column("hashes")):
            h = np.frombuffer(raw.as_buffer(), np.uint64)
            which = int(np.bitwise_xor.reduce(mix(h)).astype(np.int64)) if len(h) else 0
            for t in range(0, len(h), 1 << 16):
                part = h[t : t + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), ids[i])), pa.array(np.full(len(part), which)), pa.array(np.full(len(part), len(h))), pa.array(signed(part))], ["rep", "s", "n", "h"])


def prefix_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``key, rep``: sets of similarity ``percent`` or more share one of their rarest n - ceil(percent / 100 * n) + 1 shingles, so they meet in a group: a filter that loses none.

    Shingles that a single set has take places among the rarest but make no group."""
    rows = sets.mapInArrow(_shingle_rows, "rep long, s long, n long, h long")
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("rep", "s")
    kept = rows.join(often, "h").withColumn("shared", F.count("*").over(mine)).withColumn("at", F.row_number().over(mine.orderBy("df", "h")))
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("shared"))
    return kept.where(F.col("at") <= room).select(F.col("h").alias("key"), "rep").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS, text: Column | str = "text", family_sets: int = FAMILY_SETS, scratch: Scratch | None = None) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles have 100 * intersection >= percent * union, and all they reach.

    Takes ``doc_id`` and a text; other columns are ignored, whatever their names. Returns ``doc_id, n_shingles,
    component_id, kept`` once for each row. Words are runs of bytes other than space and 0x09-0x0D, A-Z lowered. A null
    or empty text has no shingles and stands alone; a row with a null id stands alone, its component null, kept; rows
    repeated under one id give their rows again with one component, and different texts of one id are documents of that id
    each. An empty table gives no rows.

    Scale: texts that have the same set are first folded into their smallest id (a hash aggregate, so thousands of
    copies cost nothing further). Bands link each set to the smallest id of its bucket, and the components of these
    candidate links are families. A family of at most ``family_sets`` sets and FAMILY_SHINGLES shingles goes to one task
    with its texts, each sent once, and is compared there in full; nothing but labels comes out. In a larger family sets
    first meet the smallest id of each bucket; those of buckets that still hold several components are then grouped
    by their rarest shingles, which is exact, and what groups connect is cut into blocks of about HUBS sets, every two
    of which are one task; sets that are of one component already are not compared. So copies cost a comparison each,
    a set apart from the others of its family one with each of them, the number of Spark jobs doesn't grow, and sets
    that only have common passages meet nowhere. A pair at the threshold shares no band with a chance of about
    (1 - 0.8**5)**30 = 7e-6; what shares one is always compared.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    sketch = src.mapInArrow(_sketch(k, hashes, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")
    sketch = scratch.keep(sketch, "sketch")
    same = ["n_shingles", "s1", "s2"]
    reps = scratch.keep(sketch.where("doc_id is not null and n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "reps")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    pairs = scratch.keep(_meetings(banded, F.min).distinct(), "pairs")
    family = components(pairs, scratch).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    family = scratch.keep(family, "families")
    many = family.join(reps.select("rep", "n_shingles"), "rep").groupBy("family").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
    many = many.where((F.col("sets") > family_sets) | (F.col("shingles") > FAMILY_SHINGLES)).select("family", F.lit(True).alias("large"))
    member = scratch.keep(family.join(many, "family", "left").select(F.col("rep").alias("doc_id"), "family", F.coalesce("large", F.lit(False)).alias("large")), "members")
    texts = src.join(member, "doc_id").dropDuplicates(["doc_id", "text"])
    large = not member.where("large").isEmpty()
    if large:
        texts = scratch.keep(texts, "texts")
    labels = texts.where("not large").groupBy("family").applyInArrow(_families(k, percent), "rep long, label long")
    if large:
        inside = scratch.keep(texts.where("large").mapInArrow(_sets(k), "rep long, hashes binary"), "sets")
        labels = labels.unionByName(_link_large(pairs, banded, inside, percent, scratch))
    labels = scratch.keep(labels, "labels")
    scratch.drop(pairs, family, member, *([texts] if large else []))
    to = reps.select(*same, "rep").join(labels, "rep", "left").select(*same, F.coalesce("label", "rep").alias("component"))
    out = sketch.where("n_shingles > 0").select("doc_id", *same).join(to, same, "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def _meetings(members: DataFrame, which: Any) -> DataFrame:
    """``a, b``: each member of a group ``key`` of several with the group's smallest or largest id."""
    hubs = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), which("rep").alias("hub")).where("lo < hi").select("key", "hub")
    return members.join(hubs, "key").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))


def _link_large(pairs: DataFrame, banded: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``rep, label`` of the members of large families: ``sets`` are compared with the smallest id of each bucket, then what that left apart in blocks, all at once."""

    def confirm(pairs: DataFrame) -> DataFrame:
        """Pairs that are links. The smaller id, a hub, may have any number of partners, so its set goes out to SALTS places."""
        pairs = pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        hubs = sets.join(pairs.select(F.col("a").alias("rep")).distinct(), "rep").select(F.col("rep").alias("a"), F.col("hashes").alias("ha"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
        return scratch.keep(with_b.join(hubs, ["a", "salt"]).select("a", "b", "ha", "hb").mapInArrow(_confirm(percent), "a long, b long"), "edges")

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges, scratch).select(F.col("node").alias("rep"), "label")
        return scratch.keep(sets.select("rep").distinct().join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), "labels")

    def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members of groups that hold several components, with their component."""
        now = members.join(labels, "rep")
        several = now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1")
        return now.join(several.select("key"), "key")

    edges = confirm(pairs.join(sets.select(F.col("rep").alias("a")).distinct(), "a"))
    labels = labelled(edges)
    left = apart(banded.join(sets.select("rep").distinct(), "rep"), labels).select("rep").distinct()
    groups = prefix_groups(sets.join(left, "rep"), percent)
    # what is still apart in a group is compared with all that groups connect it with, every two blocks in a task
    left = scratch.keep(apart(groups, labels).select("key", "rep", "label"), "apart")
    parts = components(_meetings(left.select("key", "rep"), F.min).distinct(), scratch).select(F.col("node").alias("rep"), F.col("label").alias("part"))
    left = scratch.keep(left.select("rep", "label").distinct().join(parts, "rep").join(sets, "rep"), "left")
    n = left.groupBy("part").agg(F.count("*").alias("sets"), (F.sum(F.octet_length("hashes")) / 8).alias("shingles"))
    n = n.select("part", F.greatest(F.least(F.ceil(F.col("sets") / HUBS), F.lit(BLOCKS)), F.ceil(F.col("shingles") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    cut = left.join(n, "part").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("part", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "label", "hashes")
    merged = components(scratch.keep(cut.groupBy("part", "p", "q").applyInArrow(_block_links(percent), "a long, b long"), "links"), scratch)
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(merged, "label", "left").select("rep", F.coalesce("to", "label").alias("label"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """``docs`` without the near-duplicates of a smaller id; all columns as they are. Rows with a null id stay."""
    gone = near_duplicates(docs, k, percent, hashes, rows).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
