"""Removal of repeated byte strings by bucket-pointer refinement of a suffix array, distributed by bucket.

Suffixes that share their first 40 bytes are one initial bucket, named by a fingerprint (of the prints of the 20-grams at
its two halves), so that executors agree on it without a global rank. A distributed sort by the name puts a bucket's suffixes side by side, and buckets of
one suffix are dropped. Inside the others a bucket is refined by sorting its suffixes on the bucket numbers that they
reach at later offsets: the numbers at p and p + 40 give those of depth 80, and these, as updated, at p and p + 20 those
of depth 100. Only a bucket too large for one task names its deeper buckets by fingerprints of the pair instead.

Only the initial buckets that a window of 100 bytes can't avoid are sorted: those of its minimizer, the smallest name
inside the window. Equal windows have equal minimizers, so no repeat is lost, and some three suffixes in a hundred are
moved between executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .textops import chunks, gram_prints, mix, prefix_prints, signed, span_prints, string_column

DEPTHS = (20, 40, 80, 100)
LENGTH = DEPTHS[-1]
GRAM = DEPTHS[1]
CHUNK = 2 << 20
#: Runs are found in pieces of this size, whose arrays stay in a core's cache.
PIECE = 1 << 17
#: So many contexts, and the rest of the last bucket, are refined at once.
CONTEXTS = 2000
HOT_ROWS = 20_000
HOT_BUCKETS = 100_000
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def bucket_ids(buf: np.ndarray, depth: int) -> np.ndarray:
    """The bucket's name at ``depth`` of every suffix that is that long, without any sorting: a fingerprint of its q-gram, or of the names at two offsets."""
    ids = gram_prints(prefix_prints(buf), DEPTHS[0])
    for at, nxt in zip(DEPTHS, DEPTHS[1:]):
        if at >= depth:
            break
        h = nxt - at  # the later offset: its bucket, as deep as this one, ends where the refined bucket ends
        with np.errstate(over="ignore"):
            ids = mix(ids[: max(0, len(ids) - h)] * _PAIR + ids[h:])
    return ids


def refine(buf: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of the bucket at depth 100 of the ``n`` suffixes from each place ``first`` on.

    Each round sorts suffixes on (bucket, bucket at the later offset) and numbers the groups afresh; the next round
    reads these numbers. A suffix alone in its bucket stays so and is not sorted again."""
    reach = lambda more: (np.repeat(first, n + more) + _steps(n + more)) if len(n) else first
    names = bucket_ids(buf, GRAM)
    bucket = np.zeros(len(names), np.int64)
    here = reach(LENGTH - GRAM)
    _, bucket[here], often = np.unique(names[here], return_inverse=True, return_counts=True)
    for at, nxt in zip(DEPTHS[1:], DEPTHS[2:]):
        here = reach(LENGTH - nxt)
        several = often[bucket[here]] > 1
        sort = here[several]
        pointer = bucket[sort] * (len(names) + 1) + bucket[sort + nxt - at]
        _, refined, often = np.unique(pointer, return_inverse=True, return_counts=True)
        bucket = np.zeros(len(names), np.int64)
        bucket[sort] = refined
        bucket[here[~several]] = len(often) + np.arange(len(here) - len(sort))
        often = np.append(often, np.ones(len(here) - len(sort), np.int64))
    return bucket[here] if len(here) else np.zeros(0, np.int64)


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``n``."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(identifier, text, first window in the text, windows) of every run of windows of one text that share their minimizer, the leftmost smallest identifier."""
    z = np.zeros(0, np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return z.astype(np.uint64), z, z, z
    ids = bucket_ids(buf, GRAM)
    w, least, width = LENGTH - GRAM + 1, ids, 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[w - width : w - width + n])
    new = np.ones(n, bool)
    # the minimizer moves on where its value does, or where the window before began with it
    new[1:] = (least[1:] != least[:-1]) | (ids[: n - 1] == least[:-1])
    # a text's windows end where they would reach into the next one
    for edge in (offs[:-1], offs[1:][np.diff(offs) >= LENGTH] - LENGTH + 1):
        new[edge[edge < n]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    text = np.searchsorted(offs, first, "right") - 1
    inside = first + LENGTH <= offs[text + 1]
    first, length, text = first[inside], length[inside], text[inside]
    return least[first], text, first - offs[text], length


def _piece_runs(buf: np.ndarray, offs: np.ndarray, whole: bool = False) -> tuple[np.ndarray, ...]:
    """``runs`` of texts of any total size; with ``whole`` also a print of each run's bytes."""
    out = []
    for a, b in chunks(offs, PIECE):
        part = buf[offs[a] : offs[b]]
        o = offs[a : b + 1] - offs[a]
        h, t, s, n = runs(part, o)
        lo = o[t] + s
        out.append((h, t + a, s, n, *([span_prints(prefix_prints(part), lo, lo + n - 1 + LENGTH)] if whole else [])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * whole


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket a batch meets (n: how often), and, spread at random (n: -1), all suffixes of those met twice."""
    for batch in batches:
        h, t, s, _ = _piece_runs(*string_column(batch.column("text")))
        ids = np.asarray(batch.column("doc_id"))[t] if len(t) else t
        _, first, inv, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inv] > 1)
        key = np.concatenate([h[first], mix(h[again] + (s[again] * 31 + t[again]).astype(np.uint64))])
        pick = np.concatenate([first, again])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(key)), pa.array(ids[pick].astype(np.int64)), pa.array(s[pick].astype(np.int32)), pa.array(np.concatenate([count, np.full(len(again), -1)]).astype(np.int32))],
            ["k", "doc_id", "s", "n"],
        )


def _several(rows: DataFrame) -> DataFrame:
    """``doc_id, s`` of suffixes in a bucket of several, from rows of ``_minimizers``. No Python: nearly all rows go here."""
    rows = rows.withColumn("met", F.count("*").over(Window.partitionBy("k")))
    return rows.where("n = -1 or n = 1 and met > 1").select("doc_id", "s")


def _intervals(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte) that windows starting at ``s`` cover, from sorted distinct windows."""
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    e = np.append(a[1:], len(s)) - 1
    return (doc[a], s[a], s[e] + LENGTH) if len(s) else (doc[:0], s[:0], s[:0])


SUFFIX = "h long, doc_id long, s int, n int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run in a bucket of several: rows with a context, for the next refinement, and rows without, of runs that an earlier place in the batch repeats whole."""
    for batch in batches:
        buf, offs = string_column(batch.column("text"))
        doc_ids = np.asarray(batch.column("doc_id"))
        f_offs, values = np.asarray(batch.column("flagged").offsets), np.asarray(batch.column("flagged").values)
        for a, b in chunks(offs, CHUNK):
            part = buf[offs[a] : offs[b]]
            place = offs[a : b + 1] - offs[a]
            h, t, s, n, whole = _piece_runs(part, place, True)
            mine = np.zeros(len(part), bool)
            mine[values[f_offs[a] : f_offs[b]] + np.repeat(place[:-1], np.diff(f_offs[a : b + 1]))] = True
            lo = place[t] + s
            hit = mine[lo]
            h, t, s, n, whole, lo = h[hit], t[hit], s[hit], n[hit], whole[hit], lo[hit]
            if not len(h):
                continue
            hi = lo + n - 1 + LENGTH
            doc = doc_ids[a:b][t]
            x = np.argsort(whole)
            same = whole[x[1:]] == whole[x[:-1]]
            alone = ~(np.append(same, False) | np.append(False, same))
            new, x = x[alone], x[~alone]
            x = x[np.lexsort((s[x], doc[x], h[x], whole[x]))]
            first = np.ones(len(x), bool)
            first[1:] = (whole[x[1:]] != whole[x[:-1]]) | (h[x[1:]] != h[x[:-1]]) | (n[x[1:]] != n[x[:-1]])
            # rows of one place (repeated rows of an id) are no repeats of each other: those of the first place are dropped
            lead = x[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
            later = (doc[x] != doc[lead]) | (s[x] != s[lead])
            new, old = np.sort(np.append(new, x[first])), np.sort(x[later])
            raw = part.tobytes()
            pick = np.concatenate([new, old])
            context = [raw[i:j] for i, j in zip(lo[new].tolist(), hi[new].tolist(), strict=True)] + [None] * len(old)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[pick])), pa.array(doc[pick]), pa.array(s[pick].astype(np.int32)), pa.array(n[pick].astype(np.int32)), pa.array(context, pa.binary())], ["h", "doc_id", "s", "n", "context"])


def _windows(rows: pa.Table | pa.RecordBatch, sort: bool) -> tuple[np.ndarray, ...]:
    """(h, bucket at depth 100, text, window) of every window of some contexts: a number got by sorting, which holds among these rows, or a name."""
    buf, offs = string_column(rows.column("context"))
    n = np.asarray(rows.column("n")).astype(np.int64)
    at = _steps(n)
    deep = refine(buf, offs[:-1], n) if sort else bucket_ids(buf, LENGTH)[np.repeat(offs[:-1], n) + at]
    h, doc, s = (np.repeat(np.asarray(rows.column(c)).astype(np.int64), n) for c in ("h", "doc_id", "s"))
    return h, deep, doc, s + at


def _later(deep: np.ndarray, doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The windows that are not at the first place of their string, whose number is ``deep``. Rows of one place (repeated rows of an id) are no repeats of each other."""
    x = np.flatnonzero(np.bincount(deep)[deep] > 1)
    if not len(x):
        return x
    x = x[np.argsort(deep[x])]
    new = np.append(True, deep[x[1:]] != deep[x[:-1]])
    group, start = np.cumsum(new) - 1, np.flatnonzero(new)
    d = np.minimum.reduceat(doc[x], start)[group]
    p = np.minimum.reduceat(np.where(doc[x] == d, s[x], np.iinfo(np.int64).max), start)[group]
    return x[(doc[x] != d) | (s[x] != p)]


def _found(doc: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((s, doc))
    d, a, e = _intervals(doc[order], s[order])
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int64)), pa.array(e.astype(np.int64))], ["doc_id", "a", "e"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refine whole buckets, of rows sorted by bucket, to depth 100; at most one bucket and one batch are held."""
    batches = (b.slice(i, CONTEXTS) for b in batches for i in range(0, b.num_rows, CONTEXTS))

    def done(rows: pa.Table) -> pa.RecordBatch:
        _, deep, doc, s = _windows(rows, True)
        later = _later(deep, doc, s)
        return _found(doc[later], s[later])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        h = np.asarray(batch.column("h"))
        if not len(h):
            continue
        if held and held[-1].column("h")[0].as_py() != h[0]:
            yield done(pa.Table.from_batches(held))
            held = []
        cut = int(np.searchsorted(h, h[-1], "left"))
        if cut:
            yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(pa.Table.from_batches(held))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of hot buckets as a row, and none twice in a batch."""
    for batch in batches:
        h, deep, doc, s = _windows(batch, False)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(signed(deep)), pa.array(doc), pa.array(s)], ["h", "deep", "doc_id", "s"])


def _cover_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _found(np.asarray(batch.column("doc_id")), np.asarray(batch.column("s")))


def _cut(emit_text: bool, span_name: str, copy_name: str):
    """Removes the given intervals from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_column(batch.column("text"))
            copy = np.asarray(batch.column(copy_name))
            spans = batch.column(span_name)
            ends = np.asarray(spans.offsets)
            flat = spans.values
            a_all, e_all = (np.asarray(flat.field(c)).astype(np.int64) for c in ("a", "e"))
            size = np.diff(offs)
            removed, n_spans, shas, kept = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], []
            for i in range(len(size)):
                text = buf[offs[i] : offs[i + 1]]
                if copy[i]:
                    removed[i], n_spans[i], text = size[i], 1, text[:0]
                elif ends[i + 1] > ends[i]:
                    a, e = a_all[ends[i] : ends[i + 1]], np.minimum(e_all[ends[i] : ends[i + 1]], size[i])
                    edge = np.zeros(size[i] + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, e, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed[i] = gone.sum()
                    n_spans[i] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                    text = text[~gone]
                raw = text.tobytes()
                kept.append(raw) if emit_text else shas.append(hashlib.sha256(raw).hexdigest())
            if emit_text:
                rest = [c for c in batch.schema.names if c not in ("text", copy_name, span_name)]
                new = [r.decode("utf-8", "ignore") if ok else None for ok, r in zip(batch.column("text").is_valid().to_pylist(), kept, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(new, pa.string())], [*rest, "text"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(removed), pa.array(n_spans), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _repeated(docs: DataFrame, scratch: Scratch, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, spans) of every text that repeats an earlier string, and (doc_id) of the whole copies, of ``docs(doc_id, text)``."""
    digest = scratch.keep(docs.where("doc_id is not null").select("doc_id", F.octet_length("text").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digest")
    digest = digest.where(F.col("n_bytes") >= LENGTH)
    firsts = digest.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # an id whose rows differ is judged row by row: whole copies are ids of one text only
    single = digest.groupBy("doc_id").agg(F.count_distinct("sha").alias("texts")).where("texts = 1").select("doc_id")
    copies = digest.join(firsts, "sha").where("doc_id > first").select("doc_id").distinct().join(single, "doc_id", "left_semi")
    copies = scratch.keep(copies, "copies")
    rows = docs.where("doc_id is not null").mapInArrow(_minimizers, "k long, doc_id long, s int, n int")
    flagged = scratch.keep(_several(rows), "flagged")
    scratch.release()
    lists = flagged.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list("s").alias("flagged"))
    suffixes = scratch.keep(docs.join(lists, "doc_id").select("doc_id", "text", "flagged").mapInArrow(_contexts, SUFFIX), "suffixes")
    scratch.drop(flagged)
    scratch.release()
    again = suffixes.where("context is null").select("doc_id", F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") - 1 + LENGTH).cast("long").alias("e"))
    deep = suffixes.where("context is not null")
    limit = max(hot_rows, suffixes.count() // HOT_BUCKETS)  # so at most HOT_BUCKETS numbers are broadcast
    hot = F.broadcast(deep.groupBy("h").count().where(F.col("count") > limit).select("h"))
    interval = "doc_id long, a long, e long"
    cool = deep.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_resolve, interval)
    windows = deep.join(hot, "h", "left_semi").mapInArrow(_spread, "h long, deep long, doc_id long, s long")
    place = F.struct("doc_id", "s")
    first = windows.groupBy("h", "deep").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "deep", "first")
    later = windows.join(first, ["h", "deep"]).where(place > F.col("first")).select("doc_id", "s").mapInArrow(_cover_windows, interval)
    found = scratch.keep(again.unionByName(cool).unionByName(later), "found")
    scratch.release()
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "e")).alias("spans")), copies


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _with_spans(docs: DataFrame, spans: DataFrame, copies: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with each text's intervals and whether it is a whole copy, under names that are free."""
    s, c, key = _free("spans", docs.columns), _free("copy", docs.columns), _free("of", docs.columns)
    none = F.array().cast("array<struct<a:bigint,e:bigint>>")
    marks = spans.join(copies.select("doc_id", F.lit(True).alias("whole")), "doc_id", "full")
    marks = marks.select(F.col("doc_id").alias(key), F.coalesce("spans", none).alias(s), F.coalesce("whole", F.lit(False)).alias(c))
    out = docs.join(marks, docs["doc_id"] == marks[key], "left").drop(key)
    return out.withColumn(s, F.coalesce(s, none)).withColumn(c, F.coalesce(c, F.lit(False))), s, c


def remove_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """What is left of each text without bytes covered by a 100-byte string that also starts earlier.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each input row. Texts are UTF-8 bytes, a null one
    empty; matches never cross texts; earlier means a smaller doc_id, or the same and an earlier start; overlaps count,
    and strings are judged on the input. Rows of one id count as one document laid over itself: a string that two of
    them hold at the same place is no repeat. A row with a null id takes no part and stays whole. Texts under 100 bytes
    stay whole. Other columns are ignored; an empty table gives no rows.

    Scale: whole copies (by digest) go without further work. Some 3 % of the suffixes are sorted by bucket, a batch's
    own repeats being folded first, so a bucket that a third of all texts share costs a row a batch. Then only runs of
    windows in buckets of several travel, with their 100 to 160 bytes. A bucket of more than ``hot_rows`` different
    runs is not refined in one task but window by window, as a min-aggregate with map-side combining and a join.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans, copies = _repeated(src, scratch, hot_rows)
    marked, s, c = _with_spans(src, spans, copies)
    return marked.select("doc_id", "text", c, s).mapInArrow(_cut(False, s, c), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep_first_strings(docs: DataFrame, hot_rows: int = HOT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with their texts cut as in ``remove_repeats``, all columns kept and in order. Characters of which a part went are dropped whole."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    spans, copies = _repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch, hot_rows)
    rest = [c for c in docs.columns if c != "text"]
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in [*rest, "text"])
    marked, s, c = _with_spans(docs, spans, copies)
    return marked.select(*rest, "text", c, s).mapInArrow(_cut(True, s, c), schema).select(*docs.columns)
