"""Arrow kernels over texts: tokens, spans of tokens and packed paragraphs, without a row a token in Spark.

A text's tokens are found in one array of code points; whatever has to be compared as text is built as an Arrow array.
Batches are cut into chunks of about CHUNK bytes of text, so memory doesn't follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
Batches = Iterator[pa.RecordBatch]


def chunks(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with a sum of sizes up to the limit, or one row."""
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_chunks(batches: Batches, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from chunks(b, pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), limit)


def list_chunks(batches: Batches, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from chunks(b, pc.list_value_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), limit)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and where each text begins, with the end; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), at - at[0]
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at - at[0]]
    except UnicodeDecodeError:
        each = [np.frombuffer(raw[a:b].tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _repeated(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, all end to end."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def strings(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces of a text from each start to its end; they may overlap."""
    size = end - start
    c = points[_repeated(start, size)]
    at = np.concatenate([[0], np.cumsum(size)])
    if len(c) and c.max() >= 128:
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])[at]
        raw = c.tobytes().decode("utf-32-le").encode()
    else:
        raw = c.astype(np.uint8).tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


class Scanner:
    """Tokens of many texts: ``row, start, end`` in code points of the row. ``edges`` are where the code points that make tokens begin and end by turns; ``cut`` is a function of one text instead."""

    def __init__(self, edges: np.ndarray | None, cut: Callable[[str], list[tuple[str, int, int]]] | None = None):
        self.edges, self.cut, self._table = edges, cut, None

    def __getstate__(self) -> dict:
        return {"edges": self.edges, "cut": self.cut, "_table": None}

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``points, row_at, row, start, end``: the code points, where rows begin in them, and the tokens."""
        points, row_at = code_points(texts)
        if self.cut is not None:
            found = [(r, a, b) for r, t in enumerate(texts.to_pylist()) for _, a, b in self.cut(t or "")]
            row, start, end = np.array(found, np.int64).reshape(-1, 3).T
            return points, row_at, row, start, end
        if self._table is None:
            self._table = np.zeros(0x110000, bool)
            for a, b in self.edges.reshape(-1, 2):
                self._table[a:b] = True
        w = self._table[points]
        first, last = w.copy(), w.copy()
        if len(w):
            first[1:] &= ~w[:-1]
            last[:-1] &= ~w[1:]
            edge = row_at[(row_at > 0) & (row_at < len(w))]
            first[edge], last[edge - 1] = w[edge], w[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(row_at, start, "right") - 1
        return points, row_at, row, start - row_at[row], end - row_at[row]


def ascii_lower(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def numbered(tokens: pa.Array, lowercase: bool) -> tuple[np.ndarray, pa.Array]:
    """Tokens as numbers of distinct values; if ``lowercase``, A to Z are in lower case already and other letters are put so."""
    e = tokens.dictionary_encode()
    codes, values = e.indices.to_numpy(zero_copy_only=False), e.dictionary
    other = pc.invert(pc.string_is_ascii(values)) if lowercase else None
    if other is not None and pc.any(other).as_py():
        low = pa.array([x.lower() for x in values.filter(other).to_pylist()], pa.string())
        v = pc.replace_with_mask(values, other, low).dictionary_encode()
        codes, values = v.indices.to_numpy(zero_copy_only=False)[codes], v.dictionary
    return codes, values


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _by_document(docs: pa.Array, row: np.ndarray, codes: np.ndarray, values: pa.Array) -> pa.RecordBatch:
    """``doc, items, n``: a row a document, with its distinct values and how often they occur."""
    d = docs.dictionary_encode(null_encoding="encode")
    key = np.sort(d.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * max(1, len(values)) + codes)
    first = _runs(key)
    n, key = np.diff(np.append(first, len(key))), key[first]
    doc, item = np.divmod(key, max(1, len(values)))
    at = _runs(doc)
    offsets = pa.array(np.append(at, len(doc)), pa.int32())
    return pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(doc[at])), pa.ListArray.from_arrays(offsets, values.take(pa.array(item))), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))], names=["doc", "items", "n"])


def document_words(scanner: Scanner, lowercase: bool, least: int) -> Callable[[Batches], Batches]:
    """From ``doc, text`` to ``doc, items, n``: the words of texts with at least so many tokens."""

    def run(batches: Batches) -> Batches:
        for b in text_chunks(batches, "text"):
            points, row_at, row, start, end = scanner.scan(b.column("text"))
            ok = (np.bincount(row, minlength=b.num_rows) >= least)[row]
            row, start, end = row[ok], start[ok], end[ok]
            if len(row):
                if lowercase:
                    points = ascii_lower(points)
                yield _by_document(b.column("doc"), row, *numbered(strings(points, row_at[row] + start, row_at[row] + end), lowercase))

    return run


def summed(batches: Batches) -> Batches:
    """From ``items, n`` of a document each to ``item, count, doc_count``, summed over as many as come together."""
    for b in list_chunks(batches, "items"):
        items, n = b.column("items"), b.column("n")
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(items).to_numpy())
        e = items.flatten().dictionary_encode()
        if not len(row):
            continue
        code, size = e.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(e.dictionary)
        count = np.zeros(size, np.int64)
        np.add.at(count, code, n.flatten().to_numpy())
        key = np.sort(row * size + code)
        yield pa.RecordBatch.from_arrays([e.dictionary, pa.array(count), pa.array(np.bincount(key[_runs(key)] % size, minlength=size), pa.int64())], names=["item", "count", "doc_count"])


# Spans and the filter of names

#: Places of the filter, as a power of two: 4 MB.
BITS = 25
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


class Places:
    """The place in the filter of any piece of a text, from sums over its prefixes."""

    def __init__(self, points: np.ndarray):
        up, self.down = _powers(len(points) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.hashes(start, end) >> np.uint64(64 - BITS)).astype(np.int64)


def name_places(batches: Batches) -> Batches:
    """From ``name`` to ``bits``: the filter of a partition's names, compressed."""
    import zlib

    bits = np.zeros(1 << BITS - 3, np.uint8)
    for b in text_chunks(batches, "name"):
        points, row_at = code_points(b.column("name"))
        at = Places(points).of(row_at[:-1], row_at[1:])
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def spans(row: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last tokens of all spans of one row and at most so many characters."""
    first, out, k = np.arange(len(row)), [], 0
    while len(first):
        last = first + k
        first, last = first[: np.searchsorted(last, len(row))], last[: np.searchsorted(last, len(row))]
        ok = (row[last] == row[first]) & (end[last] - start[first] <= longest)
        first, k = first[ok], k + 1
        out.append((first, last[ok]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))  # type: ignore[return-value]


def _likely_names(scanner: Scanner, bits: np.ndarray, longest: int, texts: pa.Array, fold: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``row, start, end`` and name of the spans that the filter lets through; names are slices of the folded text at the same places."""
    _, _, row, start, end = scanner.scan(texts)
    first, last = spans(row, start, end, longest)
    row, start, end = row[first], start[first], end[last]
    points, row_at = code_points(fold)
    a, b = np.minimum(row_at[row] + start, row_at[row + 1]), np.minimum(row_at[row] + end, row_at[row + 1])
    at = Places(points).of(a, b)
    ok = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
    return row[ok], start[ok], end[ok], strings(points, a[ok], b[ok])


def document_names(scanner: Scanner, bits: Any, longest: int) -> Callable[[Batches], Batches]:
    """From ``doc, text, fold`` to ``doc, items, n`` of likely names."""

    def run(batches: Batches) -> Batches:
        held = np.frombuffer(bits.value, np.uint8)
        for b in text_chunks(batches, "text"):
            row, _, _, names = _likely_names(scanner, held, longest, b.column("text"), b.column("fold"))
            if len(row):
                yield _by_document(b.column("doc"), row, *numbered(names, False))

    return run


def likely_spans(scanner: Scanner, bits: Any, longest: int, keys: list[str]) -> Callable[[Batches], Batches]:
    """From ``keys, text, fold`` to ``keys, start, end, name`` of likely names."""

    def run(batches: Batches) -> Batches:
        held = np.frombuffer(bits.value, np.uint8)
        for b in text_chunks(batches, "text"):
            row, start, end, names = _likely_names(scanner, held, longest, b.column("text"), b.column("fold"))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), pa.array(start, pa.int32()), pa.array(end, pa.int32()), names], names=[*keys, "start", "end", "name"])

    return run


def token_rows(scanner: Scanner, keys: list[str]) -> Callable[[Batches], Batches]:
    """From ``keys, text`` to ``keys, pos, token, start, end``."""

    def run(batches: Batches) -> Batches:
        for b in text_chunks(batches, "text"):
            points, row_at, row, start, end = scanner.scan(b.column("text"))
            take, first = pa.array(row), np.searchsorted(row, np.arange(b.num_rows))
            pos = np.arange(len(row)) - first[row]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), pa.array(pos, pa.int32()), strings(points, row_at[row] + start, row_at[row] + end), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[*keys, "pos", "token", "start", "end"])

    return run


# Packed paragraphs: a row a paragraph, with a list of its tokens' starts and one of their words


class Words:
    """Indices of words by their hashes, each hit compared with the word itself; about 30 bytes a word."""

    def __init__(self, texts: list[str], idx: list[int]):
        words = pa.array(texts, pa.string())
        h = self._hashes(words)
        order = np.argsort(h, kind="stable")
        self.hashes, self.idx, self.words = h[order], np.array(idx, np.int32)[order], words.take(pa.array(order))
        self.twins = int(max(np.diff(np.append(_runs(self.hashes), len(h))), default=1))

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        points, at = code_points(words)
        return Places(points).hashes(at[:-1], at[1:])

    def find(self, values: pa.Array) -> np.ndarray:
        """The index of each value, -1 for a miss."""
        out = np.full(len(values), -1, np.int32)
        if not len(self.idx) or not len(values):
            return out
        first = np.searchsorted(self.hashes, self._hashes(values))
        for k in range(self.twins):  # words of one hash stand side by side
            at = np.minimum(first + k, len(self.idx) - 1)
            same = pc.equal(self.words.take(pa.array(at)), values).to_numpy(zero_copy_only=False)
            out[same] = self.idx[at[same]]
        return out


def _listed(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def packed(scanner: Scanner, keys: list[str], lowercase: bool, least: int, words: Any) -> Callable[[Batches], Batches]:
    """From ``keys, text`` to ``keys, start``, with ``words`` also ``word_idx``, of texts with at least so many tokens; unknown words have -1."""

    def run(batches: Batches) -> Batches:
        for b in text_chunks(batches, "text"):
            points, row_at, row, start, end = scanner.scan(b.column("text"))
            n = np.bincount(row, minlength=b.num_rows)
            some = n >= least
            ok = some[row]
            row, start, end, take = row[ok], start[ok], end[ok], pa.array(np.flatnonzero(some))
            at = np.concatenate([[0], np.cumsum(n[some])])
            cols, names = [*(b.column(k).take(take) for k in keys), _listed(at, start, pa.int32())], [*keys, "start"]
            if words is not None:
                if lowercase:
                    points = ascii_lower(points)
                codes, values = numbered(strings(points, row_at[row] + start, row_at[row] + end), lowercase)
                cols.append(_listed(at, words.value.find(values)[codes], pa.int32()))
                names.append("word_idx")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each element, where rows begin among the elements, with the end, and the elements; null is empty."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)]), lists.flatten()


def _last_at(row: np.ndarray, place: np.ndarray, starts_row: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number in its row of the last start at or before each place, -1 where there is none; starts rise within a row."""
    found = np.searchsorted(starts_row * (1 << 32) + starts, row * (1 << 32) + place, "right") - 1
    return np.maximum(found - at[row], -1)


def placed(keys: list[str]) -> Callable[[Batches], Batches]:
    """From ``places`` (structs with ``_at``) and ``start`` to the structs' fields and the last start's number, or 0."""

    def run(batches: Batches) -> Batches:
        for b in list_chunks(batches, "places"):
            row, _, p = _flat(b.column("places"))
            starts_row, at, starts = _flat(b.column("start"))
            found = _last_at(row, p.field("_at").to_numpy(zero_copy_only=False).astype(np.int64), starts_row, starts.to_numpy(zero_copy_only=False).astype(np.int64), at)
            kept = [f.name for f in p.type if f.name != "_at"]
            yield pa.RecordBatch.from_arrays([*(p.field(k) for k in kept), pa.array(np.maximum(found, 0), pa.int32())], names=[*kept, "_found"])

    return run


def with_sentences(names: list[str]) -> Callable[[Batches], Batches]:
    """Adds ``sent``: of each token the number of the last of ``sentences(start, sent)`` that starts at or before it, or 0."""

    def run(batches: Batches) -> Batches:
        for b in list_chunks(batches, "start"):
            row, at, start = _flat(b.column("start"))
            s_row, s_at, s = _flat(b.column("sentences"))
            found = _last_at(row, start.to_numpy(zero_copy_only=False).astype(np.int64), s_row, s.field("start").to_numpy(zero_copy_only=False).astype(np.int64), s_at)
            number = s.field("sent").to_numpy(zero_copy_only=False)
            sent = np.where(found >= 0, number[np.clip(s_at[row] + found, 0, len(number) - 1)], 0) if len(number) else np.zeros(len(row), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), _listed(at, sent, pa.int32())], names=[*names, "sent"])

    return run


def hash_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an integer that follows what ``seed`` is the hash of."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = seed.view(np.uint64) + p5 + np.uint64(4)
    h = h ^ ((x.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


#: Pairs that a task sums before it returns them: 64 MB.
HELD_PAIRS = 1 << 23


def _pair_counts(waiting: list[np.ndarray]) -> pa.RecordBatch:
    key = np.concatenate(waiting)
    waiting.clear()
    key.sort()
    first = _runs(key)
    n, key = np.diff(np.append(first, len(key))), key[first]
    return pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(n, pa.int64())], names=["src", "dst", "n"])


def pairs(window: int, keep: Any, fixed: bool, taken: list[str], keyed: bool, counted: bool, limit: int = 1 << 17) -> Callable[[Batches], Batches]:
    """Skip-gram pairs of packed paragraphs whose ``_h0``, ``_h1`` and ``_h2`` are the hashes of the three seeds and the keys.

    The draws are those of ``training.uniform``. Out come ``taken, pos, ctx, src, dst``, or with ``keyed`` ``taken, src,
    dst, key``, or with ``counted`` ``src, dst, n`` with the smaller number first, for either order, summed over about
    HELD_PAIRS pairs. A window that isn't fixed has no such counts."""

    def run(batches: Batches) -> Batches:
        held, waiting = None if keep is None else keep.value, []
        chance = lambda h: (h & np.int64((1 << 30) - 1)) / float(1 << 30) * 4294967295.0
        for b in list_chunks(batches, "word_idx", limit):
            row, at, word = _flat(b.column("word_idx"))
            word = word.to_numpy(zero_copy_only=False)
            pos = np.arange(len(row)) - at[row]
            h0, h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_h0", "_h1", "_h2"))
            i = np.flatnonzero(word >= 0)
            if held is not None:
                i = i[chance(hash_int(pos[i], h0[row[i]])) < held[word[i]]]
            size = np.full(len(i), window)
            if not fixed:
                size = np.floor((hash_int(pos[i], h1[row[i]]) & np.int64((1 << 30) - 1)) / float(1 << 30) * window).astype(np.int64) + 1
            sent = _flat(b.column("sent"))[2].to_numpy(zero_copy_only=False) if "sent" in b.schema.names else None
            src, dst = [], []
            for d in range(1, window + 1) if counted else (d for k in range(1, window + 1) for d in (-k, k)):
                a = i[size >= abs(d)]
                a = a[(a + d >= at[row[a]]) & (a + d < at[row[a] + 1])]
                c = a + d
                ok = word[c] >= 0
                if sent is not None:
                    ok &= sent[a] == sent[c]
                src.append(a[ok])
                dst.append(c[ok])
            a, c = np.concatenate(src), np.concatenate(dst)
            if held is not None:
                ok = chance(hash_int(pos[c], hash_int(pos[a], h2[row[a]]))) < held[word[c]]
                a, c = a[ok], c[ok]
            if counted:
                x, y = word[a].astype(np.int64), word[c].astype(np.int64)
                waiting.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                if sum(map(len, waiting)) >= HELD_PAIRS:
                    yield _pair_counts(waiting)
                continue
            cols, names = [b.column(k).take(pa.array(row[a])) for k in taken], [*taken]
            if keyed:
                own = [pa.array(hash_int(pos[c], hash_int(pos[a], h0[row[a]])))]
            else:
                cols, names, own = [*cols, pa.array(pos[a], pa.int32()), pa.array(pos[c], pa.int32())], [*names, "pos", "ctx"], []
            yield pa.RecordBatch.from_arrays([*cols, pa.array(word[a], pa.int32()), pa.array(word[c], pa.int32()), *own], names=[*names, "src", "dst", *["key"] * keyed])
        if waiting:
            yield _pair_counts(waiting)

    return run


def anchors(keys: list[str], window: int) -> Callable[[Batches], Batches]:
    """From packed paragraphs with ``targets(start, end, entity_idx)`` to ``keys, start, end, entity_idx, ctx, word_idx``."""

    def run(batches: Batches) -> Batches:
        for b in list_chunks(batches, "start"):
            row, _, t = _flat(b.column("targets"))
            s_row, at, starts = _flat(b.column("start"))
            starts = starts.to_numpy(zero_copy_only=False).astype(np.int64)
            word = _flat(b.column("word_idx"))[2].to_numpy(zero_copy_only=False)
            begin, stop = (t.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            first = np.maximum(_last_at(row, begin, s_row, starts, at), 0)
            last = np.maximum(_last_at(row, np.maximum(0, stop - 1), s_row, starts, at), 0)
            low, high = np.maximum(0, first - window), np.minimum(last + window, at[row + 1] - at[row] - 1)
            n = np.maximum(0, high - low + 1)
            which, ctx = np.repeat(np.arange(len(row)), n), _repeated(low, n)
            found = word[at[row[which]] + ctx]
            ok = ((ctx < first[which]) | (ctx > last[which])) & (found >= 0)
            if "sent" in b.schema.names and "link_sent" in {f.name for f in t.type}:
                ok &= _flat(b.column("sent"))[2].to_numpy(zero_copy_only=False)[at[row[which]] + ctx] == t.field("link_sent").to_numpy(zero_copy_only=False)[which]
            which, ctx, found = which[ok], ctx[ok], found[ok]
            take = pa.array(row[which])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), *(t.field(c).take(pa.array(which)) for c in ("start", "end", "entity_idx")), pa.array(ctx, pa.int32()), pa.array(found, pa.int32())], names=[*keys, "start", "end", "entity_idx", "ctx", "word_idx"])

    return run


def piece_rows(keys: list[str]) -> Callable[[Batches], Batches]:
    """From ``keys, parts``, the pieces of a text in order, to ``keys, sent, start, end``."""

    def run(batches: Batches) -> Batches:
        for b in list_chunks(batches, "parts"):
            row, at, part = _flat(b.column("parts"))
            ends = np.concatenate([[0], np.cumsum(pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64))])
            take, base = pa.array(row), ends[at[row]]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), pa.array(np.arange(len(row)) - at[row], pa.int32()), pa.array(ends[:-1] - base, pa.int32()), pa.array(ends[1:] - base, pa.int32())], names=[*keys, "sent", "start", "end"])

    return run
