"""Vectorised text primitives over Arrow string columns: token bounds, 64-bit fingerprints, chunking.

Everything works on the UTF-8 bytes of many texts at once, so no Python string is made for a token. Fingerprints are
polynomial over the ring of integers modulo 2**64 with a random value for each byte; equal strings get equal prints
everywhere, and two different strings of a corpus of V distinct ones meet with a chance of about V**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 2**64)
CHUNK = 1 << 20

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown on demand."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK + CHUNK // 4)
        with np.errstate(over="ignore"):
            for base, name in ((BASE, "_pow"), (_INV, "_inv")):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                globals()[name] = np.multiply.accumulate(a)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def separators(kind: str) -> np.ndarray:
    """A table of 256 booleans: bytes outside any word. 'space': 0x20 and 0x09-0x0D; 'alnum': all ASCII but 0-9, a-z (and A-Z, lowered first)."""
    t = np.zeros(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = True
    else:
        t[:0x80] = True
        for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            t[lo:hi] = False
    return t


SPACE, ALNUM = separators("space"), separators("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def string_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``size`` bytes; a longer text stands alone, whole."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every maximal run of non-separators inside each text."""
    inside = ~sep[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def prefix_prints(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """P with P[j] = sum over i < j of table[buf[i]] * BASE**i."""
    pw, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_prints(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fingerprint of every span, whatever its place."""
    _, iv = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * iv[start] + (end - start).astype(np.uint64))


def gram_prints(prefix: np.ndarray, size: int) -> np.ndarray:
    """What ``span_prints`` gives for every span of ``size`` bytes, without gathers."""
    n = max(0, len(prefix) - size)
    _, iv = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[len(prefix) - n :] - prefix[:n]) * iv[:n] + np.uint64(size))


def segment_sum(values: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by segment number."""
    return np.bincount(seg, values, n)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
