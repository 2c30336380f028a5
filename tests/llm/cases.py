"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

WORDS = "the of river stone light seven paper garden winter road under silver copper field music cloud ocean letter market bridge".split()
CLASHING = "row long, h string, k int, label string, list string, hits string, spans string, copy string, bands string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 60)
    out: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    out += [(10, base[0]), (11, base[0]), (12, base[1].upper()), (13, base[2] + " extra words at the end"), (14, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30))]
    out += [(15, shared + " " + prose(rng, 40)), (16, "a b a b " * 60), (17, "x" * 400), (18, "ÄÖ ß é 😀 " * 30), (19, "one two"), (20, "one two"), (21, "word"), (22, " \t\n "), (23, ""), (24, None), (None, base[3]), (None, None)]
    out += [(30, base[4]), (30, base[4]), (31, "\x00 odd \x1f bytes   here")]
    near = base[5].split()
    for i in range(8):
        w = list(near)
        w[i * 11 % len(w)] = f"changed{i}"
        out.append((40 + i, " ".join(w)))
    out.append((50, prose(rng, 6000)))
    return out


def frame(spark, rows, clash: bool = True):
    """``doc_id, text, lang, source, n_chars`` and columns named like internal ones."""
    full = [(i, t, None if i == 3 else "en", None if i is not None and i % 4 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t), *((7, "h", 1, "l", "x", "y", "z", "c", "b") if clash else ())) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHING if clash else ""))


def empty(spark):
    return frame(spark, []).limit(0)
