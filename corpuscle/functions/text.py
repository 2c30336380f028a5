"""Tokens, sentences and normal forms of text columns."""

from __future__ import annotations

import importlib.util
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from . import kernels as K

#: Letters, numbers and the underscore; the class that Java, RE2 and Python's \w agree on.
WORD = r"[\p{L}\p{N}_]+"
_SENTENCE_END = r"[.!?…。！？]+[\"')\]]*\s+"


def word_array(text: Column, rule: str = WORD) -> Column:
    """The tokens of a text, in order, without offsets: no explode, no shuffle."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), F.lit(0))


@lru_cache
def _edges(rule: str) -> tuple[int, ...]:
    """Where the code points that Java's regular expressions count to a class of characters begin and end, by turns: asked of the JVM once, as Unicode versions differ."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    rest = np.frombuffer(SparkSession.active()._jvm.java.util.regex.Pattern.compile(rule).matcher(every).replaceAll("").encode("utf-32-le"), np.uint32)
    inside = np.ones(0x110002, bool)
    inside[rest.astype(np.int64) + 1] = inside[0] = inside[-1] = False
    inside[0xD801:0xE001] = False
    return tuple(map(int, np.flatnonzero(inside[1:] != inside[:-1])))


def regexp_tokens(df: DataFrame, keys: list[str], text: str = "text", rule: str = WORD) -> DataFrame:
    """One row a token: ``keys, pos, token, start, end`` with code-point offsets; a map, without a shuffle.

    For a rule other than WORD a token's start is the length of all gaps and tokens before it, a running sum by row key;
    ``keys`` must tell rows apart. The lengths of pieces are used, never a regex engine's positions, so astral characters
    count once."""
    if scanner := Tokenizer(rule).scanner():
        schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, t) for c, t in (("pos", T.IntegerType()), ("token", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType())))])
        return df.select(*keys, F.col(text).alias("text")).mapInArrow(K.token_rows(scanner, keys), schema)
    t = F.coalesce(F.col(text), F.lit(""))
    pieces = F.arrays_zip(word_array(F.col(text), rule).alias("token"), F.split(t, rule, -1).alias("gap"))
    rows = df.select(*keys, F.posexplode(pieces).alias("pos", "p")).select(*keys, "pos", F.col("p.token").alias("token"), F.length("p.gap").alias("g"), F.length("p.token").alias("n"))
    end = F.sum(F.col("g") + F.coalesce("n", F.lit(0))).over(Window.partitionBy(*keys).orderBy("pos"))
    rows = rows.withColumn("end", end.cast("int")).where("token is not null")
    return rows.select(*keys, "pos", "token", (F.col("end") - F.col("n")).alias("start"), "end")


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, sent, start, end``: contiguous spans that cover the text; white space after a sentence belongs to it."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({_SENTENCE_END})", "$1\u0000")
    parts = F.filter(F.split(marked, "\u0000"), lambda s: s != "")
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("sent", "start", "end"))])
    return df.select(*keys, parts.alias("parts")).mapInArrow(K.piece_rows(keys), schema)


class Tokenizer:
    """A way to cut texts: subclasses give ``tokens``. ``rule`` is the pattern of the built-in one."""

    def __init__(self, rule: str = WORD):
        self.rule = rule

    def tokens(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        return regexp_tokens(df, keys, text, self.rule)

    def words(self, text: Column) -> Column:
        return word_array(text, self.rule)

    def scanner(self) -> K.Scanner | None:
        """What finds the same tokens in Arrow kernels; None for rules other than runs of a class of characters."""
        return K.Scanner(np.array(_edges(self.rule))) if self.rule == WORD else None


class PythonTokenizer(Tokenizer):
    """A tokenizer made of a Python function from a text to (token, start, end) triples, run over Arrow batches."""

    def __init__(self, cut: Callable[[str], list[tuple[str, int, int]]]):
        self.cut = cut

    def _spans(self) -> Callable[[Column], Column]:
        cut = self.cut

        @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
        def spans(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"token": a, "start": b, "end": c} for a, b, c in cut(t or "")])

        return spans

    def tokens(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        return df.select(*keys, F.posexplode(self._spans()(F.col(text))).alias("pos", "t")).select(*keys, "pos", "t.token", "t.start", "t.end")

    def scanner(self) -> K.Scanner | None:
        return K.Scanner(None, self.cut)

    def words(self, text: Column) -> Column:
        return F.transform(self._spans()(text), lambda t: t["token"])


def _icu(language: str) -> Tokenizer:
    from icu import BreakIterator, Locale  # type: ignore[import-not-found]

    whole = re.compile(r"^[\w\d]+$")

    def cut(text: str) -> list[tuple[str, int, int]]:
        it = BreakIterator.createWordInstance(Locale(language))
        it.setText(text)
        marks = [0, *it]
        pieces = ((text[a:b], a, b) for a, b in zip(marks, marks[1:]))
        return [p for p in pieces if whole.match(p[0])]

    return PythonTokenizer(cut)


def _jieba(language: str) -> Tokenizer:
    import jieba  # type: ignore[import-not-found]

    return PythonTokenizer(lambda text: [(w, a, b) for w, a, b in jieba.tokenize(text) if w.strip()])


def _mecab(language: str) -> Tokenizer:
    import MeCab  # type: ignore[import-not-found]

    def cut(text: str) -> list[tuple[str, int, int]]:
        out, at, node = [], 0, MeCab.Tagger().parseToNode(text)
        while node:
            if node.surface:
                start = text.index(node.surface, at)
                at = start + len(node.surface)
                out.append((node.surface, start, at))
            node = node.next
        return out

    return PythonTokenizer(cut)


_MODULES = {"icu": ("icu", _icu), "jieba": ("jieba", _jieba), "mecab": ("MeCab", _mecab)}


def get_tokenizer(name: str, language: str = "en") -> Tokenizer:
    """'regexp', or 'icu', 'jieba' or 'mecab' where the module is installed; other names are not implemented."""
    if name == "regexp":
        return Tokenizer()
    if name not in _MODULES:
        raise NotImplementedError(f"tokenizer {name!r}")
    module, make = _MODULES[name]
    if importlib.util.find_spec(module) is None:
        raise RuntimeError(f"tokenizer {name!r} needs the module {module!r}")
    return make(language)


def get_default_tokenizer(language: str) -> Tokenizer:
    """MeCab for Japanese, jieba for Chinese, else ICU, else the regular expression."""
    if language in ("ja", "zh"):
        return get_tokenizer("mecab" if language == "ja" else "jieba", language)
    return get_tokenizer("icu", language) if importlib.util.find_spec("icu") else Tokenizer()


def get_sentence_detector(name: str, language: str = "en") -> Callable[[DataFrame, list[str], str], DataFrame]:
    """The detector called 'icu': ICU's where installed, else the built-in rule of the same contract."""
    if name != "icu":
        raise NotImplementedError(f"sentence detector {name!r}")
    if importlib.util.find_spec("icu") is None:
        return sentences
    from icu import BreakIterator, Locale  # type: ignore[import-not-found]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def cut(text: str | None) -> list[dict]:
            it = BreakIterator.createSentenceInstance(Locale(language))
            it.setText(text or "")
            marks = [0, *it]
            return [{"start": a, "end": b} for a, b in zip(marks, marks[1:])]

        return texts.map(cut)

    return lambda df, keys, text="text": df.select(*keys, F.posexplode(spans(F.col(text))).alias("sent", "s")).select(*keys, "sent", "s.start", "s.end")


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """Lower case, runs of white space as one space, combining marks dropped. Spark has no built-in decomposition."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        apart = unicodedata.normalize("NFD", re.sub(r"\s+", " ", t.lower()))
        return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c) != "Mn"))

    return texts.map(one)
