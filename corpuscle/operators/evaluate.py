"""Intrinsic evaluation: rank correlation, analogies, relatedness, classification metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .vectors import cosine, in_grid

#: The seeds of the relatedness set by kind; the mean over seeds doesn't depend on it.
SEED_KINDS: dict[str, list[str]] = {
    "IT": "Apple Inc.|Facebook|Google|IBM|Microsoft".split("|"),
    "people": "Angelina Jolie|Brad Pitt|Chuck Norris|Jennifer Aniston|Johnny Depp|Leonardo DiCaprio".split("|"),
    "games": "Deus Ex (series)|Grand Theft Auto IV|Guitar Hero (video game)|Max Payne|Quake (video game)".split("|"),
    "series": "Futurama|Mad Men|The A-Team|The Sopranos|The Wire".split("|"),
}


def average_ranks(df: DataFrame, value: str, out: str, groups: list[str]) -> DataFrame:
    """Ranks from 1 with ties at their mean, within each group."""
    w = Window.partitionBy(*groups)
    ties = F.count("*").over(Window.partitionBy(*groups, value))
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (ties - 1) / F.lit(2.0))


def spearman(df: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """``groups, rho, n``; null where a side is constant or fewer than two pairs are left."""
    keys = groups or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not keys:
        both, keys = both.withColumn("_all", F.lit(1)), ["_all"]
    ranked = average_ranks(average_ranks(both, x, "_rx", keys), y, "_ry", keys)
    # a constant side has no correlation; corr itself would fail on it
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    out = ranked.groupBy(*keys).agg(rho.alias("rho"), F.count("*").alias("n"))
    return out.drop("_all")


def word_similarity(gold: DataFrame, words: DataFrame, lowercase: bool = True) -> DataFrame:
    """``rho, n, oov`` of ``gold(w1, w2, gold)`` against cosines of ``words(name, syn0)``; pairs with an unknown word count as oov."""
    fold = (lambda c: F.lower(c)) if lowercase else (lambda c: F.col(c))
    a, b = (words.select(F.col("name").alias(f"_{k}"), F.col("syn0").alias(f"v{k}")) for k in "ab")
    pairs = gold.withColumn("w1", fold("w1")).withColumn("w2", fold("w2")).join(a, F.col("w1") == F.col("_a"), "left").join(b, F.col("w2") == F.col("_b"), "left")
    pairs = pairs.withColumn("known", F.col("va").isNotNull() & F.col("vb").isNotNull()).withColumn("cos", F.when(F.col("known"), cosine(F.col("va"), F.col("vb"))))
    oov = pairs.agg(F.coalesce(F.sum((~F.col("known")).cast("int")), F.lit(0)).alias("oov"))
    rho = spearman(pairs.where("known"), "gold", "cos")
    return oov.join(rho, F.lit(True), "left").select("rho", "n", "oov")  # one row each


def analogy_vocabulary(words: DataFrame, size: int | None = None) -> DataFrame:
    """All words, or the ``size`` most frequent, with unit vectors."""
    out = words if size is None else words.orderBy(F.desc("count"), "idx").limit(size)
    length = F.sqrt(F.aggregate(F.col("syn0").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("u", F.when(length > 0, F.transform(F.col("syn0").cast("array<double>"), lambda x: x / length)))


def analogies(questions: DataFrame, vocabulary: DataFrame, block: int = 1000, word_block: int = 16384) -> DataFrame:
    """``questions(qid, a, b, c, d)`` answered with the word of largest dot product with b - a + c, none of a, b, c: adds ``pred``.

    Questions with an unknown word are left out. Each block of questions meets each block of the vocabulary in a task of
    its own, which answers with its best word a question, and the best of those wins, ties to the smaller word."""
    known = questions
    for k in "abcd":
        known = known.join(vocabulary.select(F.col("name").alias(f"_{k}"), F.col("u").alias(f"u{k}")), F.col(k) == F.col(f"_{k}")).drop(f"_{k}")
    known = known.select("qid", "a", "b", "c", "d", F.zip_with(F.zip_with("ub", "ua", lambda x, y: x - y), "uc", lambda x, y: x + y).alias("target"))

    def answer(q: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(words):
            return pd.DataFrame({"qid": [], "pred": [], "score": []})
        words = words.sort_values("name", kind="stable")
        names = words["name"].to_numpy()
        s = np.array(q["target"].tolist(), float) @ np.array(words["u"].tolist(), float).T
        place = pd.Index(names)
        for k in "abc":
            at = place.get_indexer(q[k])
            s[np.flatnonzero(at >= 0), at[at >= 0]] = -np.inf
        top = s.argmax(1)
        score = s[np.arange(len(q)), top]
        ok = np.isfinite(score)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[ok], "pred": names[top][ok], "score": score[ok]})

    rows = vocabulary.where("u is not null").select("name", "u")
    found = in_grid(known.select("qid", "a", "b", "c", "target"), rows, block, word_block, "qid", "name").applyInPandas(answer, "qid long, pred string, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "pred")
    best = found.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "pred")
    return known.drop("target").join(best, "qid", "left")


def analogy_accuracy(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``accuracy, n, oov`` over the questions whose four words are known."""
    answered = analogies(questions, vocabulary).agg(F.avg((F.col("pred") == F.col("d")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    total = questions.agg(F.count("*").alias("_all"))
    return answered.join(total, F.lit(True)).select("accuracy", "n", (F.col("_all") - F.col("n")).alias("oov"))  # one row each


def relatedness(ranked: DataFrame, vectors: DataFrame) -> DataFrame:
    """``seed, rho, n`` of ``ranked(seed, rank, title)`` (rank 0 is most related) against cosines of ``vectors(name, syn0)``.

    Gold numbers fall from the known titles' count; seeds without a vector are left out."""
    s = vectors.select(F.col("name").alias("seed"), F.col("syn0").alias("vs"))
    t = vectors.select(F.col("name").alias("title"), F.col("syn0").alias("vt"))
    pairs = ranked.join(s, "seed").join(t, "title").withColumn("gold", -F.col("rank")).withColumn("cos", cosine(F.col("vs"), F.col("vt")))
    return spearman(pairs, "gold", "cos", ["seed"])


def mean_relatedness(ranked: DataFrame, vectors: DataFrame) -> DataFrame:
    return relatedness(ranked, vectors).agg(F.avg("rho").alias("rho"), F.count("*").alias("seeds"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """``accuracy, macro_f1``; F1 averages over the labels that occur as label or prediction."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"))))
    per = cells.select("l", "p", "n", sides.alias("s")).groupBy("s.c").agg(
        F.sum(F.when((F.col("l") == F.col("p")) & (F.col("s.t") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.col("n") * F.col("s.t")).alias("support"),
        F.sum(F.col("n") * F.col("s.q")).alias("guessed"),
    )
    f1 = F.when(F.col("support") + F.col("guessed") > 0, F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def report(rows: DataFrame, kind: str = "text") -> DataFrame:
    """One ``line`` for each ``(name, score, oov)``, with four decimals, as text or csv."""
    shape = "%s,%.4f,%d" if kind == "csv" else "%s: %.4f (%d)"
    return rows.select(F.format_string(shape, F.col("name"), F.col("score").cast("double"), F.col("oov").cast("long")).alias("line"))
