import pytest

import corpus_pipeline as P
from corpuscle.llm.scratch import Scratch

from .test_near import brute as components_of
from .test_repeats import brute as repeats_of
from .test_decontaminate import split


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    keep, out = Scratch(spark, "test"), [docs]
    for _, f in P.STAGES:
        out.append(keep.keep(f(spark, out[-1], data), "stage"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_have_the_columns_and_the_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]


def test_quality_stage_keeps_whole_rows(spark, data, stages):
    before, after = stages[0], stages[1]
    assert after.columns == before.columns
    assert after.exceptAll(before).count() == 0 and 0 < after.count() < before.count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert after.join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_near_stage_is_all_pairs(stages):
    want = sorted(i for i, _, c in components_of(rows(stages[1]), 5) if i == c)
    assert sorted(i for i, _ in rows(stages[2])) == want and stages[2].columns == stages[0].columns


def test_repeat_stage_is_all_windows(stages):
    want = {i: n - gone for i, n, gone, _, _ in repeats_of(rows(stages[2]))}
    got = {i: len(t.encode()) for i, t in rows(stages[3])}
    assert got.keys() == want.keys() and all(0 <= want[i] - got[i] <= 6 for i in got)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_benchmark_stage(spark, data, stages):
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = {i for i, t in rows(stages[3]) if not any(tuple(split(t)[a : a + n]) in windows for n in {len(k) for k in windows} for a in range(len(split(t)) - n + 1))}
    assert {i for i, _ in rows(stages[4])} == clean


def test_mix_stage_and_run(spark, data, stages):
    out = P.run(spark, data)
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[5].collect()))


def test_stages_on_empty_and_odd_tables(spark, data):
    """Each stage on no rows, and on nulls, repeats, empty texts and clashing columns: columns stay, and what it doesn't judge stays."""
    from .cases import empty, frame

    odd = [(None, None), (None, "a b c"), (1, None), (1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, " \t ")]
    for name, f in P.STAGES:
        none = f(spark, empty(spark), data)
        assert none.count() == 0, name
        docs = frame(spark, odd)
        out = f(spark, docs, data)
        if f is not P.STAGES[-1][1]:
            assert out.columns == docs.columns and none.columns == empty(spark).columns, name
            rest = out.exceptAll(docs).count()
            assert rest == 0, name
            if f is not P.STAGES[0][1]:
                assert out.count() == len(odd), name
        else:
            assert out.count() == len(odd)
