import re

from corpuscle.llm.mixing import SCHEDULE, WEIGHTS, curriculum_mix

from .cases import empty, frame, texts


def targets(sizes, share=1.5, cap=2.0):
    """Resharing by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if w[s] * left / total > cap * sizes[s] or sizes[s] == 0}
        if not over:
            return {**out, **{s: w[s] * left / total for s in free}}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
        if not free:
            return out


def test_targets_and_words_taken(spark):
    docs = frame(spark, texts())
    rows = curriculum_mix(docs).collect()
    assert len(rows) == len(texts())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sources = {}
    for r in docs.collect():
        sources[r.source] = sources.get(r.source, 0) + size(r.text)
    want = targets(sources)
    by_size = {v: want[k] for k, v in sources.items()}
    assert len(by_size) == len(sources)
    taken = {}
    for r in rows:
        assert abs(r.target - by_size[r.source_size]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert taken == {k: round(v) for k, v in by_size.items()}
    positions = [r.position for r in rows]
    assert positions == sorted(positions, key=lambda p: (p is not None, p))
    assert sorted(map(str, rows)) == sorted(map(str, curriculum_mix(docs.repartition(3)).collect()))


def test_positions_follow_the_schedule(spark):
    """Words placed before half time are the integral of the source's weight."""
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    rows = curriculum_mix(docs, weights=(1.0, 1.0, 1.0), share=0.9).collect()
    for k, (early, late) in enumerate(SCHEDULE):
        mine = [r for r in rows if r.doc_id % 3 == k and r.taken]
        before = sum(r.taken for r in mine if r.position < 0.5) / sum(r.taken for r in mine)
        assert abs(before - (early * 0.5 + (late - early) * 0.125) / ((early + late) / 2)) < 0.01


def test_empty_and_wordless(spark):
    assert curriculum_mix(empty(spark)).count() == 0
    rows = curriculum_mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in rows] == [0, 0]
