import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from corpuscle.llm import repeats
from corpuscle.llm.repeats import GRAM, LENGTH, bucket_ids, keep_first_strings, refine, remove_repeats, runs

from .cases import empty, frame, prose, texts


def brute(rows):
    """Windows seen at an earlier (doc_id, start), with the rows of one id laid over each other."""
    where = {}
    for i, t in rows:
        if i is None:
            continue
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            k = b[p : p + LENGTH]
            where[k] = min(where.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - LENGTH + 1):
                if where[b[p : p + LENGTH]] < (i, p):
                    gone[p : p + LENGTH] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_all_windows(spark):
    for hot in (20_000, 0):
        out = remove_repeats(frame(spark, texts()), hot_rows=hot).collect()
        assert sorted((tuple(r) for r in out), key=str) == brute(texts())


def test_repeated_rows_alone(spark):
    """Rows of one id whose text stands under no other id keep it; a repeat inside the text goes from each of them."""
    rng = random.Random(5)
    one, two = prose(rng, 150), prose(rng, 80)
    inner = two + " | " + prose(rng, 5) + " | " + two
    rows = [(1, one), (1, one), (2, inner), (2, inner), (2, inner), (3, prose(rng, 90))]
    want = brute(rows)
    assert [r[2] > 0 for r in want] == [False, False, True, True, True, False]
    for hot in (20_000, 0):
        assert sorted((tuple(r) for r in remove_repeats(frame(spark, rows).coalesce(1), hot_rows=hot).collect()), key=str) == want


def test_cut_texts_keep_columns(spark):
    docs = frame(spark, texts())
    out = keep_first_strings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    whole = {r.doc_id: r.text for r in out.collect()}
    assert whole[10] == "" and whole[0] == texts()[0][1] and whole[24] is None
    assert all(r.h == "h" and r.spans == "z" for r in out.collect())


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_bucket_ids_name_strings():
    text = np.frombuffer(b"abcabcabd" * 40, np.uint8)
    for depth in (20, 40, 80, 100):
        ids = bucket_ids(text, depth)
        strings = [text[i : i + depth].tobytes() for i in range(len(text) - depth + 1)]
        assert len(ids) == len(strings)
        assert len(set(ids.tolist())) == len(set(strings)) == len(set(zip(ids.tolist(), strings)))


def test_refinement_by_sorting_tells_strings_apart():
    """Bucket numbers at depth 100 of runs of suffixes in several contexts: equal for equal strings and for no others."""
    rng = random.Random(2)
    part = bytes(rng.choice(b"ab") for _ in range(30))
    contexts = [(part * 9)[i : i + 99 + n] for i, n in ((0, 5), (3, 1), (7, 40), (0, 61), (30, 5))] + [bytes(rng.choice(b"ab") for _ in range(130))]
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum([0] + [len(c) for c in contexts[:-1]])
    n = np.array([len(c) - 99 for c in contexts])
    got = refine(buf, first, n)
    want = [c[i : i + 100] for c, k in zip(contexts, n) for i in range(k)]
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want)) == len(set(zip(got.tolist(), want)))
    assert len(refine(buf, first[:0], n[:0])) == 0


def test_runs_have_the_leftmost_smallest_name():
    parts = [(t or "").encode() for _, t in texts()] + [b"", b"x" * 99, b"y" * 100, b"z" * 101, b""]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    offs = np.cumsum([0] + [len(p) for p in parts])
    ids = bucket_ids(buf, GRAM)
    want, before = [], None
    for t, p in enumerate(parts):
        for s in range(len(p) - LENGTH + 1):
            window = ids[offs[t] + s : offs[t] + s + LENGTH - GRAM + 1]
            mini = (t, s + int(window.argmin()))
            if mini == before:
                want[-1][3] += 1
            else:
                want.append([int(window.min()), t, s, 1])
            before = mini
    assert [list(map(int, r)) for r in zip(*runs(buf, offs))] == want


def test_runs_are_found_in_small_arrays():
    """The arrays at work on a batch are no multiple of its text, so they stay in cache."""
    rng = random.Random(6)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([prose(rng, 1500) for _ in range(400)])], ["doc_id", "text"])
    list(repeats._minimizers(iter([batch.slice(0, 20)])))
    tracemalloc.start()
    list(repeats._minimizers(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * batch.column("text").nbytes


def test_suffixes_alone_in_a_bucket_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(4)
    buf = rng.integers(0, 256, 20_000).astype(np.uint8)
    buf[10_000:10_150] = buf[:150]
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: sizes.append(len(x)) or unique(x, *a, **k))
    got = refine(buf, np.array([0, 5000, 10_000]), np.array([51, 51, 51]))
    assert len(set(got.tolist())) == 102 and (got[:51] == got[102:]).all()
    assert sizes == [3 * 111, 2 * 71, 2 * 51]


def test_buckets_of_one_suffix_go_without_python(spark):
    """Rows that say how often a batch met a bucket (n), and, under random names, suffixes of those it met twice (n = -1)."""
    rows = [(1, 10, 0, 1), (1, 11, 5, 1), (2, 12, 0, 1), (3, 10, 7, 2), (3, 13, 1, 1), (4, 10, 9, 3), (90, 10, 7, -1), (91, 10, 8, -1)]
    out = repeats._several(spark.createDataFrame(rows, "k long, doc_id long, s int, n int"))
    assert sorted(map(tuple, out.collect())) == [(10, 0), (10, 7), (10, 8), (11, 5), (13, 1)]
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
